"""Vector search, manifests and evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot / (norm(a) * norm(b))


#: Bytes of the vectors of one block, on average, and numbers of distances that are held at once.
BLOCK_BYTES, TILE = 2 << 20, 1 << 20


def _blocks(rows: DataFrame, keys: list[str], wanted: str) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, id, v) as blocks of about BLOCK_BYTES, each a row of keys, block, ids and vectors in order of ids; and how many blocks the keys have.

    wanted is the name of the number of blocks. Rows are dealt by a hash, so that a frequent key has many blocks.
    """
    rows = rows.where("v IS NOT NULL").withColumn("dim", F.size("v"))
    keys = [*keys, "dim"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") * F.col("dim") * 8 / BLOCK_BYTES).cast("long").alias(wanted))

    def packed(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id"))
        dim = table.column("dim")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[np.argsort(ids, kind="stable")]
        ids = np.sort(ids, kind="stable")
        usable = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
        one = {k: table.column(k).slice(0, 1) for k in [*keys, "block"]}
        return pa.table(one | {"ids": pa.array([ids[usable]], pa.list_(pa.int64())), "v": pa.array([v[usable].tobytes()], pa.binary())})

    dealt = rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col(wanted)))
    types = dict(dealt.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in [*keys, "block"]), "ids array<bigint>", "v binary"])
    return dealt.drop(wanted).groupBy(*keys, "block").applyInArrow(packed, schema), sizes


def nearest(q: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row of q the places of its k nearest rows of v by cosine distance, earlier ones first where equal, with the distances.

    A matrix product finds who may be among them; their distances are then computed alike for equal
    vectors, wherever in a matrix they stand.
    """
    nq, nv = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    unit = v / nv[:, None]
    step = max(1, TILE // max(1, len(v)))
    for low in range(0, len(q), step):
        part = q[low : low + step]
        near = (part / nq[low : low + step, None]) @ unit.T
        most = min(k, len(v))
        least = np.partition(near, len(v) - most, axis=1)[:, len(v) - most] - 1e-9
        for i in range(len(part)):
            at = np.flatnonzero(near[i] >= least[i])
            distance = 1 - (part[i] * v[at]).sum(axis=1) / (nq[low + i] * nv[at])
            order = np.argsort(distance, kind="stable")[:most]
            yield at[order], distance[order]


def top_k(questions: DataFrame, vectors: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """The k nearest vectors of each question by cosine distance, with distance and rank, ties by the smaller id.

    questions (query_id, query, and the column same) and vectors (vec_id, embedding, and same) become
    blocks of bounded bytes. Every block of questions meets every block of vectors of its value of
    same in one matrix product, which gives k rows a question at most; these are ranked in parts
    before the shuffle and after it. Nothing is broadcast, so both sides may grow, and the work is
    theirs multiplied, which an exact search needs. Without a distance, and so never found: null vectors,
    vectors of another length than the question's, with null or non-finite entries, or of zeros only. A
    null in same meets nothing.
    """
    keys = [same] if same else []
    double = "array<double>"
    ask, _ = _blocks(questions.select(*keys, F.col("query_id").cast("long").alias("id"), F.col("query").cast(double).alias("v")), keys, "n_ask")
    have, sizes = _blocks(vectors.select(*keys, F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(double).alias("v")), keys, "n_have")
    each = ask.drop("block").join(sizes, [*keys, "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_have") - 1)))
    meet = each.select(*keys, "dim", "block", F.col("ids").alias("query_ids"), F.col("v").alias("q")).join(have, [*keys, "dim", "block"]).select("dim", "query_ids", "q", "ids", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, query_ids, q, ids, v = (batch.column(c)[row] for c in range(5))
                query_ids, ids = np.asarray(query_ids.values), np.asarray(ids.values)
                if not len(query_ids) or not len(ids):
                    continue
                q, v = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim.as_py()) for x in (q, v))
                found = [(np.full(len(at), query_ids[i]), ids[at], distance) for i, (at, distance) in enumerate(nearest(q, v, k))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "vec_id", "distance"])

    scored = meet.mapInArrow(compare, "query_id bigint, vec_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def company_retriever(questions: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """The k nearest entries of the store of each question's company; a question without a company searches the entries without one.

    questions: query_id, company_id, query. store: vec_id, company_id, embedding, and what is shown of
    an entry. Returns query_id, rank, distance and the store's columns but the vector.
    """
    company = F.when(F.col("company_id").isNull(), "n").otherwise(F.concat(F.lit("c"), F.col("company_id").cast("string"))).alias("_company")
    found = top_k(questions.select("query_id", "query", company), store.select("vec_id", "embedding", company), k, "_company")
    return found.join(store.drop("embedding"), "vec_id")


def latest_manifest(manifests: DataFrame, as_of: Column, inclusive: bool) -> DataFrame:
    """Per company and config the newest manifest before as_of, or at it if inclusive."""
    near = manifests.where(F.col("as_of") <= as_of if inclusive else F.col("as_of") < as_of)
    rest = [c for c in manifests.columns if c not in ("company", "config")]
    return near.groupBy("company", "config").agg(F.max_by(F.struct(*rest), "as_of").alias("_m")).select("company", "config", "_m.*")


def merge_versions(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The base's versions overlaid by the new ones."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def data_modes(rows: DataFrame) -> DataFrame:
    """Per run the mode of its evidence: the only one, 'mixed', or null without any; and ids with conflicting modes."""
    by_id = rows.groupBy("run_id", "evidence_id").agg(F.min("mode").alias("low"), F.max("mode").alias("high"))
    return by_id.groupBy("run_id").agg(
        F.when(F.min("low") == F.max("high"), F.min("low")).when(F.min("low").isNotNull(), "mixed").alias("mode"), F.count_if(F.col("low") != F.col("high")).alias("conflicts"),
    )
