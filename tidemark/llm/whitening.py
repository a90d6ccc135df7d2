"""Whitening of embeddings by an eigendecomposition with cyclic Jacobi rotations.

Each entry c of a vector becomes the integer x = floor(64 c) + 1000000. Sums per dimension are exact.
A second pass adds up the products of centred entries, an array per dimension and task, in a shuffle
by dimension; the driver gets one matrix of dimensions by dimensions, whatever the number of rows.
Symmetric Jacobi rotations then go round all pairs of dimensions, in rounds of disjoint pairs, until
every off-diagonal entry is lost beside its diagonal ones, which gives small eigenvalues to high
relative accuracy. The sorted whitening matrix is broadcast, dimensions by at most COMPONENTS
numbers. The whitened rows are written once, and their covariance is measured on them.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries, or entries
beyond LIMIT, are dropped; so are rows whose vector is not of the most common length (of equally
common ones, the longest). Components whose eigenvalue isn't above the rounding of the largest one
are left out, as the rows don't vary along them; fewer than two different rows give no component and
no row. Rows with null or repeated ids are rows of their own. Columns besides vec_id and embedding
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ready, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries above this in size count as non-finite: sums of a batch stay exact.
LIMIT = 2.0**39
MOST_SWEEPS = 60
TASKS_AT_ONCE = 256


def _integers(vectors: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length (or that one only): the places of the vectors without bad entries, and their integers, a row each."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]) if size is None else [size]:
        at = np.flatnonzero(lengths == n)
        flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        good = (np.abs(flat) <= LIMIT).all(axis=1)
        if good.any():
            yield at[good], np.floor(SCALE * flat[good]).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for at, x in _integers(batch.column(0)):
            n, sums = total.get(x.shape[1], (0, np.zeros(x.shape[1], dtype=object)))
            total[x.shape[1]] = (n + len(at), sums + x.sum(axis=0).astype(object))
    rows = [(size, dim, n, Decimal(int(s))) for size, (n, sums) in total.items() for dim, s in enumerate(sums)]
    if rows:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["size", "dim", "n", "total"])


def _matrix(rows: DataFrame, size: int) -> np.ndarray:
    """Sums over all rows (dim, part), arrays of equal length, as a matrix: added up per dim, of TASKS_AT_ONCE tasks first, in any order alike."""

    def added(table: pa.Table) -> pa.Table:
        parts = np.asarray(table.column("part").combine_chunks().flatten()).reshape(table.num_rows, -1)
        total = pa.array([np.sort(parts, axis=0).sum(axis=0)], pa.list_(pa.float64()))
        return pa.table({"dim": table.column("dim").slice(0, 1), "part": total})

    schema = "dim bigint, part array<double>"
    some = rows.withColumn("some", F.floor(F.spark_partition_id() / TASKS_AT_ONCE)).groupBy("dim", "some").applyInArrow(added, schema)
    found = some.groupBy("dim").applyInArrow(added, schema).collect()
    out = np.zeros((size, len(found[0]["part"]) if found else size))
    for row in found:
        out[row["dim"]] = row["part"]
    return out


def _by_dim(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), pa.array(matrix.reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix))), parts], names=["dim", "part"])


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the unit eigenvectors as columns, of a symmetric positive semidefinite matrix."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    v = np.eye(n)
    seats = np.arange(n + n % 2)
    eps, floor = np.finfo(np.float64).eps, np.trace(a) * 1e-22
    for _ in range(MOST_SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = np.minimum(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]), np.maximum(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1])
            seats = np.r_[seats[0], seats[-1], seats[1:-1]]
            p, q = p[q < n], q[q < n]
            off = a[p, q]
            turn = np.abs(off) > np.maximum(floor, eps * np.sqrt(np.abs(a[p, p] * a[q, q])))
            if not turn.any():
                continue
            turned = True
            p, q, off = p[turn], q[turn], off[turn]
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: vec_id, component, n, deviation, whitened, explained and identity_error.

    deviation is the exact sum over dimensions of (n x - S)^2, a decimal(38,0).
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sums = cut(rows.select("embedding").mapInArrow(_sums, "size bigint, dim bigint, n bigint, total decimal(38,0)").groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    size = sums.agg(F.max_by("size", F.struct("n", "size"))).first()[0] or 0
    found = sums.where(F.col("size") == size).orderBy("dim").collect()
    n = found[0]["n"] if found else 0
    total = [int(r["total"]) for r in found]
    whole = np.array([s // n for s in total], dtype=np.int64)
    rest = np.array([s % n for s in total], dtype=np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - rest / n

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((size, size))
        for batch in batches:
            for _, x in _integers(batch.column(0), size):
                y = centred(x)
                own += y.T @ y
        yield from _by_dim(own)

    kept = "vec_id long, deviation decimal(38,0), whitened array<double>"
    values, basis = np.zeros(0), np.zeros((size, 0))
    trace = 0.0
    if n:
        matrix = _matrix(rows.select("embedding").mapInArrow(scatter, "dim bigint, part array<double>"), size) / n
        values, basis = jacobi((matrix + matrix.T) / 2)
        trace = float(np.trace(matrix))
    rank = int((values > size * np.finfo(np.float64).eps * max(values, default=0.0)).sum())
    k = min(components, rank)
    if not k:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    basis = basis[:, :k] * np.sign(basis[np.abs(basis[:, :k]).argmax(axis=0), np.arange(k)])
    sent = spark.sparkContext.broadcast(basis / np.sqrt(values[:k]))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _integers(batch.column(1), size):
                z = centred(x) @ sent.value
                apart = x - whole
                most = n * int(np.abs(apart).max()) + n
                if size * most * most < 2**63:
                    deviation = pa.array(((n * apart - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (n * apart.astype(object) - rest.astype(object)) ** 2
                    deviation = pa.array([Decimal(int(d)) for d in exact.sum(axis=1)], pa.decimal128(38, 0))
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k), pa.int32()), pa.array(np.ascontiguousarray(z).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), deviation, parts], names=["vec_id", "deviation", "whitened"])

    out = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(projected, kept))
    mean = _matrix(out.select("whitened").mapInArrow(_means(k), "dim bigint, part array<double>"), 1)[0] / n
    covariance = _matrix(out.select("whitened").mapInArrow(_products(mean), "dim bigint, part array<double>"), k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = [float(Fraction(float(e)) / Fraction(trace)) for e in values[:k]]
    each = F.posexplode(F.arrays_zip("whitened", F.array(*map(F.lit, explained)).alias("explained"))).alias("at", "one")
    return out.select("vec_id", "deviation", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("one.whitened").alias("whitened"), F.col("one.explained").alias("explained"), F.lit(error).alias("identity_error")
    )


def _numbers(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.asarray(batch.column(0).flatten()).reshape(-1, k)


def _means(k: int):
    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1, k))
        for batch in batches:
            own += _numbers(batch, k).sum(axis=0)
        yield from _by_dim(own)

    return means


def _products(mean: np.ndarray):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((len(mean), len(mean)))
        for batch in batches:
            y = _numbers(batch, len(mean)) - mean
            own += y.T @ y
        yield from _by_dim(own)

    return products
