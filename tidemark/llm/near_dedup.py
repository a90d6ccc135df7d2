"""Near-duplicate groups of documents by HyperMinHash sketches.

A text's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets are
one class at once, by a 128-bit key. Each class has a sketch: a hash of every shingle falls into
one of BUCKETS buckets by its leading bits, and a bucket keeps the smallest of the rest as a
register of 16 bits, 6 for the count of leading zeros and 10 for the bits after the first one. An
empty bucket borrows from the first full one in an order of its own, which keeps the chance that
two registers agree at the Jaccard similarity. Bands of four registers propose candidates: at a
similarity of 0.8, all 32 bands differ with a chance under 1e-7. A candidate's similarity is
estimated from the agreeing registers, less those that agree by chance, and a pair far below the
threshold (five standard errors) goes; the rest is confirmed on the full sets.

Groups of copies are linked without all their pairs. In each of ROUNDS rounds every band's bucket
has one leader, and members of other components are held against it; of its leaders, the one that
seems most like a member is compared with it, and components then grow by what was confirmed. At last, in each bucket that still holds several components, the members
outside its largest component are compared with all members of other components, so that no link
between components goes untested: in cells that are dealt over tasks, where full sets are confirmed too.

Nodes of the graph are sets, not ids. groups() links the sets of rows that share an id, as one
document; keep_one() doesn't, so that a text goes only if a like one stays.

Defined results: null and empty texts and texts without words have an empty set, n_shingles 0, and
are linked with nothing. Very long texts are taken whole; a set is a row of its shingles, of which a task
of the last round holds HELD_SHINGLES and one set at most. Fewer words than a shingle make one shingle of the whole sequence. Rows
with a null id are linked with nothing and kept. Columns besides doc_id and text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, ascii_lower, cut, let, lookup, packed, ready, words
from tidemark.llm.components import components

BUCKETS = 128
BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND = 4
ROUNDS = 3
PERCENT = 80
#: Sets in an Arrow batch; rows of bands, of sketches and of sets in a task, so that small tables are few tasks.
BATCH_ROWS = 2000
#: Rows in an Arrow batch that has both a set and names, and pairs of members that are compared at once.
FULL_ROWS, PAIRS_HELD = 200, 1 << 17
BAND_ROWS, SKETCH_ROWS, SET_ROWS = 100_000, 20_000, 4_000
#: Nodes whose sets meet that of their lead in a part.
LED_ROWS = 1024
#: Left and right members whose sketches meet in one task of the last round, and shingles of the left sets that are held at once when full sets meet.
BLOCK, PIECE = 8192, 65536
HELD_SHINGLES = 2 << 20
CELL = ["band", "scale", "block", "piece"]
PART = [*CELL, "part"]
#: Estimates this far below the threshold are not confirmed: five standard errors at 128 buckets, a chance of 3e-7 at the threshold.
MARGIN = 5 * (0.8 * 0.2 / BUCKETS) ** 0.5


def shingles(text: Column, size: int) -> Column:
    """Distinct hashes of the runs of size words, in ascending order."""

    def of(ws: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)])
        )
        return (
            F.when(F.size(ws) >= size, F.sort_array(F.array_distinct(runs)))
            .when(F.size(ws) > 0, F.array(F.xxhash64(F.size(ws), ws)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words(ascii_lower(text)), of)


@lru_cache
def _orders() -> np.ndarray:
    """For each bucket, the order in which it asks the others when it is empty."""
    draw = np.random.default_rng(20240229)
    return np.stack([draw.permutation(BUCKETS) for _ in range(BUCKETS)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def registers(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint16 registers of many sets, a row each; ends has where each set ends in values. No set is empty."""
    sets = len(ends)
    hashed = _mixed(values.astype(np.uint64))
    owner = np.repeat(np.arange(sets, dtype=np.uint64), np.diff(ends, prepend=0))
    slot = (owner << np.uint64(BUCKET_BITS)) | (hashed >> np.uint64(64 - BUCKET_BITS))
    rest = hashed << np.uint64(BUCKET_BITS)
    least = np.full(sets * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, slot.astype(np.int64), rest)
    full = np.zeros(sets * BUCKETS, dtype=bool)
    full[slot.astype(np.int64)] = True
    exponent = 64 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1] - 11
    zeros = np.minimum(exponent, 53).astype(np.uint64)
    mantissa = ((least << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    packed = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16).reshape(sets, BUCKETS)
    full = full.reshape(sets, BUCKETS)
    empty_row, empty_bucket = np.nonzero(~full)
    orders = _orders()
    for step in range(BUCKETS):
        if not len(empty_row):
            break
        donor = orders[empty_bucket, step]
        found = full[empty_row, donor]
        packed[empty_row[found], empty_bucket[found]] = packed[empty_row[found], donor[found]]
        empty_row, empty_bucket = empty_row[~found], empty_bucket[~found]
    return packed


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = part.column(part.schema.get_field_index("shingles"))
            sizes = np.diff(np.asarray(sets.offsets))
            ends = np.cumsum(sizes[sizes > 0])
            rows = iter(registers(np.asarray(sets.flatten()), ends) if len(ends) else ())
            sketches = [next(rows).tobytes() if n else None for n in sizes]
            keep = [part.column(i) for i, name in enumerate(part.schema.names) if name != "shingles"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sketches, pa.binary())], names=[*(n for n in part.schema.names if n != "shingles"), "sketch"])


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, the 128-bit key of the set in two columns, and the sketch, null if empty."""
    ready(docs.sparkSession)
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), shingles(F.col("text"), size).alias("shingles"))
    keyed = sets.select(
        "doc_id",
        "mark",
        F.size("shingles").cast("long").alias("n_shingles"),
        F.xxhash64("shingles").alias("key1"),
        F.xxhash64(F.lit(7), "shingles").alias("key2"),
        "shingles",
    )
    return keyed.mapInArrow(_sketch, "doc_id long, mark long, n_shingles long, key1 long, key2 long, sketch binary")


@lru_cache
def chance() -> list[float]:
    """By the binary logarithm of a set's size, how often registers of unlike sets agree."""
    zeros, mantissa = np.meshgrid(np.arange(54), np.arange(1 << MANTISSA_BITS), indexing="ij")
    low = 2.0 ** -(zeros + 1.0) * (1 + mantissa / (1 << MANTISSA_BITS))
    high = 2.0 ** -(zeros + 1.0) * (1 + (mantissa + 1) / (1 << MANTISSA_BITS))
    found = []
    for power in range(40):
        load = max(1.0, 2.0**power / BUCKETS)
        cell = np.exp(load * np.log1p(-np.minimum(low, 1 - 1e-12))) - np.exp(load * np.log1p(-np.minimum(high, 1 - 1e-12)))
        found.append(float((cell**2).sum()))
    return found


def estimate(a: Column, b: Column, n: Column) -> Column:
    """Jaccard similarity from two sketches, corrected for registers that agree by chance."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2))))
    luck = F.element_at(F.array(*map(F.lit, chance())), F.least(F.lit(40), F.floor(F.log2(n.cast("double"))) + 1).cast("int"))
    return (same / BUCKETS - luck) / (1 - luck)


def _best(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (node, lead), each node's lead that seems most like it, if that may be similar enough; links with others are left to later rounds."""
    side = classes.select("node", "n_shingles", "sketch")
    met = pairs.join(side.toDF("node", "na", "ka"), "node").join(side.toDF("lead", "nb", "kb"), "lead").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    likely = met.select("node", "lead", estimate(F.col("ka"), F.col("kb"), F.greatest("na", "nb")).alias("like")).where(F.col("like") >= PERCENT / 100 - MARGIN)
    return likely.groupBy("node").agg(F.max_by("lead", F.struct("like", "lead")).alias("lead"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges u, v: of pairs (node, lead), those whose full sets are similar enough.

    A node's set goes to its lead once. A lead of many nodes has them dealt into parts of LED_ROWS, to each of which its set goes.
    """
    loads = lookup(cut(pairs.groupBy("lead").agg(F.ceil(F.count("*") / LED_ROWS).alias("parts"))))
    dealt = lookup(cut(pairs.join(loads, "lead").select("node", "lead", F.pmod(F.xxhash64("node", F.lit(17)), F.col("parts")).alias("part"))))
    led = sets.join(dealt, "node").select("lead", "part", F.col("node").alias("u"), F.col("set").alias("su"))
    leads = sets.toDF("lead", "sv").join(loads, "lead").select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "sv")
    common = led.join(leads, ["lead", "part"]).select("u", F.col("lead").alias("v"), F.size(F.array_intersect("su", "sv")).alias("both"), (F.size("su") + F.size("sv")).alias("sum"))
    return common.where(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both"))).select("u", "v")


def _one_document(rows: DataFrame) -> DataFrame:
    """Edges u, v from the least set of each id to its other sets."""
    least = cut(rows.groupBy("doc_id").agg(F.min("key1").alias("u"), F.max("key1").alias("most")).where("u < most").select("doc_id", "u"))
    return rows.join(lookup(least), "doc_id").where("key1 != u").select("u", F.col("key1").alias("v")).distinct()


def _members(classes: DataFrame) -> DataFrame:
    """band and node of the bands that several nodes share. A band's low bits are its number.

    Rows meet their neighbours in the order of bands, so that bands are shuffled once and not counted first.
    """
    width, bands = 2 * BAND, BUCKETS // BAND
    rows = classes.select("node", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("i"), "sketch").select(
        "node", F.xxhash64("i", F.substring("sketch", F.col("i") * width + 1, F.lit(width))).bitwiseAND(-bands).bitwiseOR(F.col("i").cast("long")).alias("band")
    )
    order = Window.partitionBy("band").orderBy("node")
    return rows.select("band", "node", F.lag("node").over(order).alias("_low"), F.lead("node").over(order).alias("_high")).where("_low < node OR _high > node").select("band", "node")


def _open(members: DataFrame, tree: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The members with their components' roots, and the bands of several components with the leader of this turn."""
    roots = tree.select(F.col("u").alias("node"), F.col("v").alias("root"))
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_hash = F.xxhash64("node", F.lit(turn))
    lead = [F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("node", by_hash).alias("lead"), F.min_by("root", by_hash).alias("lead_root")]
    return placed, placed.groupBy("band").agg(*lead).where("r0 < r1")


def _linked(docs: DataFrame, size: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and per set (key1, key2, n_shingles) the first row, as struct of doc_id and mark, of its component.

    A set's node is key1. by_id says whether rows that share an id are linked.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        table = cut(sketched(docs, size))
    rows = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = rows.groupBy("key1", "key2", "n_shingles").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.first("sketch").alias("sketch"))
    classes = packed(cut(grouped.withColumn("node", F.col("key1"))), SKETCH_ROWS)
    members = packed(cut(_members(classes)), BAND_ROWS)
    active = lookup(cut(members.select("node").distinct()))
    chosen = packed(cut(classes.join(active, "node", "left_semi").select("node", "n_shingles", "sketch", "row")), SKETCH_ROWS)
    ids = lookup(chosen.select("node", F.col("row.doc_id").alias("doc_id"), F.col("row.mark").alias("mark")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sets = cut(texts.join(ids, ["doc_id", "mark"]).select("node", shingles(F.col("text"), size).alias("set")))
    if sets.count() > chosen.count():  # rows that repeat id and text
        sets = cut(sets.dropDuplicates(["node"]))
    sets = packed(sets, SET_ROWS)
    none = chosen.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    tree = components(_one_document(rows)).toDF("u", "v") if by_id else cut(none)
    tested = cut(none).toDF("node", "lead")
    for turn in range(ROUNDS):
        placed, open_ = _open(members, tree, turn)
        found = placed.join(open_, "band").where("root != lead_root").select("node", "lead")
        pairs = packed(cut(found.distinct().join(tested, ["node", "lead"], "left_anti")), BAND_ROWS)
        best = packed(cut(_best(pairs, chosen)), BAND_ROWS)
        if best.limit(1).count():
            tree = components(tree.unionByName(_confirmed(best, sets))).toDF("u", "v")
            tested = tested.unionByName(best)
    placed, open_ = _open(members, tree, ROUNDS)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        near = packed(cut(_rest(placed.join(open_.select("band"), "band").join(chosen.select("node", "n_shingles", "sketch"), "node"))), SKETCH_ROWS)
    with arrow_rows(docs.sparkSession, FULL_ROWS):
        edges = cut(_within_cells(near, chosen, sets))
    if edges.limit(1).count():
        tree = components(tree.unionByName(edges)).toDF("u", "v")
    joined = tree.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tree.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    placed = classes.select("key1", "key2", "n_shingles", "row", "node").join(joined, "node", "left")
    first = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("row").alias("first"))
    known = placed.join(first, "root", "left").select("key1", "key2", "n_shingles", F.coalesce("first", "row").alias("first"))
    return table, known


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cell's right members with the left ones that may be similar to each, as names, from rows sorted by cell with the left ones first.

    Left members that are named are rows too, without names, some more than once. Holds the left members of
    one cell, at most about BLOCK, a batch of right ones and about PAIRS_HELD pairs at most.
    """
    cell, left = None, []
    luck = np.asarray(chance())
    for batch in batches:
        col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        cells = np.stack([np.asarray(col[name]) for name in CELL], axis=1)
        start = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)]) if len(cells) else []
        main, side = (np.asarray(col[name].cast(pa.int8())) for name in ("main", "side"))
        node, root, size = (np.asarray(col[name]) for name in ("node", "root", "n_shingles"))
        at = cells[:, 0] & (BUCKETS // BAND - 1)  # the number of the band
        sketch = np.frombuffer(b"".join(col["sketch"].to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
        for begin, end in zip(start, [*start[1:], len(cells)]):
            if (key := tuple(cells[begin])) != cell:
                cell, left = key, []
            middle = begin + int((side[begin:end] == 0).sum())
            if middle > begin:
                left.append([x[begin:middle] for x in (node, root, size, sketch)])
            if middle == end or not left:
                continue
            a, ra, na, ka = (np.concatenate(x) for x in zip(*left))
            left = [[a, ra, na, ka]]
            named, step = np.zeros(len(a), dtype=bool), max(1, PAIRS_HELD // len(a))
            for low in range(middle, end, step):
                part = slice(low, min(end, low + step))
                small, large = np.minimum(na[:, None], size[part]), np.maximum(na[:, None], size[part])
                meet = (ra[:, None] != root[part]) & (100 * small >= PERCENT * large) & ((main[part] == 1) | (a[:, None] < node[part]))
                x, y = np.nonzero(meet)
                found = []
                for k in range(0, len(x), 8192):
                    u, v = x[k : k + 8192], y[k : k + 8192] + low
                    same = ka[u] == sketch[v]
                    by_chance = luck[np.minimum(len(luck), np.floor(np.log2(np.maximum(na[u], size[v]))).astype(int) + 1) - 1]
                    near = (same.mean(axis=1) - by_chance) / (1 - by_chance) >= PERCENT / 100 - MARGIN
                    first = same[near].reshape(-1, BUCKETS // BAND, BAND).all(axis=2).argmax(axis=1) == at[v[near]]
                    found.append((v[near][first], u[near][first]))
                if not sum(len(v) for v, _ in found):
                    continue
                right, names = (np.concatenate(x) for x in zip(*found))
                new = np.setdiff1d(names, np.flatnonzero(named))
                named[new] = True
                if len(new):
                    yield _rows(cells[np.full(len(new), begin)], a[new], pa.nulls(len(new), pa.list_(pa.int64())))
                order = np.argsort(right, kind="stable")
                right, names = right[order], a[names[order]]
                new = np.flatnonzero(np.r_[True, right[1:] != right[:-1]])
                yield _rows(cells[right[new]], node[right[new]], pa.ListArray.from_arrays(pa.array(np.r_[new, len(right)], pa.int32()), pa.array(names)))


def _rows(cells: np.ndarray, node: np.ndarray, names: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cells.T), pa.array(node), names], names=[*CELL, "node", "names"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges u, v between the left sets of a part of a cell and the right ones, which name those to compare and come after them."""
    part, left = None, {}
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(k)) for k in range(len(PART))], axis=1)
        node, names, sets = (batch.column(len(PART) + k) for k in range(3))
        found = []
        for row in range(batch.num_rows):
            if (key := tuple(keys[row])) != part:
                part, left = key, {}
            mine, own = node[row].as_py(), np.asarray(sets[row].values)
            if not names[row].is_valid:
                left[mine] = own.copy()  # a view would keep the whole batch
                continue
            for other in names[row].as_py():
                both = int((own[np.minimum(np.searchsorted(own, left[other]), len(own) - 1)] == left[other]).sum())
                if 100 * both >= PERCENT * (len(left[other]) + len(own) - both):
                    found.append((other, mine))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])


def _within_cells(near: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges u, v of the right members of near and those of their names whose full sets are similar enough; near is what _likely() gives.

    A cell's left sets are dealt into parts of about HELD_SHINGLES together. A set goes to each part that
    needs it once, not with each of its pairs: a part's left sets are held, and each right set
    comes by with the names of those to compare it with.
    """
    sizes = classes.select("node", "n_shingles")
    lefts = cut(near.where("names IS NULL").select(*CELL, "node").distinct().join(sizes, "node"))
    loads = lefts.groupBy(*CELL).agg(F.ceil(F.sum("n_shingles") / HELD_SHINGLES).alias("parts"))

    def part_of(node: Column) -> Column:
        return F.pmod(F.xxhash64(node, F.lit(13)), F.col("parts"))

    held = lefts.join(loads, CELL).select(*CELL, part_of(F.col("node")).alias("part"), "node", F.lit(None).cast("array<bigint>").alias("names"))
    spread = near.where("names IS NOT NULL").join(loads, CELL).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    spread = spread.withColumn("names", F.when(F.col("parts") == 1, F.col("names")).otherwise(F.filter("names", lambda n: part_of(n) == F.col("part")))).where(F.size("names") > 0)
    met = lookup(cut(near.select("node").distinct()))  # sets of no likely pair aren't shuffled
    rows = held.unionByName(spread.select(*PART, "node", "names")).join(sets.join(met, "node", "left_semi"), "node").select(*PART, "node", "names", "set")
    return rows.repartition(*PART).sortWithinPartitions(*PART, F.col("names").isNotNull()).mapInArrow(_alike, "u long, v long")


def _rest(members: DataFrame) -> DataFrame:
    """Cells, nodes and names of the members (band, node, root, n_shingles, sketch) of a bucket that may be similar to others, which names lists, of other components.

    Not both are of the bucket's largest component. Sizes within the threshold differ by at most
    one class of a logarithmic scale, so only those of neighbouring classes meet: the members
    outside the largest component are the left side of up to three cells, all members the right
    side of one. A cell is dealt into blocks of its left and pieces of its right side, so that no task
    takes a whole bucket, and sketches are compared there: a pair whose estimate is too low is
    never a row. A pair that meets in several buckets comes from the first band that agrees.
    """
    scale = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100 / PERCENT + 1e-4)))
    sized = members.withColumn("scale", scale)
    most = members.groupBy("band", "root").count().groupBy("band").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    sized = packed(cut(sized.join(most, "band").withColumn("main", F.col("root") == F.col("most")).drop("most")), SKETCH_ROWS)
    left = sized.where("NOT main").withColumn("scale", F.explode(F.array(*[F.col("scale") + k for k in (-1, 0, 1)])))
    cells = (
        left.groupBy("band", "scale").agg(F.count("*").alias("lefts"))
        .join(sized.groupBy("band", "scale").agg(F.count("*").alias("rights")), ["band", "scale"])
        .select("band", "scale", F.ceil(F.col("lefts") / BLOCK).alias("blocks"), F.ceil(F.col("rights") / PIECE).alias("pieces"))
    )
    cells = cut(cells)

    def dealt(side: DataFrame, own: str, every: str, rank: int) -> DataFrame:
        rows = side.join(cells, ["band", "scale"]).withColumn(own, F.pmod(F.xxhash64("node", F.lit(11)), F.col(f"{own}s")))
        rows = rows.withColumn(every, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{every}s") - 1)))
        return rows.withColumn("side", F.lit(rank)).select(
            *CELL, "side", "node", "root", "n_shingles", "main", "sketch"
        )

    both = dealt(left, "block", "piece", 0).unionByName(dealt(sized, "piece", "block", 1))
    return both.repartition(*CELL).sortWithinPartitions(*CELL, "side").mapInArrow(_likely, ", ".join([*(f"{c} long" for c in [*CELL, "node"]), "names array<bigint>"]))


def groups(docs: DataFrame, size: int = 5) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id and kept.

    Rows that share an id are one document: what any of their sets is linked with is in its component.
    """
    table, known = _linked(docs, size, by_id=True)
    out = table.select("doc_id", "n_shingles", "key1", "key2").join(known, ["key1", "key2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("first.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs with one row of each group of like texts, that with the smallest id; its columns are those of docs.

    A row goes only if a row with a like text stays. Rows that share an id but no like text all
    stay; of rows with equal ids and texts, one does.
    """
    table, known = _linked(docs, size, by_id=False)
    rows = cut(
        table.where("doc_id IS NOT NULL")
        .join(known, ["key1", "key2", "n_shingles"], "left")
        .groupBy("doc_id", "mark")
        .agg(F.count("*").alias("rows"), F.min("first").alias("first"))
    )
    own = F.struct("doc_id", "mark")
    gone = lookup(cut(rows.where(F.coalesce(F.col("first") != own, F.lit(False))).select("doc_id", "mark")).toDF("_id", "_mark"))
    repeated = lookup(cut(rows.where(F.coalesce(F.col("first") == own, F.lit(True)) & (F.col("rows") > 1)).select("doc_id", "mark")).toDF("_id", "_mark"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    left = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_mark")).join(gone, ["_id", "_mark"], "left_anti")
    once = left.join(repeated, ["_id", "_mark"], "left_anti").select("_row.*")
    many = left.join(repeated, ["_id", "_mark"], "left_semi").groupBy("_id", "_mark").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return once.unionByName(many)
