"""Packing of documents into sequences of a fixed length, from the histogram of lengths.

Documents are tokenized and cut into pieces of at most max_len tokens. Only the histogram of piece
lengths, at most max_len rows, reaches the driver. There, lengths are rounded up to bins, all
patterns of up to three pieces that fill a sequence of bins are enumerated, and non-negative least
squares fit how often each is used to the histogram. The fitted counts are rounded down and
realised with true lengths; what is left over, small pieces mostly, is packed by best fit, largest
first, into the gaps of those sequences and into new ones. The result is a table of runs: so many
pieces of one length, by rank, go to so many sequences from one number on, at one offset. Its
number of rows depends on max_len and not on the number of documents. Ranks of pieces are given by
Spark, in ranges of hashed keys so that no length is counted in one task, and pieces meet their
runs in a join.

Defined results: a null or empty text has the one id END and is packed; an empty table gives an
empty result; rows with equal ids are packed each on its own; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut, ready
from tidemark.llm.word_bpe import word_bpe

MAX_LEN = 4096
#: The id that ends every document.
END = 1
#: Bins of lengths when patterns are enumerated; finer bins waste less of a sequence and fit longer.
BINS = 512
#: Pieces of one length that are ranked in one group.
RANK_ROWS = 50_000
#: Documents in an Arrow batch.
BATCH_ROWS = 2000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, first long, count long, per int, sequence long, offset long"


def pieces(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length and ids_crc32."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    ready(docs.sparkSession)
    end = np.array([END], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * max_len):
                    part = ids[at : at + 4 * max_len]
                    for column, value in zip(rows, (doc_id, at // (4 * max_len), at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES)


def patterns(bins: int) -> np.ndarray:
    """All ways to write bins as a sum of one to three sizes, largest first; 0 stands for none."""
    found = [(bins, 0, 0)]
    for a in range(bins - 1, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            c = bins - a - b
            if c <= b:
                found.append((a, b, c))
    return np.array(found, dtype=np.int64)


def fit(counts: np.ndarray, ways: np.ndarray, weight: np.ndarray, most: int = 2000) -> np.ndarray:
    """Non-negative x with pattern usage A x near counts, by the active-set method of Lawson and Hanson.

    counts[i] is how many pieces have size i; A[i, p] how often pattern p uses size i.
    """
    size = len(counts)
    scale = max(1.0, float(counts.max(initial=0)))
    goal = weight * counts / scale

    def column(p: int) -> np.ndarray:
        out = np.zeros(size)
        np.add.at(out, ways[p], 1.0)
        out[0] = 0.0
        return out * weight

    x, active, matrix = np.zeros(len(ways)), [], np.zeros((size, 0))
    rest = goal.copy()
    padded = weight.copy()
    padded[0] = 0.0
    for _ in range(most):
        slope = (padded * rest)[ways].sum(1)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9:
            break
        active.append(best)
        matrix = np.column_stack([matrix, column(best)])
        while active:
            solved = np.linalg.lstsq(matrix, goal, rcond=None)[0] if len(active) < 2 else _normal(matrix, goal)
            if (solved > 1e-12).all():
                break
            now = x[active]
            low = solved <= 1e-12
            step = np.min(now[low] / np.maximum(now[low] - solved[low], 1e-300))
            now = now + step * (solved - now)
            keep = now > 1e-12
            keep[low & (now <= 1e-9)] = False
            x[active] = now
            for p, k in zip(active, keep, strict=True):
                if not k:
                    x[p] = 0.0
            active = [p for p, k in zip(active, keep, strict=True) if k]
            matrix = matrix[:, keep]
            solved = np.zeros(0)
        x[:] = 0.0
        if active:
            x[active] = solved
            rest = goal - matrix @ solved
        else:
            rest = goal.copy()
    return x * scale


def _normal(matrix: np.ndarray, goal: np.ndarray) -> np.ndarray:
    square = matrix.T @ matrix
    square[np.diag_indices_from(square)] += 1e-10
    return np.linalg.solve(square, matrix.T @ goal)


class Plan:
    """Runs of pieces by length and rank, and the sequences they go to."""

    def __init__(self, counts: dict[int, int], max_len: int):
        self.left = dict(counts)
        self.used: dict[int, int] = defaultdict(int)
        self.max_len = max_len
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _run(self, length: int, count: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, per, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def open(self, lengths: tuple[int, ...], count: int) -> None:
        """count new sequences, each with pieces of these lengths."""
        offset = 0
        for length in lengths:
            self._run(length, count, 1, self.sequences, offset)
            offset += length
        self._gap(self.max_len - offset, self.sequences, count)
        self.sequences += count

    def _gap(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self.gaps[gap].append((first, count))

    def best_fit(self) -> None:
        """Packs all that is left, largest first, each into the smallest gap that holds it."""
        for length in sorted((k for k, n in self.left.items() if n), reverse=True):
            while n := self.left[length]:
                fits = [g for g, found in self.gaps.items() if g >= length and found]
                if not fits:
                    per = self.max_len // length
                    whole, odd = divmod(n, per)
                    if whole:
                        self._run(length, whole * per, per, self.sequences, 0)
                        self._gap(self.max_len - per * length, self.sequences, whole)
                        self.sequences += whole
                    if odd:
                        self._run(length, odd, odd, self.sequences, 0)
                        self._gap(self.max_len - odd * length, self.sequences, 1)
                        self.sequences += 1
                    continue
                gap = min(fits)
                first, count = self.gaps[gap].pop()
                per = min(gap // length, -(-n // count))
                taken = min(count, n // per)
                self._run(length, taken * per, per, first, self.max_len - gap)
                self._gap(gap - per * length, first, taken)
                self._gap(gap, first + taken, count - taken)


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> Plan:
    """Places counts[length] pieces of each length."""
    made = Plan(counts, max_len)
    if made.left.get(max_len):
        made.open((max_len,), made.left[max_len])
    bins = min(BINS, max_len)
    width = -(-max_len // bins)
    bins = -(-max_len // width)
    histogram = np.zeros(bins + 1)
    by_bin: dict[int, list[int]] = defaultdict(list)
    for length in sorted(n for n, c in made.left.items() if c):
        histogram[-(-length // width)] += made.left[length]
        by_bin[-(-length // width)].append(length)
    ways = patterns(bins)
    # A long piece that is left over costs a sequence; short ones fill gaps.
    weight = np.clip(np.arange(bins + 1) / (bins / 8), 0.05, 1.0)
    used = np.floor(fit(histogram, ways, weight) + 1e-6).astype(np.int64)

    def take(size: int, most: int, longest: bool) -> tuple[int, int]:
        """A length of this bin that is left and up to most of it."""
        lengths = by_bin[size]
        while lengths and not made.left[lengths[-1 if longest else 0]]:
            lengths.pop(-1 if longest else 0)
        if not lengths:
            return 0, 0
        length = lengths[-1 if longest else 0]
        return length, min(most, made.left[length])

    for p in np.flatnonzero(used):
        wanted = int(used[p])
        sizes = [int(s) for s in ways[p] if s]
        while wanted:
            chosen = [take(s, wanted, i % 2 == 0) for i, s in enumerate(sizes)]
            # One length may stand twice in a pattern and then lasts half as long.
            count = min(min(c, made.left[length] // sum(other == length for other, _ in chosen)) if length else 0 for length, c in chosen)
            if not count:
                break
            made.open(tuple(length for length, _ in chosen), count)
            wanted -= count
    made.best_fit()
    return made


def pack(docs: DataFrame, path: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        table = cut(pieces(docs, path, max_len))
    # At most max_len rows.
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    runs = spark.createDataFrame(plan(counts, max_len).runs, RUNS)
    groups = spark.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in counts.items()] or [], "length long, groups long")
    key = F.xxhash64("doc_id", "piece", "start")
    dealt = table.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(key, F.col("groups")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(sums, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # At most max_len lengths, each with few runs; see RUNS.
    placed = ranked.join(
        F.broadcast(runs.withColumnRenamed("length", "run_length").withColumnRenamed("offset", "at")),
        (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")),
    )
    place = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("per").cast("long")) * F.col("length")).cast("long").alias("offset"),
    )
