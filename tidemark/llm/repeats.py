"""Removal of passages that repeat an earlier document, by windows of words.

A window is SIZE consecutive words of one document. A word goes if it lies in a window whose words
also stand in a document with a smaller id; windows are judged on the input.

Texts are packed into slabs of a few megabytes, kept as a table that is bucketed by slab, so that
later joins with it move no text. Then, per slab and all over the cluster:

1. A count-min sketch of two rows: each slab names the cells of its windows once, and whether
   several of its documents share the cell. Cells are dealt into blocks; a block adds up the
   sketches of all slabs and answers each with a bit per cell, whether the estimate is two or more.
   An estimate is never below the count, so no repeated window is lost. The sketch has CELLS_PER_WORD
   cells a word and row, however many words there are; it's never in one place.
2. Windows estimated repeated are grouped exactly, on keys of 128 bits: each slab names its distinct
   keys with the smallest id that has them, and a block of keys answers with the smallest id of all.
3. Each slab removes the words of windows whose smallest id is below the document's.

A window that half of all documents share is a key once a slab, so no group of keys is hot.

Defined results: null and empty texts have no words, and the hash of the empty text. Rows with a
null id keep all their words, and no other row loses a word to them. Rows that share an id are one
document to the others, and don't remove each other's words; each has a row of its own. Texts
shorter than a window lose nothing. Columns besides doc_id and text are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, cut, ready, shared_folder

SIZE = 13
CELLS_PER_WORD = 4
#: Text of a slab: it is closed by the document that reaches one of these.
SLAB_BYTES, SLAB_ROWS = 5 << 20, 1 << 16
#: Blocks of cells or keys, at least, and the most cells or keys of a block.
BLOCKS, BLOCK_CELLS, BLOCK_KEYS = 64, 1 << 25, 1 << 20
ROW_BITS = 20

SLAB = "ids array<bigint>, lengths array<bigint>, n_words bigint, texts binary"
ANSWER = "slab bigint, block bigint, answer binary"


def _packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, with bytes of equal weight next to each other."""
    width = values.dtype.itemsize
    plain = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    plain = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_words", pa.int64()), ("texts", pa.binary())])
    ids, texts, size, n_words = [], [], 0, 0

    def closed() -> pa.RecordBatch:
        plain = b"".join(texts)
        packed = len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)
        return pa.RecordBatch.from_pylist([{"ids": ids, "lengths": [len(t) for t in texts], "n_words": n_words, "texts": packed}], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(doc_id)
            texts.append(text or b"")
            size += len(texts[-1])
            n_words += len(texts[-1].split())
            if size >= SLAB_BYTES or len(ids) >= SLAB_ROWS:
                yield closed()
                ids, texts, size, n_words = [], [], 0, 0
    if ids:
        yield closed()


def _pair(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    x = b * np.uint64(by)
    x ^= a
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x


def window_keys(hashes: np.ndarray, size: int, by: int) -> np.ndarray:
    """A 64-bit key of each run of size hashes, joined from runs of powers of two."""
    runs, width, out, done = _pair(hashes, hashes, by), 1, None, 0
    while True:
        if size & width:
            out = runs if out is None else _pair(out[: len(runs) - done], runs[done:], by)
            done += width
            if done == size:
                return out
        runs, width = _pair(runs[:-width], runs[width:], by), 2 * width


class Slab:
    """Words and windows of the texts of one slab; the same whenever they are computed."""

    def __init__(self, row: dict, size: int) -> None:
        self.size, self.ids = size, row["ids"]
        ends = np.cumsum(row["lengths"]).tolist()
        plain = pa.decompress(row["texts"][8:], int.from_bytes(row["texts"][:8], "little"), codec="zstd", asbytes=True)
        self.words = [plain[end - n : end].split() for end, n in zip(ends, row["lengths"])]
        self.counts = np.array([len(ws) for ws in self.words], dtype=np.int64)

    def windows(self) -> None:
        """Sets start, own, one and two: where windows begin, their documents and keys."""
        total = int(self.counts.sum())
        if total < self.size:
            self.start = self.own = np.zeros(0, np.int64)
            self.one = self.two = np.zeros(0, np.uint64)
            return
        hashes = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for ws in self.words for w in ws]), "<u8")
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.start = np.flatnonzero(owner[: total - self.size + 1] == owner[self.size - 1 :])
        self.own = owner[self.start]
        self.one = window_keys(hashes, self.size, 0x9E3779B97F4A7C15)[self.start]
        self.two = window_keys(hashes, self.size, 0xC2B2AE3D27D4EB4F)[self.start]

    def places(self, width: int) -> np.ndarray:
        """The cells of the windows in the first row of the sketch, then those in the second."""
        return np.concatenate([self.one % np.uint64(width), np.uint64(width) + self.two % np.uint64(width)])

    def cells(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cells of the windows in order, and whether several documents have them."""
        both = np.sort((self.places(width) << np.uint64(ROW_BITS)) | np.concatenate([self.own, self.own]).astype(np.uint64))
        cells = both[_new(both)] >> np.uint64(ROW_BITS)
        at = np.flatnonzero(_new(cells))
        return cells[at], np.diff(np.r_[at, len(cells)]) > 1

    def keys(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows marked repeated, in documents with an id: their places, which key each has, and the distinct keys with their least ids."""
        id_ = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        known = np.array([i is not None for i in self.ids], dtype=bool)
        at = np.flatnonzero(repeated & known[self.own])
        one, two, ids = self.one[at], self.two[at], id_[self.own[at]]
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(at) else np.zeros(0, bool)
        return at[order], np.cumsum(new) - 1, one[new], two[new], ids[new]


def _new(sorted_: np.ndarray) -> np.ndarray:
    """Where another value begins."""
    return np.r_[True, sorted_[1:] != sorted_[:-1]] if len(sorted_) else np.zeros(0, dtype=bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _block_cuts(sorted_: np.ndarray, blocks: int, span: int) -> np.ndarray:
    return np.searchsorted(sorted_, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(span))


def _key_cuts(one: np.ndarray, blocks: int) -> np.ndarray:
    of = ((one >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(blocks + 1))


def repeated_words(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256, the hash of the words that stay, joined by spaces."""
    spark = docs.sparkSession
    ready(spark)
    folder = shared_folder(spark).rstrip("/")
    name = f"slabs_{uuid.uuid4().hex}"
    slabs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_slabs, SLAB).withColumn("slab", F.monotonically_increasing_id())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slabs.write.format("parquet").bucketBy(buckets, "slab").option("path", f"{folder}/{name}").saveAsTable(name)
    try:
        return _removed(spark.table(name), size)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files stay, as those of checkpoints do


def _removed(slabs: DataFrame, size: int) -> DataFrame:
    n_words = slabs.agg(F.sum("n_words")).first()[0] or 0
    width = max(1024, CELLS_PER_WORD * n_words)
    blocks = max(BLOCKS, -(-2 * width // BLOCK_CELLS))
    span = -(-2 * width // blocks)
    key_blocks = max(BLOCKS, -(-n_words // BLOCK_KEYS))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            slab = Slab(row, size)
            slab.windows()
            cells, several = slab.cells(width)
            cuts = _block_cuts(cells, blocks, span)
            out = []
            for block in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                part = slice(cuts[block], cuts[block + 1])
                steps = np.diff(cells[part], prepend=np.uint64(block * span)).astype(np.uint32)
                out.append((row["slab"], block, _packed(steps), np.packbits(several[part]).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["slab", "block", "cells", "several"])

    def summed(table: pa.Table) -> pa.Table:
        counts = np.zeros(span, dtype=np.uint8)
        rows = []
        for steps, several in zip(table.column("cells").to_pylist(), table.column("several").to_pylist()):
            cells = np.cumsum(_unpacked(steps, "<u4"), dtype=np.int64)
            rows.append(cells)
            counts[cells] = np.minimum(2, counts[cells] + 1 + np.unpackbits(np.frombuffer(several, np.uint8), count=len(cells)))
        answers = [np.packbits(counts[cells] >= 2).tobytes() for cells in rows]
        return pa.table({"slab": table.column("slab"), "block": table.column("block"), "answer": pa.array(answers, pa.binary())})

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            slab = Slab(row, size)
            slab.windows()
            every = slab.places(width)
            order = np.argsort(every)
            new = _new(every[order])
            cells = every[order][new]
            cuts = _block_cuts(cells, blocks, span)
            twice = np.zeros(len(cells), dtype=bool)
            for a in row["answers"]:
                part = slice(cuts[a["block"]], cuts[a["block"] + 1])
                twice[part] = np.unpackbits(np.frombuffer(a["answer"], np.uint8), count=part.stop - part.start)
            found = np.empty(len(every), dtype=bool)
            found[order] = twice[np.cumsum(new) - 1]
            repeated = found[: len(slab.one)] & found[len(slab.one) :]
            _, _, one, two, ids = slab.keys(repeated)
            cuts = _key_cuts(one, key_blocks)
            out = [(row["slab"], -1 - row["slab"] % BLOCKS, np.packbits(repeated).tobytes(), None, None)]
            for block in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                part = slice(cuts[block], cuts[block + 1])
                out.append((row["slab"], block, _packed(one[part]), _packed(two[part]), _packed(ids[part])))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["slab", "block", "one", "two", "ids"])

    def least(table: pa.Table) -> pa.Table:
        ones = table.column("one").to_pylist()
        if table.column("block")[0].as_py() < 0:
            return pa.table({"slab": table.column("slab"), "block": table.column("block"), "answer": pa.array(ones, pa.binary())})
        parts = [_unpacked(x, "<u8") for x in ones]
        one = np.concatenate(parts)
        two, ids = (np.concatenate([_unpacked(x, t) for x in table.column(c).to_pylist()]) for c, t in (("two", "<u8"), ("ids", "<i8")))
        order = np.lexsort((ids, two, one))
        one, two = one[order], two[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        first = np.empty_like(ids)
        first[order] = ids[order][new][np.cumsum(new) - 1]
        ends = np.cumsum([len(p) for p in parts])
        answers = [_packed(first[end - len(p) : end]) for end, p in zip(ends, parts)]
        return pa.table({"slab": table.column("slab"), "block": table.column("block"), "answer": pa.array(answers, pa.binary())})

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            slab = Slab(row, size)
            covered = np.zeros(int(slab.counts.sum()) + 1, dtype=np.int64)
            answers = {a["block"]: a["answer"] for a in row["answers"] or ()}
            if any(block >= 0 for block in answers):
                slab.windows()
                marks = next(answer for block, answer in answers.items() if block < 0)
                at, which, one, _, _ = slab.keys(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(slab.one)).astype(bool))
                cuts = _key_cuts(one, key_blocks)
                first = np.concatenate([_unpacked(answers[b], "<i8") for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()])
                own = np.array([0 if i is None else i for i in slab.ids], dtype=np.int64)[slab.own[at]]
                gone = slab.start[at[first[which] < own]]
                np.add.at(covered, gone, 1)
                np.add.at(covered, gone + size, -1)
            drop = np.cumsum(covered)[:-1] > 0
            ends = np.cumsum(slab.counts)
            removed = np.r_[0, np.cumsum(drop)][ends] - np.r_[0, np.cumsum(drop)][ends - slab.counts]
            digests = []
            for ws, end, n in zip(slab.words, ends.tolist(), removed.tolist()):
                kept = ws if not n else [w for w, d in zip(ws, drop[end - len(ws) : end].tolist()) if not d]
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slab.ids, pa.int64()), pa.array(slab.counts), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    def by_slab(answers: DataFrame) -> DataFrame:
        return answers.groupBy("slab").agg(F.collect_list(F.struct("block", "answer")).alias("answers"))

    texts = slabs.select("slab", "ids", "lengths", "texts")
    with arrow_rows(slabs.sparkSession, 4):
        cells = slabs.where("n_words > 0").select(*texts.columns).mapInArrow(sketches, "slab bigint, block bigint, cells binary, several binary")
        repeated = by_slab(cells.groupBy("block").applyInArrow(summed, ANSWER))
        keys = texts.join(repeated, "slab").mapInArrow(asked, "slab bigint, block bigint, one binary, two binary, ids binary")
        firsts = by_slab(keys.groupBy("block").applyInArrow(least, ANSWER))
        return cut(texts.join(firsts, "slab", "left").mapInArrow(judged, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))
