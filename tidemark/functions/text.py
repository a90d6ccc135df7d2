"""Text functions: cleaning, chunk bounds and evidence. Those in Python are small and row-local."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import mentions


def normalized(text: Column) -> Column:
    """No-break spaces made plain, zero-width ones removed, blanks collapsed, at most one empty line in a row."""
    clean = F.translate(text, " ​", " ")
    lines = F.transform(F.split(clean, "\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"^\s+|\s+$", ""))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


class _Separators:
    """Places of blank lines, line ends and spaces of a text, found once."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lines = np.flatnonzero(codes == 10)
        blank = lines[:-1][np.diff(lines) == 1]
        self.kinds = ((blank, 2), (lines, 1), (np.flatnonzero(codes == 32), 1))

    def last_within(self, low: int, high: int) -> int | None:
        """The last place from low on of the best kind that has one that ends by high."""
        for places, width in self.kinds:
            k = int(np.searchsorted(places, high - width, side="right")) - 1
            if k >= 0 and places[k] >= low:
                return int(places[k])
        return None


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of chunks, cut at the last blank line, line end or space in their second half; the next begins overlap before.

    The chunks are a fold over the places of separators: each is decided by the end of the one before.
    """
    if not text:
        return []
    separators, bounds = _Separators(text), [(0, 0)]
    shortest = max(size // 2, overlap + 1)
    while bounds[-1][1] < len(text):
        first = max(0, bounds[-1][1] - overlap)
        if len(text) - first <= size:
            bounds.append((first, len(text)))
        else:
            at = separators.last_within(first + min(shortest, size), first + size)
            bounds.append((first, first + size if at is None else at))
    return bounds[1:]


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """doc_id, chunk_index, start_char, end_char and content; null and empty texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, s, e, t[s:e]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if t for i, (s, e) in enumerate(chunk_bounds(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start_char", "end_char", "content"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, chunk_index int, start_char int, end_char int, content string")


def block_offsets(parts: DataFrame, key: str, order: str, gap: int = 2) -> DataFrame:
    """Adds start_char and end_char of each block in its document, blocks joined by gap characters."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0))
    return parts.withColumn("start_char", start.cast("long")).withColumn("end_char", (start + F.length("text")).cast("long"))


def overlaps(blocks_: DataFrame, chunks_: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """Pairs of a block and a chunk of one document that share a character, by buckets of width characters."""

    def spread(rows: DataFrame, index: str, start: str, end: str) -> DataFrame:
        first, last = F.floor(F.col("start_char") / width), F.floor((F.greatest(F.col("end_char"), F.col("start_char") + 1) - 1) / width)
        return rows.select(key, index, F.col("start_char").alias(start), F.col("end_char").alias(end), F.explode(F.sequence(first, last)).alias("_k"))

    b, c = spread(blocks_, "block_index", "b0", "b1"), spread(chunks_, "chunk_index", "c0", "c1")
    return b.join(c, [key, "_k"]).where((F.col("b0") < F.col("c1")) & (F.col("b1") > F.col("c0"))).select(key, "block_index", "chunk_index").distinct()


def tickers(text: Column) -> Column:
    """Distinct ticker-like words, $ optional with lower case, in order of first appearance."""
    marked = F.regexp_extract_all(text, F.lit(f"({mentions.TICKER})"), 1)
    return F.array_distinct(F.transform(marked, lambda t: F.upper(F.ltrim(t, F.lit("$")))))


def release_type(question: Column) -> Column:
    q = F.lower(question)
    out = F.lit(None).cast("string")
    #: Keywords of release types, first match wins.
    for name, words in reversed([("cpi", ["cpi"]), ("ppi", ["ppi"]), ("pce", ["pce"]), ("employment_situation", ["非农", "就业报告", "employment situation"]), ("weekly_claims", ["初请", "续请", "失业金", "weekly claims"])]):
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def evidence_modes(document: str | None) -> list[tuple[str, str | None]]:
    """Every evidence_id in a JSON text, at any depth, with the data_mode of the nearest object around it that has one."""
    found: list[tuple[str, str | None]] = []
    try:
        waiting: list[tuple[object, str | None]] = [(json.loads(document or "null"), None)]
    except (ValueError, RecursionError):  # no JSON, or nested deeper than any document is
        return found
    while waiting:
        value, mode = waiting.pop()
        if isinstance(value, dict):
            own = value.get("data_mode")
            mode = own if isinstance(own, str) else mode
            if isinstance(value.get("evidence_id"), str):
                found.append((value["evidence_id"], mode))
            waiting += [(v, mode) for v in value.values()]
        elif isinstance(value, list):
            waiting += [(v, mode) for v in value]
    return found


def evidence_in(rows: DataFrame, key: str, column: str) -> DataFrame:
    """A row per evidence_id of a column of JSON texts: key, evidence_id and data_mode."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *e) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in evidence_modes(text)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((batch.schema.types[0], pa.string(), pa.string()))], names=[key, "evidence_id", "data_mode"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, column).mapInArrow(walk, f"{key} {kind}, evidence_id string, data_mode string")


def aliases_in(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id and alias of each message (doc_id, text) that has an alias of the column alias, as mentions.Scanner finds them."""
    return mentions.entries_in(messages, aliases.select(F.col("alias").alias("entry")), plain=False).select("doc_id", F.col("entry").alias("alias")).distinct()
