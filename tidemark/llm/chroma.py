"""Chroma audio fingerprints and the alignment of recordings by them.

A recording is WAV bytes (16-bit PCM). It is mixed to one channel, brought to RATE, and cut into
overlapping frames whose spectra are summed to twelve pitch classes; frames are smoothed over time
and scaled to length one. Over the integral image of frames and pitch classes, sixteen filters
compare areas, each giving two bits of Gray code, which together make one 32-bit integer a frame.

Two recordings are aligned at an offset if few bits differ over the whole overlap. search() finds
alignments by a histogram of offsets: all sounding frames of all recordings are looked up by the
integers of a query's sounding frames, and by those integers with one of their DOUBTS least certain
bits turned, which are the bits of the filters nearest to an edge. Each frame met is a vote for a
pair and an offset, and an offset with LEAST_VOTES has its bit errors counted over the overlap. Votes are counted where a
block of queries meets a block of recordings, so that no vote is a row of Spark: blocks are sent, which are far fewer bytes. Each
block of queries meets each block of recordings, and within it frames meet by their integers. align() compares all offsets of all pairs instead, blocks of
recordings at a time, by products of matrices of bits, and is what recall is measured against (README).

Of a pair's alignments, the one with most like frames is given, of those the one of the least offset, forwards
first. LEAST_OVERLAP and MOST_ERRORS are bounds that chance hardly reaches: adjacent integers share most of their
frames, so that short overlaps of unrelated recordings agree by luck.

Recordings with equal fingerprints are one class, of which the smallest id stands for all. Silent
frames, that have no pitch to speak of, are no like frames but count in the overlap, so that silence
matches nothing by itself.

Defined results: null, empty and unreadable media have no frames, are a class each on their own,
and match nothing, as do recordings with fewer than LEAST_OVERLAP integers. Rows with a null id
are left out of matches. Rows that share an id but not a fingerprint are each compared under that
id. Other columns are not read.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_rows, cut, lookup, ready

RATE = 11025
FRAME = 4096
HOP = FRAME // 3
LOW, HIGH = 28.0, 3520.0
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
SPAN = 16
#: Share of differing bits up to which an alignment counts, and the fewest frames of overlap.
MOST_ERRORS = 0.15
LEAST_OVERLAP = 24
#: Frames that sound in both and differ by no more than that share are needed at least this often at one offset.
LEAST_VOTES = 2
#: Bits of a query's integer that are turned, one at a time.
DOUBTS = 6
#: Frames of recordings that are compared together, most of their tasks, and most blocks that are broadcast.
BLOCK = 1 << 15
MOST_PARTS = 10_000
#: Recordings in an Arrow batch.
BATCH_ROWS = 64
BROADCAST_BLOCKS = 64
#: Votes, or frames of overlaps, that are held at a time, and pairs of blocks in an Arrow batch.
HELD_VOTES = 1 << 21
BATCH_CELLS = 8
BLOCK_COLUMNS = ["ids", "sizes", "codes", "sounds"]
ALIGNED = "query_id long, match_id long, offset int, votes long, overlap int, bit_errors int"


@lru_cache
def _pitch() -> np.ndarray:
    """Weight of each spectrum bin in each pitch class."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hertz), 12), dtype=np.float32)
    inside = (hertz >= LOW) & (hertz <= HIGH)
    out[np.flatnonzero(inside), np.rint(12 * np.log2(hertz[inside] / 440)).astype(int) % 12] = 1
    return out


def decode(media: bytes | None) -> np.ndarray:
    """Samples of a WAV, one channel at RATE."""
    try:
        with wave.open(io.BytesIO(media or b"")) as file:
            if file.getsampwidth() != 2:
                return np.zeros(0, dtype=np.float32)
            data = np.frombuffer(file.readframes(file.getnframes()), dtype="<i2").reshape(-1, file.getnchannels()).mean(1)
            rate = file.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0, dtype=np.float32)
    if rate != RATE:
        data = np.interp(np.arange(0, len(data), rate / RATE), np.arange(len(data)), data)
    return (data / 32768).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Smoothed pitch-class frames of length one, or zero where silent."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hamming(FRAME).astype(np.float32)
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ _pitch()
    if len(energy) < len(SMOOTH):
        return np.zeros((0, 12))
    smooth = sum(w * energy[i : len(energy) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 0.01, smooth / np.maximum(norm, 0.01), 0.0)


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch class, height and width of the sixteen filters, by rule."""
    return [(k % 6, (5 * k) % 9, 3 + k % 4 if (5 * k) % 9 + 3 + k % 4 <= 12 else 3, (4, 8, 12, 16)[k % 4]) for k in range(16)]


def _compared(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of SPAN frames the 32-bit integer, how far each filter is from its nearest edge, and the bit that would turn beyond it."""
    n = max(0, len(frames) - SPAN + 1)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    out, gray = np.zeros(n, dtype=np.uint32), np.array([0, 1, 3, 2], dtype=np.uint32)
    apart, turned = np.zeros((n, 16)), np.zeros((n, 16), dtype=np.uint32)
    for k, (kind, y, h, w) in enumerate(_filters()):
        half, third_h, third_w, mid = w // 2, max(1, h // 3), w // 3, h // 2
        whole = area(0, y, w, y + h)
        if kind == 0:
            one, two = whole, np.zeros(n)
        elif kind == 1:
            one = area(0, y + mid, w, y + h)
            two = whole - one
        elif kind == 2:
            one = area(half, y, w, y + h)
            two = whole - one
        elif kind == 3:
            one = area(half, y, w, y + mid) + area(0, y + mid, half, y + h)
            two = whole - one
        elif kind == 4:
            one = area(0, y + third_h, w, y + h - third_h)
            two = whole - one
        else:
            one = area(third_w, y, w - third_w, y + h)
            two = whole - one
        value = np.log1p(one) - np.log1p(two)
        edges = np.array([0.25, 0.5, 1.0]) * np.log1p(w) if kind == 0 else np.array([-0.15, 0.0, 0.15])
        level = np.searchsorted(edges, value)
        out = (out << np.uint32(2)) | gray[level]
        far = np.abs(value[:, None] - edges)
        nearest = far.argmin(axis=1)
        beyond = np.where(nearest >= level, nearest + 1, nearest)
        apart[:, k] = far.min(axis=1) / (edges[-1] - edges[0])
        turned[:, k] = (gray[level] ^ gray[np.clip(beyond, 0, 3)]) << np.uint32(2 * (15 - k))
    return out, apart, turned


def fingerprint(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit integer for every run of SPAN frames, and whether all of the run sounds."""
    codes = _compared(frames)[0]
    if not len(codes):
        return codes, np.zeros(0, dtype=bool)
    return codes, np.convolve((frames.any(1)).astype(int), np.ones(SPAN, dtype=int), "valid") == SPAN


def doubts(frames: np.ndarray) -> np.ndarray:
    """For every run of SPAN frames the DOUBTS least certain bits, as a mask."""
    codes, apart, turned = _compared(frames)
    least = np.argsort(apart, axis=1, kind="stable")[:, :DOUBTS]
    return np.bitwise_or.reduce(np.take_along_axis(turned, least, axis=1), axis=1) if len(codes) else codes


def tones(values: np.ndarray, seconds: float = 0.125, noise: float = 0.0, seed: int = 0) -> bytes:
    """A WAV of one tone per value, whose pitch is the value on a scale of half steps, with noise of this deviation."""
    if not len(values):
        return b""
    steps = np.rint(np.clip(np.nan_to_num(np.asarray(values, dtype=np.float64)), -4, 4) * 12)
    length = int(RATE * seconds)
    wave_table = np.sin(2 * np.pi * (440 * 2.0 ** (steps[:, None] / 12)) * np.arange(length) / RATE)
    sound = wave_table.ravel() + (np.random.default_rng(seed).normal(0, noise, wave_table.size) if noise else 0)
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(RATE)
        file.writeframes((sound * 12000).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def render_tones(values: pd.Series) -> pd.Series:
    return pd.Series([tones(v if v is not None else []) for v in values])


@F.pandas_udf(T.BinaryType())
def render_copy(values: pd.Series, seed: pd.Series) -> pd.Series:
    """A copy that begins a second later, with noise."""
    return pd.Series([tones(np.asarray(v if v is not None else [])[8:], noise=0.05, seed=abs(int(k))) for v, k in zip(values, seed)])


@F.pandas_udf(T.StructType([T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("sounds", T.ArrayType(T.BooleanType())), T.StructField("doubts", T.ArrayType(T.LongType()))]))
def print_media(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        frames = [chroma(decode(None if m is None else bytes(m))) for m in batch]
        found = [fingerprint(f) for f in frames]
        yield pd.DataFrame({"codes": [c.astype(np.int64) for c, _ in found], "sounds": [s for _, s in found], "doubts": [doubts(f).astype(np.int64) for f in frames]})


def fingerprints(recordings: DataFrame, media: Column) -> DataFrame:
    """rec_id, codes, sounds and doubts of every recording; media is a column of WAV bytes. Run it with few arrow_rows()."""
    ready(recordings.sparkSession)
    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), print_media(media).alias("p")).select("rec_id", "p.*")


def _classes(prints: DataFrame, query: Column) -> tuple[DataFrame, DataFrame]:
    """Classes (rec_id, class_id) of all recordings, and a row per class of sounds: class_id, what its recordings share, and asks, whether one is a query."""
    with arrow_rows(prints.sparkSession, BATCH_ROWS):
        prints = cut(prints.withColumn("key", F.sha2(F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))), 256)).withColumn("is_query", F.coalesce(query, F.lit(False))))
    full = prints.where((F.size("codes") > 0) & F.col("rec_id").isNotNull())
    classes = cut(full.groupBy("key").agg(F.min("rec_id").alias("class_id"), F.max("is_query").alias("asks")))
    member = prints.select("rec_id", "key").join(classes.select("key", "class_id"), "key", "left").select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"))
    first = full.drop("is_query").join(classes, "key").where("rec_id = class_id").dropDuplicates(["key"])
    return member, cut(first.drop("rec_id", "key"))


def align(prints: DataFrame, query: Column) -> tuple[DataFrame, DataFrame]:
    """Classes (rec_id, class_id) of all recordings, and all alignments of classes that hold a query, by comparing all offsets of all pairs.

    Alignments have query_id and match_id, the smallest ids of two classes, offset (of the match
    against the query, in frames), votes (like frames), overlap and bit_errors.
    """
    member, shown = _classes(prints, query)
    left = blocks(shown.where("asks")).select(*[F.col(c).alias(f"q_{c}") for c in BLOCK_COLUMNS])
    right = blocks(shown).select(*[F.col(c).alias(f"m_{c}") for c in BLOCK_COLUMNS])
    right = right.repartition(max(1, min(MOST_PARTS, right.count())))
    return member, right.crossJoin(lookup(left, BROADCAST_BLOCKS)).mapInPandas(aligned, ALIGNED)


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on up to each size, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _wanted(codes: np.ndarray, sounds: np.ndarray, doubts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sounding frames, one for each integer they are looked up by, in order, and those integers: their own, and it with one doubtful bit turned."""
    at = np.flatnonzero(sounds)
    frame, bit = np.nonzero((doubts[at, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1))
    place, code = np.r_[at, at[frame]], np.r_[codes[at], codes[at[frame]] ^ (np.uint32(1) << bit.astype(np.uint32))]
    order = np.argsort(place, kind="stable")
    return place[order], code[order]


def _offsets(q: dict[str, np.ndarray], m: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, match and offset (places within the two blocks, and frames) with LEAST_VOTES, all of a query at once, from about HELD_VOTES votes at a time."""
    place, code = _wanted(q["codes"], q["sounds"], q["doubts"])
    there = np.flatnonzero(m["sounds"])
    there = there[np.argsort(m["codes"][there], kind="stable")]
    shown = m["codes"][there]
    low = np.searchsorted(shown, code, "left")
    met = np.searchsorted(shown, code, "right") - low
    some = met > 0
    place, low, met = place[some], low[some], met[some]
    longest = int(q["sizes"].max())
    span = longest + int(m["sizes"].max())
    upto = np.cumsum(met)
    ends = np.searchsorted(q["owner"][place], np.arange(len(q["sizes"])), "right")  # where each query's lookups end
    begin = 0
    while begin < len(met):
        before = int(upto[begin - 1]) if begin else 0
        fitting = ends[(ends > begin) & (upto[np.maximum(ends, 1) - 1] - before <= HELD_VOTES)]
        stop = int(fitting.max()) if len(fitting) else int(ends[ends > begin].min())
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while begin < stop:  # one query alone may have more votes than are held at a time
            before = int(upto[begin - 1]) if begin else 0
            part = slice(begin, min(stop, max(begin + 1, int(np.searchsorted(upto, before + HELD_VOTES, "right")))))
            here, frame = np.repeat(place[part], met[part]), there[np.repeat(low[part], met[part]) + _runs(met[part])]
            mine, other = q["owner"][here], m["owner"][frame]
            offset = (frame - m["starts"][other]) - (here - q["starts"][mine])
            new, n = np.unique((mine * len(m["sizes"]) + other) * span + offset + longest, return_counts=True)
            if len(keys):
                new, at = np.unique(np.r_[keys, new], return_inverse=True)
                n = np.bincount(at, weights=np.r_[counts, n]).astype(np.int64)
            keys, counts, begin = new, n, part.stop
        keys = keys[counts >= LEAST_VOTES]
        pair, offset = keys // span, keys % span - longest
        mine, other = pair // len(m["sizes"]), pair % len(m["sizes"])
        differ = q["ids"][mine] != m["ids"][other]
        yield mine[differ], other[differ], offset[differ]


def _verified(q: dict[str, np.ndarray], m: dict[str, np.ndarray], mine: np.ndarray, other: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs and offsets those within the bounds: mine, other, offset, like frames, overlap and bit errors."""
    first = np.maximum(0, -offset)
    overlap = np.minimum(q["sizes"][mine], m["sizes"][other] - offset) - first
    long = overlap >= LEAST_OVERLAP
    mine, other, offset, first, overlap = (x[long] for x in (mine, other, offset, first, overlap))
    upto, begin, like, total = np.cumsum(overlap), 0, [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while begin < len(overlap):
        before = int(upto[begin - 1]) if begin else 0
        part = slice(begin, max(begin + 1, int(np.searchsorted(upto, before + HELD_VOTES, "right"))))
        n, steps = overlap[part], _runs(overlap[part])
        here = np.repeat(q["starts"][mine[part]] + first[part], n) + steps
        frame = np.repeat(m["starts"][other[part]] + first[part] + offset[part], n) + steps
        errors = np.bitwise_count(q["codes"][here] ^ m["codes"][frame])
        alike = (errors <= MOST_ERRORS * 32) & q["sounds"][here] & m["sounds"][frame]
        starts = np.cumsum(n) - n
        like.append(np.add.reduceat(alike, starts, dtype=np.int64))
        total.append(np.add.reduceat(errors, starts, dtype=np.int64))
        begin = part.stop
    like, total = np.concatenate(like), np.concatenate(total)
    near = (like >= LEAST_VOTES) & (total <= MOST_ERRORS * 32 * overlap)
    return tuple(x[near] for x in (mine, other, offset, like, overlap, total))


def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best alignment of each pair of recordings of two blocks, over the offsets with LEAST_VOTES."""

    def side(row: object, name: str) -> dict[str, np.ndarray]:
        sizes = np.asarray(getattr(row, f"{name}_sizes"), dtype=np.int64)
        codes, sounds = np.asarray(getattr(row, f"{name}_codes")).astype(np.uint32), np.asarray(getattr(row, f"{name}_sounds")).astype(bool)
        return {"ids": np.asarray(getattr(row, f"{name}_ids"), dtype=np.int64), "sizes": sizes, "starts": np.cumsum(sizes) - sizes, "owner": np.repeat(np.arange(len(sizes)), sizes), "codes": codes, "sounds": sounds}

    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            q, m = side(row, "q"), side(row, "m")
            q["doubts"] = np.asarray(row.q_doubts).astype(np.uint32)
            for offsets in _offsets(q, m):
                mine, other, offset, like, overlap, total = _verified(q, m, *offsets)
                order = np.lexsort((offset, -np.abs(offset), like, other, mine))
                mine, other, offset, like, overlap, total = (x[order] for x in (mine, other, offset, like, overlap, total))
                best = np.flatnonzero(np.r_[(mine[1:] != mine[:-1]) | (other[1:] != other[:-1]), True][: len(mine)])
                rows.append(np.stack([q["ids"][mine], m["ids"][other], offset, like, overlap, total], axis=1)[best])
        found = np.concatenate(rows) if rows else np.zeros((0, 6), dtype=np.int64)
        yield pd.DataFrame(found, columns=["query_id", "match_id", "offset", "votes", "overlap", "bit_errors"])


def align_by_votes(prints: DataFrame, query: Column) -> tuple[DataFrame, DataFrame]:
    """What align() gives, but of pairs and offsets with LEAST_VOTES only; prints has doubts."""
    member, shown = _classes(prints, query)
    left = blocks(shown.where("asks"), "doubts").select(*[F.col(c).alias(f"q_{c}") for c in [*BLOCK_COLUMNS, "doubts"]])
    right = blocks(shown).select(*[F.col(c).alias(f"m_{c}") for c in BLOCK_COLUMNS])
    right = right.repartition(max(1, min(MOST_PARTS, right.count())))
    with arrow_rows(shown.sparkSession, BATCH_CELLS):
        return member, cut(right.crossJoin(lookup(left, BROADCAST_BLOCKS)).mapInPandas(voted, ALIGNED))


def blocks(shown: DataFrame, *more: str) -> DataFrame:
    """Recordings of like lengths, about BLOCK frames together, as ids, sizes, and codes, sounds and more of the kind end to end."""
    like = F.ceil(F.log2(F.size("codes"))).cast("int")
    counts = {r["like"]: r["count"] for r in shown.groupBy(like.alias("like")).count().collect()}  # a row per power of two
    n = F.lit(1)
    for k, count in counts.items():
        n = F.when(like == k, -(-count // max(1, BLOCK >> k))).otherwise(n)
    rows = shown.select(like.alias("like"), F.pmod(F.xxhash64("class_id"), n).alias("block"), F.struct("class_id", "codes", "sounds", *more).alias("r"))
    together = rows.groupBy("like", "block").agg(F.collect_list("r").alias("rs"))
    return cut(together.select(F.col("rs.class_id").alias("ids"), F.transform("rs", lambda r: F.size(r["codes"])).alias("sizes"), *[F.flatten(f"rs.{c}").alias(c) for c in ("codes", "sounds", *more)]))


def _unpacked(sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A row per recording: every bit as 1 or -1, and 0 after its end."""
    sizes = np.asarray(sizes)
    bits = np.unpackbits(np.asarray(codes).astype("<u4").view(np.uint8)).astype(np.float32) * 2 - 1
    out = np.zeros((len(sizes), int(sizes.max()) * 32), dtype=np.float32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None] * 32] = bits
    return out


def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best alignment of each pair of recordings of two blocks, over all offsets."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            qs, ms = np.asarray(row.q_sizes, dtype=np.int64), np.asarray(row.m_sizes, dtype=np.int64)
            q_at, m_at = np.cumsum(qs) - qs, np.cumsum(ms) - ms
            q_codes, m_codes = (np.asarray(c).astype(np.uint32) for c in (row.q_codes, row.m_codes))
            q_sounds, m_sounds = (np.asarray(c).astype(bool) for c in (row.q_sounds, row.m_sounds))
            q_bits, m_bits = _unpacked(qs, q_codes), _unpacked(ms, m_codes)
            differ = np.asarray(row.q_ids)[:, None] != np.asarray(row.m_ids)[None, :]
            best: dict[tuple[int, int], tuple] = {}
            for offset in range(LEAST_OVERLAP - int(qs.max()), int(ms.max()) - LEAST_OVERLAP + 1):
                start, stop = max(0, -offset), min(int(qs.max()), int(ms.max()) - offset)
                # Equal bits less unequal ones; the bits after an end count for neither.
                same = q_bits[:, start * 32 : stop * 32] @ m_bits[:, (start + offset) * 32 : (stop + offset) * 32].T
                overlap = np.minimum(qs[:, None], ms[None, :] - offset) - start
                fits = differ & (overlap >= LEAST_OVERLAP) & (32 * overlap - same <= 2 * MOST_ERRORS * 32 * overlap + 0.5)
                for q, m in zip(*map(np.ndarray.tolist, np.nonzero(fits)), strict=True):
                    n = int(overlap[q, m])
                    a, b = int(q_at[q]) + start, int(m_at[m]) + start + offset
                    errors = np.bitwise_count(q_codes[a : a + n] ^ m_codes[b : b + n])
                    total = int(errors.sum())
                    votes = int(((errors <= MOST_ERRORS * 32) & q_sounds[a : a + n] & m_sounds[b : b + n]).sum())
                    if votes >= LEAST_VOTES and total <= MOST_ERRORS * 32 * n:
                        best[q, m] = max(best.get((q, m), (-1,)), (votes, -abs(offset), offset, n, total))
            rows += [(row.q_ids[q], row.m_ids[m], offset, votes, n, total) for (q, m), (votes, _, offset, n, total) in best.items()]
        yield pd.DataFrame(rows, columns=["query_id", "match_id", "offset", "votes", "overlap", "bit_errors"])


def search(recordings: DataFrame, media: Column, query: Column) -> DataFrame:
    """kind 'class': rec_id and its class (match_id); kind 'match': a class with a query and a class aligned to it."""
    member, found = align_by_votes(fingerprints(recordings, media), query)
    none = F.lit(None)
    rows = member.select(F.lit("class").alias("kind"), "rec_id", F.col("class_id").alias("match_id"), *[none.cast(t).alias(n) for n, t in (("offset", "int"), ("votes", "long"), ("overlap", "int"), ("bit_errors", "int"))])
    return rows.unionByName(found.select(F.lit("match").alias("kind"), F.col("query_id").alias("rec_id"), "match_id", "offset", "votes", "overlap", "bit_errors"))
