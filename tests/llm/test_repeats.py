import hashlib
import random
import re

import numpy as np

from tidemark.llm import repeats

SCHEMA = "doc_id long, text string, slab string, n_words string, ids string"


def brute(rows, size=13):
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    first = {}
    for (doc_id, _), ws in zip(rows, seqs):
        for i in range(len(ws) - size + 1):
            if doc_id is not None:
                key = tuple(ws[i : i + size])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), ws in zip(rows, seqs):
        gone = set()
        for i in range(len(ws) - size + 1):
            if doc_id is not None and first[tuple(ws[i : i + size])] < doc_id:
                gone |= set(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in repeats.repeated_words(docs, **more).collect()), key=str)


def planted(rng):
    vocabulary = [f"w{i}" for i in range(3000)] + ["Å", "ß", " x", "漢字", "A", "a"]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 13, 14, 40, 60)]
    rows = []
    for doc_id in rng.sample(range(-50, 10_000), 160):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 12, 13, 50, 200]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(passages)
        rows.append((doc_id, rng.choice([" ", "\n", " \t "]).join(ws)))
    rows += [(rows[0][0], rows[1][1]), (rows[5][0], rows[5][1]), (rows[5][0], rows[5][1]), (77_777, rows[9][1])]
    rows += [(None, rows[9][1]), (None, rows[9][1]), (88_888, None), (88_889, ""), (88_890, " \n"), (90_000, "x " * 500), (90_001, "x " * 100)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = planted(random.Random(3))
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, size=5) == brute(rows, 5)


def test_small_sketch_and_slabs_change_nothing(spark, monkeypatch):
    """A sketch so small that nearly all estimates are too high only sends more windows to the exact step."""
    monkeypatch.setattr(repeats, "CELLS_PER_WORD", 0)
    rows = planted(random.Random(4))
    assert result(spark, rows) == brute(rows)


def test_long_text_and_many_copies(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 30) for _ in range(200_000))
    rows = [(1, long), (2, "start " + long + " end")] + [(k, " ".join(long.split()[:60])) for k in range(10, 300)]
    got = {r[0]: r[2] for r in result(spark, rows)}
    assert got[1] == 0 and got[2] == 200_000 and all(got[k] == 60 for k in range(10, 300))


def test_empty_table(spark):
    assert result(spark, []) == []


def test_keys_tell_windows_apart():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 40, dtype=np.uint64)
    text = np.r_[hashes, hashes[::-1], hashes]
    keys = repeats.window_keys(text, 13, 0x9E3779B97F4A7C15)
    assert len(keys) == len(text) - 12
    assert (keys[:28] == keys[80:]).all() and len(np.unique(keys)) == len(keys) - 28
    assert (repeats.window_keys(hashes, 13, 3) != repeats.window_keys(hashes, 13, 5)).all()


def test_packing_round_trip():
    for dtype in ("<u4", "<u8", "<i8"):
        x = np.arange(1000).astype(dtype) * 7
        assert (repeats._unpacked(repeats._packed(x), dtype) == x).all()
