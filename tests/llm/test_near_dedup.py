import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_dedup
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def brute(rows, size):
    sets = {}
    for doc_id, text in rows:
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[doc_id] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}


def result(spark, rows, size):
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "clash") for d, t in rows], SCHEMA)
    return near_dedup.groups(docs, size).collect()


@pytest.mark.parametrize("size", [2, 5])
def test_groups_match_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 6, 9, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, len(words) // 40, len(words) // 15])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((at, rng.choice([" ", "\n", "  "]).join(words).replace("w", rng.choice("wW"))))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one"), (at + 4, "ONE")]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, rows, size)}
    assert found == brute(rows, size)


def test_empty_null_ids_and_repeated_rows(spark):
    assert result(spark, [], 5) == []
    text = "a b c d e f g"
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"], r["kept"]) for r in result(spark, [(3, text), (3, text), (5, text), (None, text)], 5))
    assert [(d, k) for d, _, k in found] == [(-1, True), (3, True), (3, True), (5, False)]


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(3, text, "x"), (3, text, "x"), (5, text, "y"), (6, "other words", "z"), (None, None, "n")], "doc_id long, text string, _row string")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["_row"]) for r in kept.collect()) == [(-1, "n"), (3, "x"), (6, "z")]


def test_estimate_is_close_and_registers_agree_with_similarity(spark):
    rng = np.random.default_rng(1)
    for n in (40, 300, 20000):
        common = rng.integers(-(2**62), 2**62, n * 8 // 10)
        a = np.concatenate([common, rng.integers(-(2**62), 2**62, n // 10)])
        b = np.concatenate([common, rng.integers(-(2**62), 2**62, n // 10)])
        x = near_dedup.registers(np.concatenate([a, b]), np.array([len(a), len(a) + len(b)]))
        frame = spark.createDataFrame([(bytearray(x[0].tobytes()), bytearray(x[1].tobytes()), n)], "a binary, b binary, n long")
        value = frame.select(near_dedup.estimate(frame.a, frame.b, frame.n)).first()[0]
        assert abs(value - 0.8) < 0.2


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        if start in want:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_that_share_an_id(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    docs = spark.createDataFrame([(3, x, "a"), (5, x, "b"), (5, y, "c"), (7, y, "d"), (9, "lone text", "e"), (9, "lone text", "e"), (None, x, "f")], "doc_id long, text string, mark string")
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(docs).collect()}
    assert found == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True), (None, None, True)}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["mark"]) for r in kept.collect()) == sorted([(3, x, "a"), (5, y, "c"), (9, "lone text", "e"), (0, x, "f")])


def test_last_round_alone_links_all_over_many_blocks(spark, monkeypatch):
    """Documents that share a passage fill buckets with unlike members; small blocks and pieces split their cells."""
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "PIECE", 8)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for k in range(60):
        own = [f"o{k}-{i}" for i in range(rng.choice([15, 20, 30, 40, 80]))]
        for _ in range(rng.choice([1, 1, 3])):
            words = common + own
            words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, rows, 2)}
    assert found == brute(rows, 2)
    assert len({c for _, c in found.values()}) > 1


def test_last_round_gives_likely_pairs_in_bounded_batches(monkeypatch):
    """A bucket of like members makes as many pairs as the square of its size, which aren't held at once."""
    monkeypatch.setattr(near_dedup, "PAIRS_HELD", 256, raising=False)
    n, sketch = 60, np.arange(near_dedup.BUCKETS, dtype=np.uint16).tobytes()
    rows = [(32, 0, 0, 0, side, k, k, 100, False, sketch) for side in (0, 1) for k in range(n)]
    names = [*near_dedup.CELL, "side", "node", "root", "n_shingles", "main", "sketch"]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) if isinstance(x[0], bytes) else pa.array(x) for x in zip(*rows)], names=names)
    out = list(near_dedup._likely(iter([batch])))
    found, held, most = [], set(), 0
    for part in out:
        for row in part.to_pylist():
            if row["names"] is None:
                held.add(row["node"])
            else:
                assert held.issuperset(row["names"])
                found += [(a, row["node"]) for a in row["names"]]
        most = max(most, sum(len(r["names"] or ()) for r in part.to_pylist()))
    assert sorted(found) == [(a, b) for a in range(n) for b in range(n) if a < b]
    assert most <= 256


def test_members_are_the_bands_that_several_nodes_share(spark):
    rng = np.random.default_rng(3)
    sketches = rng.integers(0, 60000, (9, near_dedup.BUCKETS)).astype(np.uint16)
    sketches[1, :8], sketches[2, :8], sketches[5, -4:] = sketches[0, :8], sketches[0, :8], sketches[4, -4:]
    classes = spark.createDataFrame([(k - 4, bytearray(x.tobytes())) for k, x in enumerate(sketches)], "node long, sketch binary")
    found = defaultdict(set)
    for r in near_dedup._members(classes).collect():
        found[r["band"]].add(r["node"])
    last = near_dedup.BUCKETS // near_dedup.BAND - 1
    assert sorted((band & last, sorted(nodes)) for band, nodes in found.items()) == [(0, [-4, -3, -2]), (1, [-4, -3, -2]), (last, [0, 1])]


def test_nodes_of_one_lead_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LED_ROWS", 3)
    rng = random.Random(4)
    held = {k: sorted({*range(100 - k), *(1000 * k + i for i in range(k))}) for k in range(1, 20)}
    sets = spark.createDataFrame(sorted(held.items(), key=lambda _: rng.random()), "node long, set array<bigint>")
    pairs = spark.createDataFrame([(k, 1) for k in range(2, 15)] + [(k, 15) for k in range(16, 20)], "node long, lead long")
    want = {(a, b) for a, b in pairs.collect() if 100 * len({*held[a]} & {*held[b]}) >= 80 * len({*held[a]} | {*held[b]})}
    found = near_dedup._confirmed(pairs, sets).collect()
    assert {(r["u"], r["v"]) for r in found} == want and len(found) == len(want)
    assert 0 < len(want) < pairs.count()
