"""Rules, mixing, chats and shards against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tidemark.llm import chats, mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, size string")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    places = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places))


def test_rule_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c a b c", "a a a a", "é漢🙂 x\x0by", "x" * 50000, "a b c d\n\na b c d\n x#*", "one two three " * 3000]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["x y", "p|q", "", " "]) for _ in range(9)) for _ in range(10)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "a", None, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality_rules.apply_rules(docs, labels).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        want = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_tail_is_binomial(spark):
    frame = spark.createDataFrame([(n, k) for n in (1, 10, 700, 20000) for k in range(0, max(1, n // 50), max(1, n // 200))], "n long, k long")
    for r in frame.select("n", "k", quality_rules.tail(frame.n, frame.k, 0.03).alias("p")).collect():
        n, k = r["n"], r["k"]
        want = 1.0 if k >= n * 0.03 else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.03) + (n - i) * math.log(0.97)) for i in range(k + 1))
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_cutoffs_reject_junk_and_keep_the_bound(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(2600):
        good = i % 5 != 0
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("" if good else "%%") for _ in range(60))
        rows.append((i, text, "en" if i % 50 else None, "s"))
        labels += [(i, int(good), 0)] * (1 + i % 2) + [(None, 1, 0), (i, None, 1)] * (i % 7 == 0)
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, known).collect()}
    assert sum(not found[i] for i in range(2600) if i % 5 and i % 50) <= 0.03 * 2080
    assert not any(found[i] for i in range(0, 2600, 5) if i % 50)
    # Nulls are a stratum of their own with too few labels for any cutoff.
    assert all(found[i] for i in range(0, 2600, 50))
    kept = quality_rules.keep_good(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in found.items() if k}
    assert quality_rules.apply_rules(docs.limit(0), known).collect() == []


def plain_mix(rows):
    sizes = [(d, s, len(WORD.findall(t or ""))) for d, t, s in rows]
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, free = dict.fromkeys(sources, 0.0), 1.5 * sum(total.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else level * weight[s]
        left -= sum(2 * total[s] for s in over)
        free = free - over if over else set()
    return sizes, total, target


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i if i % 11 else 7, " ".join(["w"] * rng.choice([0, 1, 30, 400])) if i % 13 else None, rng.choice(["a", "b", "é", None, "hot", "hot", "hot", "d", "e"])) for i in range(400)]
    docs = documents(spark, [(d, t, "en", s) for d, t, s in rows])
    sizes, total, target = plain_mix(rows)
    found = mixing.mix(docs).collect()
    by = defaultdict(int)
    assert len(found) == len(rows) and Counter((r["doc_id"], r["size"]) for r in found) == Counter((d, n) for d, _, n in sizes)
    names = {(v, target[s]): s for s, v in total.items()}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[names[(r["source_size"], min((t for (v, t) in names if v == r["source_size"]), key=lambda t: abs(t - r["target"])))]] += r["taken"]
    for s, words in by.items():
        assert words == math.floor(target[s] + 1e-6)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, found))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in found)
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed_documents(docs.limit(0)).collect() == []


def test_ranges_of_keys_give_what_one_range_gives(spark, monkeypatch):
    rows = [(i, "w " * (i % 9), "en", "ab"[i % 3 == 0]) for i in range(500)]
    whole = sorted(map(str, mixing.mix(documents(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert sorted(map(str, mixing.mix(documents(spark, rows)).collect())) == whole


@pytest.mark.parametrize("turns", [1024, 15])
def test_chats(spark, monkeypatch, turns):
    monkeypatch.setattr(chats, "TURNS", turns)  # the smaller one cuts conversations into stretches
    rows = []
    rng = random.Random(8)
    for c in range(60):
        talk = [(rng.choice(["user", "bot"]), rng.choice(["hi", "yo", None, ""])) for _ in range(rng.randrange(1, 4))]
        rows += [(c, 10 * i, r, t) for i, (r, t) in enumerate(talk)]
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (None, 5, "user", "hi"), (99, None, None, None)]
    rows += [(98, t, "user", f"t{k}") for k, t in enumerate([None, 0, 0, 3, 9, 70, 71])] + [(97, t, "user", f"t{k}") for k, t in enumerate([None, 1, 2, 3])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, place string")
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        talks[c if c is not None else (None, len(talks))].append((-1 if turn is None else turn, role, text))
    order = lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
    plain = {c: tuple((r, t) for _, r, t in sorted(v, key=order)) for c, v in talks.items()}
    want = {}
    for c, talk in plain.items():
        same = [k for k, v in plain.items() if v == talk]
        longer = any(len(v) > len(talk) and v[: len(talk)] == talk for v in plain.values())
        if not longer and c == min(same, key=lambda k: (isinstance(k, tuple), k)):
            want[None if isinstance(c, tuple) else c] = (len(talk), len(same), "\n".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>" for r, t in talk))
    assert {r["conv_id"]: (r["n_turns"], r["n_equal"], r["text"]) for r in chats.render(frame).collect()} == want
    assert chats.render(frame.limit(0)).collect() == []


def test_shards(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.choice([0, 10, 300, 900]), "en", "s") for i in range(500)] + [(1, None, "en", "s"), (700, "y" * 9000, "en", "s")] + [(5, "z" * 700, "en", "s")] * 40
    found = sharding.shard(documents(spark, rows), limit=5000).collect()
    assert Counter((r["doc_id"], r["bytes"]) for r in found) == Counter((d, len(t or "")) for d, t, _, _ in rows)
    size = Counter()
    for r in found:
        size[(r["prefix"], r["page"])] += r["bytes"]
        assert len(r["prefix"]) == r["depth"]
    for r in found:
        assert r["shard_bytes"] == size[(r["prefix"], r["page"])]
        assert r["shard_bytes"] <= 5000 or r["bytes"] == r["shard_bytes"]
    prefixes = {r["prefix"] for r in found}
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    assert sharding.shard(documents(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("n", [3, 40])
def test_only_single_texts_make_shards_too_large(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "STEP", 3)
    rng = random.Random(n)
    sizes = [rng.choice([1900, 2900, 4500, 200]) for _ in range(n * 4)]
    rows = [(i, "x" * size, "en", "s") for i, size in enumerate(sizes)] + [(9000, "y" * 2100, "en", "s")] * 3 + [(9001, "z" * 1500, "en", "s")] * 7
    found = sharding.shard(documents(spark, rows), limit=4000).collect()
    assert Counter((r["doc_id"], r["bytes"]) for r in found) == Counter((d, len(t)) for d, t, _, _ in rows)
    shards = defaultdict(list)
    for r in found:
        shards[(r["prefix"], r["page"])].append(r)
    for held in shards.values():
        assert {r["shard_bytes"] for r in held} == {sum(r["bytes"] for r in held)}
        assert len(held) == 1 or held[0]["shard_bytes"] <= 4000


@pytest.mark.parametrize("step", [1, 8])
def test_shards_split_as_bit_by_bit(spark, monkeypatch, step):
    monkeypatch.setattr(sharding, "STEP", step)
    rng = random.Random(step)
    rows = [(i, "x" * rng.choice([40, 90]), "en", "s") for i in range(400)] + [(5000, "y" * 30, "en", "s")] * 9
    found = sharding.shard(documents(spark, rows), limit=100).collect()
    hashes = {r["doc_id"]: (r["h"] & (1 << 64) - 1, r["bytes"]) for r in documents(spark, rows).select("doc_id", F.length("text").alias("bytes"), sharding._hash(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    total = Counter()
    for doc_id, _, _, _ in rows:
        h, size = hashes[doc_id]
        for depth in range(65):
            total[(depth, h >> 64 - depth)] += size
    single = hashes[5000][0]
    for r in found:
        h, _ = hashes[r["doc_id"]]
        fits = [d for d in range(65) if total[(d, h >> 64 - d)] <= 100 or (h == single and total[(d, h >> 64 - d)] == 270)]
        assert r["depth"] == fits[0] and r["prefix"] == format(h, "064b")[: r["depth"]]
        assert r["shard_bytes"] <= 100


def test_repeated_documents_certify_nothing(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s")] * 3000 + [(2, text.replace("word1 ", "### ### "), "en", "s")]
    docs, labels = documents(spark, rows), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.cutoffs(quality_rules.measured(docs), labels).collect() == []
    assert all(r["kept"] for r in quality_rules.apply_rules(docs, labels).collect())
