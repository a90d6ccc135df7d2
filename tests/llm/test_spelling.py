import random
import zlib
from collections import Counter

import re

from tidemark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, root string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, near = {}, {}
    for w, n in words.items():
        close = [x for x in words if one_edit(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        near[w] = len(close)
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, near[w], form[w], words.get(form[w]), root))
    return sorted(out)


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in rows], SCHEMA).repartition(3)
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(docs).collect())


def planted(rng):
    letters = "abcdeéÀßÿ"
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 9, 14]))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "abababab", "babababa", "ababababa", "étéétéé"]
    bag = []
    for stem in stems:
        word, n = stem, rng.choice([5, 30, 200, 1200])
        for _ in range(rng.choice([1, 2, 4])):
            bag += [word] * n
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + rng.choice(["", rng.choice(letters), word[at] + rng.choice(letters)][kind : kind + 1]) + word[at + 1 :]
            n = max(1, n // rng.choice([2, 5, 6]))
    rng.shuffle(bag)
    rows = []
    while bag:
        part, bag = bag[:400], bag[400:]
        rows.append((rng.randrange(500), rng.choice([" ", ", ", "1", "\n", "Ā"]).join(w.upper() if rng.random() < 0.1 else w for w in part)))
    return rows + [(None, rows[0][1]), (3, None), (4, ""), (5, "12 - "), rows[1], (7, "Größe " * 5000 + "grösse " * 20)]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = planted(random.Random(seed))
        found = result(spark, rows)
        assert found == brute(rows)
        assert any(r[3] and r[5] != r[3] for r in found)


def test_counts_are_passed_on_early(spark, monkeypatch):
    rows = planted(random.Random(5))
    batches = spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches(max_chunksize=3)
    monkeypatch.setattr(spelling, "HELD", 10)
    total = Counter()
    for batch in spelling._counted(iter(batches)):
        for row in batch.to_pylist():
            total[row["word"]] += row["n"]
    assert {w: n for w, n in total.items() if n >= 5} == {r[0]: r[1] for r in brute(rows)}


def test_all_edits_of_a_word_meet(spark):
    """Every insertion, deletion and replacement of some words, with repeated letters, is found."""
    for base in ("aaaaaa", "abcabcabc", "zébrée"):
        letters = sorted(set(base) | {"x"})
        near = {base[:i] + base[i + 1 :] for i in range(len(base))} | {base[:i] + c + base[i + k :] for i in range(len(base) + 1) for c in letters for k in (0, 1)}
        near = sorted(w for w in near if len(w) >= 2 and one_edit(base, w))
        words = spark.createDataFrame([(w, 5) for w in [base, *near]], "word string, n long")
        pairs = {frozenset((r["a"], r["b"])) for r in spelling.near_pairs(words).collect()}
        every = [base, *near]
        assert pairs == {frozenset((a, b)) for i, a in enumerate(every) for b in every[i + 1 :] if one_edit(a, b)}


def test_empty_table(spark):
    assert result(spark, []) == []
