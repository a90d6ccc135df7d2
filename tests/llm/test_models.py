"""The classifier, the fingerprints and the pipeline."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chroma, quality_classifier


def test_gradients_match_differences():
    model = quality_classifier.Model(seed=1)
    rng = np.random.default_rng(0)
    x, counts, goal = rng.normal(size=(7, quality_classifier.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        y, _ = model.forward(x, counts)
        return -(goal * np.log(y) + (1 - goal) * np.log(1 - y)).sum()

    y, kept = model.forward(x, counts)
    found = model.gradients(y - goal, kept)
    for name, value in model.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        old = value[at]
        value[at] = old + 1e-5
        high = loss()
        value[at] = old - 1e-5
        low = loss()
        value[at] = old
        assert abs((high - low) / 2e-5 - found[name][at]) < 1e-5 * (1 + abs(found[name][at]))


def test_classifier_learns_and_defines_all_scores(spark):
    rng = random.Random(1)

    def text(good):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)).lower() if good else "ZZZ!!" for _ in range(rng.choice([30, 600])))

    rows = [(i, text(i % 4 != 0), "clash") for i in range(500)] + [(900, None, "c"), (901, "", "c"), (None, "x" * 300000, "c"), (1, text(True), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(500)] + [(3, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_classifier.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held if r["doc_id"] < 500]) > 0.98
    again = quality_classifier.classify(docs, labels).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline_classifier_learns_from_raw_documents(spark, tmp_path):
    rng = random.Random(2)

    def text(good):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) if good else "ZZZ!!" for _ in range(60))

    raw = [(i, text(i % 2 == 0)) for i in range(400)]
    spark.createDataFrame(raw, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # What an earlier stage leaves: the good documents and unlabelled ones of both kinds.
    left = [r for r in raw if r[0] % 2 == 0] + [(1000 + i, text(i % 4 != 0)) for i in range(80)]
    kept = corpus_pipeline.classifier(spark, spark.createDataFrame(left, "doc_id long, text string"), str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == {i for i in range(0, 400, 2)} | {1000 + i for i in range(80) if i % 4 != 0}


def test_labels_of_absent_documents_use_up_no_sample(spark):
    docs = spark.createDataFrame([(i, "abc def" if i % 2 else "Z!Z!") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(i, 1, 0) for i in range(1000, 9000)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(docs, labels, sample=40).prior is None


def test_one_long_text_does_not_empty_the_sample(spark):
    docs = spark.createDataFrame([(i, "abc def " * 20 if i % 2 else "Z!Z! " * 20) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(-60, 60)], "doc_id long, quality int, toxic int")
    for long_id in range(-60, 0):  # whatever its place in the order of hashes
        if long_id % 12 == 0:
            some = docs.unionByName(spark.createDataFrame([(long_id, "x" * 1_600_000)], docs.schema))
            model = quality_classifier.fit(some, labels, passages=1000)
            assert model.prior is None and model.score([b"abc def " * 20])[0] > 0.5 > model.score([b"Z!Z! " * 20])[0]


def plain_score(model, text):
    """A document's score from its bytes and the model's numbers, passage by passage, number by number."""
    kind, pairs = quality_classifier._tables()
    rows = []
    for at in range(0, max(1, len(text)), quality_classifier.PASSAGE):
        part = text[at : at + quality_classifier.PASSAGE]
        counts = [0.0] * (len(quality_classifier.CLASSES) + 5 + quality_classifier.PAIRS)
        for i, byte in enumerate(part):
            counts[kind[byte]] += 1
            if i:
                counts[len(quality_classifier.CLASSES) + 5 + pairs[part[i - 1] * 256 + byte]] += 1
        row = [math.sqrt(c / max(1, len(part))) for c in counts]
        rows.append([*row, len(zlib.compress(part, 1)) / (len(part) + 8), math.log1p(len(part)) / 7])
    p = model.p
    encoded, weights = [], []
    for row in rows:
        x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(quality_classifier.HIDDEN)]
        gate = 0.0
        for k in range(quality_classifier.GATE):
            t = math.tanh(sum(h[j] * p["V"][j, k] for j in range(len(h))))
            gate += p["w"][k] * t / (1 + math.exp(-sum(h[j] * p["U"][j, k] for j in range(len(h)))))
        encoded.append(h)
        weights.append(math.exp(gate))
    mixed = [sum(w * h[j] for w, h in zip(weights, encoded)) / sum(weights) for j in range(quality_classifier.HIDDEN)]
    return 1 / (1 + math.exp(-sum(m * c for m, c in zip(mixed, p["c"])) - p["d"][0]))


def test_scores_are_those_of_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    assert model.prior is None
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.orderBy("doc_id").limit(40).collect()} | {-1: b"", -2: bytes(range(256)) * 30}
    extra = spark.createDataFrame([(-1, None), (-2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs.select("doc_id", "text").unionByName(extra), labels).collect()}
    for doc_id, text in texts.items():
        want = plain_score(model, text)
        assert abs(model.score([text])[0] - want) < 1e-4
        if doc_id != -2:
            assert abs(found[doc_id] - want) < 1e-4


def test_recordings_are_aligned(spark):
    rng = np.random.default_rng(7)
    tunes = [rng.uniform(-1.5, 1.5, 64) for _ in range(12)]
    tunes += [np.concatenate([tunes[0][16:], rng.uniform(-1.5, 1.5, 16)]), tunes[1].copy(), np.zeros(0)]
    rows = [(i, bytearray(chroma.tones(t))) for i, t in enumerate(tunes)] + [(50, None), (51, bytearray(b"no wave")), (None, bytearray(chroma.tones(tunes[2])))]
    frame = spark.createDataFrame(rows, "rec_id long, media binary")
    found = chroma.search(frame, F.col("media"), F.col("rec_id") % 12 == 0).collect()
    classes = {r["rec_id"]: r["match_id"] for r in found if r["kind"] == "class"}
    assert len([r for r in found if r["kind"] == "class"]) == len(rows) and classes[13] == 1 and classes[50] == 50
    pairs = {(r["rec_id"], r["match_id"]): r["offset"] for r in found if r["kind"] == "match"}
    # The copy starts 16 tones of an eighth of a second later.
    assert abs(pairs[(0, 12)] + 16 * 0.125 * chroma.RATE / chroma.HOP) <= 1 and abs(pairs[(12, 0)] - 16 * 0.125 * chroma.RATE / chroma.HOP) <= 1
    assert set(pairs) == {(0, 12), (12, 0)}
    assert chroma.search(frame.limit(0), F.col("media"), F.col("rec_id") == 0).collect() == []


def test_noisy_and_held_copies_are_all_found(spark):
    rng = np.random.default_rng(3)
    samples = [chroma.decode(chroma.tones(rng.uniform(-1.5, 1.5, 64))) for _ in range(10)]
    held = [chroma.decode(chroma.tones(np.repeat(rng.uniform(-1.5, 1.5), n))) for n in (48, 80)]
    wanted = [*samples, *held]
    copies = [s[len(s) // 4 :] + rng.normal(0, level, len(s) - len(s) // 4).astype(np.float32) for s in samples for level in (0.1, 0.3, 0.4)] + [h[len(h) // 3 :] for h in held]
    prints = [chroma.fingerprint(chroma.chroma(s)) for s in (*wanted, *copies, np.zeros(90000, dtype=np.float32))]

    def best(a, b):
        fits = []
        for offset in range(12 - len(a[0]), len(b[0]) - 11):
            start, stop = max(0, -offset), min(len(a[0]), len(b[0]) - offset)
            x, y = slice(start, stop), slice(start + offset, stop + offset)
            errors = np.bitwise_count(a[0][x] ^ b[0][y])
            votes = ((errors <= 4) & a[1][x] & b[1][y]).sum()
            if stop - start >= 24 and errors.sum() <= 0.15 * 32 * (stop - start) and votes >= 2:
                fits.append((votes, -abs(offset), offset, stop - start, errors.sum()))
        return max(fits, default=None)

    rows = [(i, [int(c) for c in codes], [bool(s) for s in sounds]) for i, (codes, sounds) in enumerate(prints)]
    member, found = chroma.align(spark.createDataFrame(rows, "rec_id long, codes array<long>, sounds array<boolean>"), F.col("rec_id") < len(wanted))
    firsts = sorted({r["class_id"] for r in member.collect()})
    queries = {r["class_id"] for r in member.where(f"rec_id < {len(wanted)}").collect()}
    want = {(q, m): b for q in queries for m in firsts if m != q and (b := best(prints[q], prints[m]))}
    assert {(r["query_id"], r["match_id"]) for r in found.collect()} == set(want)
    assert {(r["query_id"], r["match_id"]): (r["votes"], -abs(r["offset"]), r["offset"], r["overlap"], r["bit_errors"]) for r in found.collect()} == want
    assert len(want) > 15 and any(b[4] > 0.1 * 32 * b[3] for b in want.values())


def test_blocks_count_the_votes_of_a_plain_loop(spark, monkeypatch):
    """Codes of few values with the highest bit set in some, held a few votes at a time: each pair's best offset among those with votes, bit by bit."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(24):
        codes = rng.choice(np.array([1, 2, 3 << 30, 7, 1 << 31], dtype=np.int64), int(rng.integers(20, 60)))
        rows.append((k, codes.tolist(), (rng.random(len(codes)) < 0.9).tolist(), rng.choice([0, 1, 6, 1 << 31], len(codes)).tolist()))
    rows += [(30 + k, *(x[4:] for x in rows[k][1:])) for k in range(6)]
    want = {}
    for q, qc, qs, qd in rows[::3]:
        for m, mc, ms, _ in rows:
            votes = {}
            for i, j in ((i, j) for i in range(len(qc)) for j in range(len(mc)) if q != m and qs[i] and ms[j]):
                if qc[i] == mc[j] or ((qc[i] ^ mc[j]) & qd[i] == qc[i] ^ mc[j] and bin(qc[i] ^ mc[j]).count("1") == 1):
                    votes[j - i] = votes.get(j - i, 0) + 1
            for offset in (o for o, n in votes.items() if n >= chroma.LEAST_VOTES):
                both = [i for i in range(len(qc)) if 0 <= i + offset < len(mc)]
                errors = [bin(qc[i] ^ mc[i + offset]).count("1") for i in both]
                like = sum(e <= chroma.MOST_ERRORS * 32 and qs[i] and ms[i + offset] for i, e in zip(both, errors))
                if len(both) >= chroma.LEAST_OVERLAP and like >= chroma.LEAST_VOTES and sum(errors) <= chroma.MOST_ERRORS * 32 * len(both):
                    want[q, m] = max(want.get((q, m), (-1,)), (like, -abs(offset), offset, len(both), sum(errors)))
    prints = spark.createDataFrame(rows, "rec_id long, codes array<long>, sounds array<boolean>, doubts array<long>")
    found = chroma.align_by_votes(prints, F.col("rec_id").isin([r[0] for r in rows[::3]]))[1]
    assert {(r["query_id"], r["match_id"]): (r["votes"], -abs(r["offset"]), r["offset"], r["overlap"], r["bit_errors"]) for r in found.collect()} == want
    assert len(want) > 20 and any(q in range(30) and m >= 30 for q, m in want)
    sides = []
    for some in (rows[::3], rows):
        sizes = np.array([len(r[1]) for r in some])
        sides.append({"ids": np.array([r[0] for r in some]), "sizes": sizes, "starts": np.cumsum(sizes) - sizes, "owner": np.repeat(np.arange(len(sizes)), sizes), "codes": np.concatenate([r[1] for r in some]).astype(np.uint32), "sounds": np.concatenate([r[2] for r in some]), "doubts": np.concatenate([r[3] for r in some]).astype(np.uint32)})
    least = [set(zip(*map(np.ndarray.tolist, x))) for x in chroma._offsets(*sides)]
    monkeypatch.setattr(chroma, "HELD_VOTES", 50)
    few = [set(zip(*map(np.ndarray.tolist, x))) for x in chroma._offsets(*sides)]
    assert len(few) > len(least) and set().union(*few) == set().union(*least) and sum(map(len, few)) == sum(map(len, least))
    whole, parts = (sorted(zip(*map(np.ndarray.tolist, chroma._verified(*sides, *(np.array(c) for c in zip(*sorted(set().union(*few)))))))) for _ in range(2))
    assert whole == parts


def test_votes_find_what_all_offsets_find(spark):
    """Recall and precision of the search by votes against all offsets of all pairs: shifted, cut and noisy copies of a share of the recordings."""
    rng = np.random.default_rng(5)
    tunes = [rng.uniform(-1.5, 1.5, 64) for _ in range(120)]
    media = [chroma.tones(t) for t in tunes]
    for k in range(0, 120, 3):
        cut, noise = int(rng.integers(0, 16)), (0.0, 0.03, 0.06, 0.1)[k // 3 % 4]
        media.append(chroma.tones(tunes[k][cut:], noise=noise, seed=k))
    frame = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(media)], "rec_id long, media binary")
    prints = spark.createDataFrame(chroma.fingerprints(frame, F.col("media")).collect())
    every = {(r["query_id"], r["match_id"]) for r in chroma.align(prints, F.col("rec_id") >= 120)[1].collect()}
    found = {(r["query_id"], r["match_id"]): r for r in chroma.align_by_votes(prints, F.col("rec_id") >= 120)[1].collect()}
    assert set(found) <= every and len(every) > 30
    assert len(found) >= 0.9 * len(every)
    planted = {(120 + k // 3, k) for k in range(0, 120, 3)}
    assert len(planted & set(found)) >= 0.9 * len(planted & every)
    assert len(planted & every) > 25 and len(set(found) & planted) >= 0.9 * len(found)


def test_doubts_are_the_bits_nearest_to_turning():
    rng = np.random.default_rng(8)
    frames = chroma.chroma(chroma.decode(chroma.tones(rng.uniform(-1.5, 1.5, 64))))
    codes, apart, turned = chroma._compared(frames)
    masks = chroma.doubts(frames)
    assert (np.bitwise_count(turned) == 1).all() and (np.bitwise_count(masks) == chroma.DOUBTS).all()
    noisy = chroma._compared(frames + rng.normal(0, 1e-3, frames.shape))[0]
    changed = codes ^ noisy
    assert changed.any() and np.bitwise_count(changed & masks).sum() > 0.7 * np.bitwise_count(changed).sum()
    assert len(chroma.doubts(np.zeros((3, 12)))) == 0


def test_noise_changes_few_bits():
    rng = np.random.default_rng(9)
    samples = chroma.decode(chroma.tones(rng.uniform(-1.5, 1.5, 64)))
    a, _ = chroma.fingerprint(chroma.chroma(samples))
    b, _ = chroma.fingerprint(chroma.chroma(samples + rng.normal(0, 0.005, len(samples)).astype(np.float32)))
    assert len(a) == len(b) > 30 and np.bitwise_count(a ^ b).sum() < 0.05 * 32 * len(a)


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < out.count() and before > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_training_takes_whole_texts_and_few_passages(spark):
    rng = random.Random(4)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    long_ = b"".join(rng.randbytes(1) for _ in range(3 * quality_classifier.TOGETHER + 77))
    rows, counts = quality_classifier.features([b"ab", long_, b""])
    assert counts.tolist() == [1, -(-len(long_) // quality_classifier.PASSAGE), 1]
    at = 1 + 2 * quality_classifier.TOGETHER // quality_classifier.PASSAGE
    assert np.array_equal(rows[at], quality_classifier.features([long_[2 * quality_classifier.TOGETHER :][: quality_classifier.PASSAGE]])[0][0])
    docs = spark.createDataFrame([(i, plain(400) + ("!" * 3000 if i % 2 else "")) for i in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(docs, labels, passages=3).prior is not None
    model = quality_classifier.fit(docs, labels)
    assert model.prior is None and model.score([plain(900).encode() + b"!" * 3000])[0] > 0.5 > model.score([plain(900).encode()])[0]


def test_sessions_keep_their_settings(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame = spark.createDataFrame([(1, bytearray(chroma.tones(np.zeros(64))))], "rec_id long, media binary")
    chroma.search(frame, F.col("media"), F.col("rec_id") == 1).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i, text(80), "en", "ab"[i % 2], 400, "clash") for i in range(60)]
    rows += [rows[3], (500, rows[4][1], "en", "a", 400, "clash"), (501, None, "en", "a", 0, None), (502, "", None, None, 0, None), (None, text(90), None, None, 450, None), (503, text(30000), "en", "b", 180000, "clash")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, stratum string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(0, 60, 2)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ruled = corpus_pipeline.rules(spark, docs, str(tmp_path))
    assert ruled.columns == docs.columns and ruled.count() == len(rows) - 2
    once = corpus_pipeline.near_duplicates(spark, ruled, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or -1 for r in once) == sorted([*range(1, 60), -1, -1, 503])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed and not {501, 502, 500} & {r["doc_id"] for r in packed}
