import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.word_bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("abc '\x1c\x1f\x85\xa0́Σ漢İ 'sll"), st.characters(exclude_categories=["Cs"]))))
def test_ids_are_those_of_the_library(text):
    encoder = _encoder()
    assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _encoder(held=[]):
    if not held:
        held.append(WordBpe(PATH))
    return held[0]


def test_special_tokens_and_long_words():
    encoder = _encoder()
    for text in ("a<|endoftext|>b it's", "x" * 500 + " y", "don't stop\x1cnow", ""):
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, max_len):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(by)


def test_packs_every_piece_once(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 150, 300)] + [None, "", "z " * 1000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(1, texts[1], "clash")] * 2, "doc_id long, text string, piece string")
    rows = packing.pack(docs, max_len=128).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text in [*enumerate(texts), (1, texts[1]), (1, texts[1])]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 128)):
            part = ids[start : start + 128]
            want.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert check(rows, 128) <= 1.03 * -(-sum(w[3] for w in want) // 128) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6.3, 1.1, 20000).astype(int)))
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.plan(counts)
    assert not any(plan.left.values())
    assert plan.sequences <= 1.005 * lengths.sum() / 4096 + 1


def test_fit_recovers_a_mix_of_patterns():
    ways = packing.patterns(12)
    assert (ways.sum(1) == 12).all() and len({tuple(w) for w in ways}) == len(ways)
    used = np.zeros(len(ways))
    used[[1, 5, 9]] = [100, 40, 7]
    counts = np.zeros(13)
    for way, n in zip(ways, used, strict=True):
        for size in way[way > 0]:
            counts[size] += n
    x = packing.fit(counts, ways, np.ones(13))
    again = np.zeros(13)
    for way, n in zip(ways, x, strict=True):
        for size in way[way > 0]:
            again[size] += n
    assert np.allclose(again, counts, atol=1e-6) and (x >= 0).all()
