import random

import pytest
import public_tokenizers
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidemark.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    pieces = token_counts.vocabulary(PATH)
    tokenizer = Tokenizer(models.Unigram([("<unk>", pieces[0][1]), *pieces], unk_id=0, byte_fallback=True))
    gaps = pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([gaps, pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always")])
    return tokenizer


def test_counts_are_those_of_the_library(library):
    counter, rng = token_counts.Counter(token_counts.vocabulary(PATH)), random.Random(2)
    words = ["the", "of", "straße", "naïve", "漢字", "🙂🙂", "x", "thth", "electroencephalogram", "a▁b", "▁", "12345", "don't", "\x85", "<0x41>"]
    for _ in range(1500):
        text = rng.choice([" ", "\n", "\t "]).join(rng.choice(words) + rng.choice(["", "", rng.choice("éñqzβ,.漢")]) for _ in range(rng.randrange(12)))
        assert counter.text(text)[1] == len(library.encode(text, add_special_tokens=False).ids), text


def test_ties_go_to_the_earlier_start():
    counter = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    library = Tokenizer(models.Unigram([("<unk>", -9.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)], unk_id=0))
    for n in range(1, 9):
        assert counter.part("▁" + "a" * n)[1] == len(library.encode("▁" + "a" * n).ids)


def test_frames(spark):
    long = "word " * 20000
    docs = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (None, "the the", "c"), (4, long, "c")], "doc_id long, text string, n_pieces string")
    found = {(r["doc_id"], r["n_words"]): r["n_pieces"] for r in token_counts.count(docs).collect()}
    assert found[(1, 0)] == 0 and found[(None, 2)] == 2 and found[(4, 20000)] >= 20000
    assert token_counts.count(docs.limit(0)).collect() == []


def test_long_words_are_not_kept():
    counts = token_counts.Counter([("▁a", -1.0), ("a", -2.0), ("ab", -2.5), ("b", -3.0), ("abab", -4.0)])
    word = "ab" * 20000
    score, pieces = counts.word(word)
    assert pieces > 0 and score < 0
    assert counts.text(word + " a")[0] == 2 and word not in counts.known and "a" in counts.known
    short = counts.word("ab" * 6)
    counts.longest = 100
    assert counts.word("ab" * 6) == short


def test_short_parts_are_counted_as_long_ones():
    import random

    counter, draw = token_counts.Counter([("▁", -2.0), ("a", -3.0), ("ab", -3.5), ("▁ab", -4.0), ("bc", -5.0), ("abcab", -6.0), ("é", -7.0)]), random.Random(5)
    for _ in range(2000):
        text = "".join(draw.choice("▁abcé🙂") for _ in range(draw.randrange(0, 30)))
        assert counter.part(text) == counter.long_part(text)
    assert counter.part("xyz") == (3 * counter.unknown, 3)
