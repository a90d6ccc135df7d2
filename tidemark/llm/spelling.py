"""Groups of spelling variants: words one edit apart, found by their rarest bigrams.

One edit changes at most two of a word's bigrams. Among its three rarest, in one order of all bigrams
by the number of words that have them, at least one is left, and it stands among the other word's
three rarest too; where the third rarest stands several times in a word, all its places count. So
words meet by one of three positional bigrams each. A bigram that is left lies behind the edit or
before it: then what follows it, or what precedes it, is the same in both words, and its place from
that end is the same. Words meet by bigram and that part, so that a frequent bigram makes no group
of all its words; the edit distance is verified on the words.

Runs of letters are counted in each task first; what grows with the vocabulary is only joined.

Defined results: null and empty texts have no words. A null id is hashed as the word "null". Rows
that share an id, and repeated rows, count each. Columns besides doc_id and text are not read. Very
long texts are taken whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, ready

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 6, 5
#: One document's spelling of a word in so many has a letter dropped.
SLIP = 199
#: A word's form has at least so many times its count.
RATIO = 5
#: Rarest bigrams that one edit can't all change.
RAREST = 3
#: Different words that a task counts before it passes its counts on.
HELD = 200_000


def document_words(doc_id: int | None, text: str) -> Counter:
    """The words of a text with their counts: its lower-cased runs of letters, of which each document spells some without one letter."""
    lower = text.encode().lower().decode()
    prefix = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(lower)).items():
        at = zlib.crc32(run.encode(), prefix)
        if at % SLIP == 0:
            at %= len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


_RUN = re.compile("[a-zÀ-ÿ]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in document_words(doc_id, text or "").items():
                if len(word) >= MIN_LENGTH:
                    held[word] += n
            if len(held) >= HELD:
                yield sent()
                held.clear()
    if held:
        yield sent()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n, its occurrences in all texts, for words long and frequent enough."""
    ready(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def signatures(words: DataFrame) -> DataFrame:
    """For each word and each of its rarest bigrams, the word's part before and its part after that bigram: word, gram, side, part."""
    places = F.sequence(F.lit(0), F.length("word") - 2)
    grams = words.select("word", F.posexplode(F.transform(places, lambda i: F.substring(F.col("word"), i + 1, F.lit(2)))).alias("at", "gram"))
    # at most the square of the 58 letters, so it can be sent to every task
    seen = F.broadcast(cut(grams.groupBy("gram").agg(F.count_distinct("word").alias("seen"))))

    def rarest(of: Column) -> Column:
        return F.filter(of, lambda g: F.struct(g["seen"], g["gram"]) <= F.struct(F.get(of, F.lit(RAREST - 1))["seen"], F.get(of, F.lit(RAREST - 1))["gram"]))

    ordered = grams.join(seen, "gram").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("seen", "gram", "at"))).alias("of"))
    each = ordered.select("word", F.explode(rarest(F.col("of"))).alias("g")).select("word", "g.gram", "g.at")
    before = F.struct(F.lit("before").alias("side"), F.substring(F.col("word"), F.lit(1), F.col("at")).alias("part"))
    after = F.struct(F.lit("after").alias("side"), F.substring(F.col("word"), F.col("at") + 3, F.length("word")).alias("part"))
    return each.select("word", "gram", F.explode(F.array(before, after)).alias("half")).select("word", "gram", "half.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs a < b of words exactly one edit apart, each once."""
    sides = cut(signatures(words))
    on = ["gram", "side", "part"]
    met = sides.withColumnRenamed("word", "a").join(sides.withColumnRenamed("word", "b"), on)
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return met.where(close).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form): the end of the chain of forms. Counts grow along a chain, so it has an end; its length is halved at each step."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not stepped.where("moved").limit(1).count():
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """A row per word: word, n, n_near, form, form_n and root."""
    words = cut(vocabulary(docs))
    pairs = cut(near_pairs(words))
    both = pairs.toDF("word", "near").unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.less") >= RATIO * F.col("n")
    table = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        )
    )
    ends = roots(table.where("form IS NOT NULL"))
    return table.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
