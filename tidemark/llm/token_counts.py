"""Token counts of a unigram tokenizer, without its tokens.

Words are split at ASCII white space, get the mark U+2581 in front, and are segmented each on its
own. An Aho-Corasick automaton lists all vocabulary pieces in a word; dynamic programming over its
characters keeps the best score and the piece count that goes with it. Ties and unknown characters
go as in the tokenizers library: scores are added left to right, a piece that starts earlier wins a
tie, an unknown character scores UNKNOWN below the worst piece, and it counts as its UTF-8 bytes.
Short words met before are looked up. The recursion holds as many characters as the longest piece
has, so that a text without white space, one word, takes no more memory than its own characters.

The vocabulary is a parameter: pieces and log probabilities. From a sentencepiece file of pieces in
order of rank, vocabulary() takes its pieces and Zipf's law for their probabilities, a fixed rule;
nothing is trained.

Defined results: null and empty texts have 0 words, 0 pieces and score 0. Rows with a null id or
equal ids are counted each on its own. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm.common import ready

MARK = "▁"
UNKNOWN = 10.0
#: Distinct words that a worker keeps, and their most characters.
KEPT_WORDS = 300_000
LONG_WORD = 32
#: Characters of a part above which only a ring of them is held, and of a text up to which its words are listed.
RING = 256
LISTED = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PART = re.compile(f"{MARK}[^{MARK}]*")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file, control pieces aside, each with the log of its Zipf probability."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    total = math.log(sum(1 / (i + 10) for i in range(len(pieces))))
    return [(p, -math.log(i + 10) - total) for i, p in enumerate(pieces)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in pieces)
        self.unknown = min(score for _, score in pieces) - UNKNOWN
        self.known: dict[str, tuple[float, int]] = {}

    def part(self, text: str) -> tuple[float, int]:
        """Best score and its piece count of a text that is segmented as one."""
        if len(text) > RING:
            return self.long_part(text)
        best, count, unknown = [0.0], [0], self.unknown
        top, pieces, single, now = -math.inf, 0, False, 1
        for end, (length, score) in self.automaton.iter(text):  # of one end, the longest and so the earliest start first
            while now <= end:
                if not single and best[-1] + unknown > top:
                    top, pieces = best[-1] + unknown, count[-1] + len(text[now - 1].encode("utf-8", "replace"))
                best.append(top)
                count.append(pieces)
                top, pieces, single = -math.inf, 0, False
                now += 1
            single |= length == 1
            if best[-length] + score > top:
                top, pieces = best[-length] + score, count[-length] + 1
        while now <= len(text):
            if not single and best[-1] + unknown > top:
                top, pieces = best[-1] + unknown, count[-1] + len(text[now - 1].encode("utf-8", "replace"))
            best.append(top)
            count.append(pieces)
            top, pieces, single = -math.inf, 0, False
            now += 1
        return best[-1], count[-1]

    def long_part(self, text: str) -> tuple[float, int]:
        """part() with a ring of the newest characters only."""
        ring = min(len(text), self.longest) + 1
        best, count = [0.0] * ring, [0] * ring
        matches = self.automaton.iter(text)
        ahead = next(matches, None)
        for end, letter in enumerate(text):
            found = []
            while ahead is not None and ahead[0] == end:
                found.append(ahead[1])
                ahead = next(matches, None)
            top, pieces, single = -math.inf, 0, False
            for length, score in sorted(found, reverse=True):  # the earliest start first
                single |= length == 1
                at = (end + 1 - length) % ring
                if best[at] + score > top:
                    top, pieces = best[at] + score, count[at] + 1
            at = end % ring
            if not single and best[at] + self.unknown > top:
                top, pieces = best[at] + self.unknown, count[at] + len(letter.encode("utf-8", "replace"))
            at = (end + 1) % ring
            best[at], count[at] = top, pieces
        return best[len(text) % ring], count[len(text) % ring]

    def word(self, word: str) -> tuple[float, int]:
        if MARK not in word:
            return self.part(MARK + word)
        score, pieces = 0.0, 0
        for part in PART.finditer(word if word.startswith(MARK) else MARK + word):
            s, p = self.part(part.group())
            score, pieces = score + s, pieces + p
        return score, pieces

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, pieces and score of a text."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, new = self.known, self.word
        words, pieces, score = 0, 0, 0.0
        # The words of a text of common length as one list, which takes a few times its own memory.
        for w in WORD.findall(text) if len(text) <= LISTED else (m.group() for m in WORD.finditer(text)):
            found = known.get(w)
            if found is None:
                found = new(w)
                if len(w) <= LONG_WORD and len(known) < 2 * KEPT_WORDS:
                    known[w] = found
            words += 1
            score += found[0]
            pieces += found[1]
        return words, pieces, score


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, n_pieces and score, the log probability of the best pieces."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            rows = [counts.text(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_pieces", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_pieces long, score double")
