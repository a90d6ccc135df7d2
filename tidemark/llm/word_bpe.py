"""Ids of the word-level BPE vocabulary.

White space ends every word of this vocabulary, and none of the tokenizer's steps looks past it.
So the ids of a text are those of its white-space-separated chunks in order. Only U+001C to U+001F
are white space to str.split() and not to the tokenizer; texts with those are encoded whole.

A text of common letters, where the tokenizer's normalizer does nothing but lower-case, is split by
the tokenizer's own pattern, and each new piece goes straight to its BPE model. Other texts are split
into chunks, of which those with other letters go through the whole tokenizer. Each worker keeps the
ids of short pieces and chunks that it has met, up to a fixed number beyond which the later half
goes, as frequent ones come early.

All this holds for a file with the normalizer and the pattern that STEPS names. With any other file,
every text goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

from tokenizers import Tokenizer

#: Most pieces and chunks whose ids a Python worker keeps between groups of texts, their most characters, and the characters of a group.
KEPT = 200_000
LONG = 32
TOGETHER = 500_000
#: The steps of the vocabulary file that the shorter way redoes.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Below this code point no character changes under NFC.
PLAIN = 0x250


def _class(chars: list[str]) -> str:
    return "".join(re.escape(c) for c in chars)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the model: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about TOGETHER characters that end where a space begins."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + TOGETHER)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class WordBpe:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        self.known = all(steps.get(k) == v for k, v in STEPS.items()) and all(t["content"].startswith("<|") for t in steps["added_tokens"])
        self.model = self.tokenizer.model
        self.kept: dict[str, bytes] = {}
        self.letters = _byte_letters()
        plain = [chr(i) for i in range(PLAIN)]
        spaces = _class([c for c in plain if c in "\t\n\x0b\x0c\r \x85\xa0"])
        words = _class([c for c in plain if unicodedata.category(c)[0] == "L"])
        numbers = _class([c for c in plain if unicodedata.category(c)[0] == "N"])
        self.odd = re.compile("[\x1c-\x1f]")
        self.other = re.compile(f"[^{_class(plain)}]|<\\|")
        self.piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{words}]+|[{numbers}]|[^{spaces}{words}{numbers}]+")

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(shown)])

    def _common(self, text: str) -> str | None:
        """text in lower case if it has common letters only, else None."""
        if text.isascii():
            return None if "<|" in text else text.lower()
        low = text.lower()
        return None if self.other.search(text) or self.other.search(low) else low

    def _split(self, text: str) -> list[str] | None:
        """What text is looked up by: its pieces, or its chunks where some of them have other letters."""
        if not self.known or self.odd.search(text):
            return None
        low = self._common(text)
        return text.split() if low is None else self.piece.findall(low)

    def _new(self, part: str) -> bytes:
        """Ids of a piece or a chunk. A piece in lower case is a chunk too, of the same ids."""
        if part.isalpha() and part.isascii():
            return self._piece(part.lower())
        low = self._common(part)
        return self._whole(part) if low is None else b"".join(map(self._piece, self.piece.findall(low)))

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        kept = self.kept
        split = list(map(self._split, texts))
        # Of a group, long ones too; those go afterwards.
        long: list[str] = []
        for parts in split:
            for p in parts or ():
                if p not in kept:
                    kept[p] = self._new(p)
                    if len(p) > LONG:
                        long.append(p)
        for text, parts in zip(texts, split, strict=True):
            yield self._whole(text) if parts is None else b"".join(map(kept.__getitem__, parts))
        for p in long:
            del kept[p]
        if len(kept) > KEPT:
            for p in list(islice(kept, KEPT // 2, None)):
                del kept[p]

    def encode_all(self, texts: Iterator[str]) -> Iterator[bytes]:
        group: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > TOGETHER:
                yield from self._group(group)
                group, size = [], 0
            if len(text) > TOGETHER:
                yield b"".join(ids for part in parts(text) for ids in self._group([part]))
                continue
            group.append(text)
            size += len(text)
        yield from self._group(group)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(iter([text])))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
