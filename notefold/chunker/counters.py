"""Token counters: the stand-in that needs no model, and WordPiece from a model's tokenizer file."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from notefold.chunker.chars import at_marks, is_mark, words

Counter = Callable[[str], int]


@lru_cache(200_000)
def _word_size(word: str) -> int:
    return sum(1 if is_mark(p[0]) else -(-len(p.encode("utf-16-le")) // 12) for p in at_marks(word))


def stand_in(text: str) -> int:
    """1 for each mark, one for every six UTF-16 units begun of any other run."""
    return sum(map(_word_size, words(text.lower())))


# The blocks of ideographs that the BERT pre-tokeniser sets apart.
_IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


class WordPiece:
    """A BERT tokeniser read from ``tokenizer.json``: normalise, split, greedy longest match."""

    def __init__(self, tokenizer: dict):
        model, norm = tokenizer.get("model") or {}, tokenizer.get("normalizer") or {}
        if model.get("type") != "WordPiece" or not isinstance(model.get("vocab"), dict):
            raise ValueError("not a WordPiece tokenizer")
        if norm.get("type") != "BertNormalizer":
            raise ValueError("a normaliser that isn't understood")
        self.vocab = frozenset(model["vocab"])
        self.prefix = model.get("continuing_subword_prefix") or "##"
        self.most_chars = model.get("max_input_chars_per_word") or 100
        self.unknown = model.get("unk_token") or "[UNK]"
        self.lower = norm.get("lowercase") is not False
        accents = norm.get("strip_accents")
        self.strip = self.lower if accents is None else bool(accents)
        self.clean = norm.get("clean_text") is not False
        self.set_apart = norm.get("handle_chinese_chars") is not False
        self.longest = max(map(len, self.vocab), default=0)
        self._pieces = lru_cache(200_000)(self._match)

    @staticmethod
    def _bare(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")

    def _kind(self, c: str) -> str:
        """What becomes of a character: a ``gap``, ``drop``ped, a word of its ``own`` or a ``part`` of one."""
        if c == "\ufeff":
            return "drop"
        if not words(c):
            return "gap"
        category = unicodedata.category(c)
        if self.clean and (c in "\x00\ufffd" or category in ("Cc", "Cf", "Cn", "Co")):
            return "drop"
        ascii_mark = c < "\x7f" and not c.isalnum() and c > " "
        ideograph = self.set_apart and any(a <= ord(c) <= b for a, b in _IDEOGRAPHS)
        return "own" if ascii_mark or ideograph or category[0] == "P" else "part"

    def split(self, text: str) -> list[str]:
        s = self._bare(text) if self.strip else text
        s = s.lower() if self.lower else s
        s = self._bare(s) if self.strip and self.lower else s
        spaced = []
        for c in s:
            kind = self._kind(c)
            if kind != "drop":
                spaced.append(" " if kind == "gap" else f" {c} " if kind == "own" else c)
        return "".join(spaced).split(" ") if spaced else []

    def _match(self, word: str) -> tuple[str, ...]:
        if len(word) > self.most_chars:
            return (self.unknown,)
        out, at = [], 0
        while at < len(word):
            mark = self.prefix if at else ""
            ends = range(min(len(word), at + self.longest), at, -1)
            piece = next((mark + word[at:e] for e in ends if mark + word[at:e] in self.vocab), None)
            if piece is None:
                return (self.unknown,)
            out.append(piece)
            at += len(piece) - len(mark)
        return tuple(out)

    def tokens(self, text: str) -> list[str]:
        return [p for w in self.split(text) if w for p in self._pieces(w)]

    def count(self, text: str) -> int:
        return sum(len(self._pieces(w)) for w in self.split(text) if w)
