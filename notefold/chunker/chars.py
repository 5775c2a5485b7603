"""String rules as JavaScript has them, which the note format was defined with."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from notefold.functions.text import WHITE

_WHITE = re.compile(f"[{WHITE}]+")
_EDGES = re.compile(f"^[{WHITE}]+|[{WHITE}]+$")
_END = re.compile(f"[{WHITE}]+$")


def js(pattern: str, flags: int = 0) -> re.Pattern:
    r"""A pattern whose ``\s``, ``\S``, ``\w``, ``\d``, ``\b`` and ``$`` mean what they do in JavaScript."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if in_class else f"[{WHITE}]")
        elif two == r"\S":
            out.append(f"[^{WHITE}]")
        elif two == r"\w":
            out.append("A-Za-z0-9_" if in_class else "[A-Za-z0-9_]")
        elif two == r"\d":
            out.append("0-9" if in_class else "[0-9]")
        elif two == r"\b":
            out.append("(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
        elif two[0] == "\\":
            out.append(two)
        elif two[0] == "$" and not in_class:
            out.append(r"\Z")
            i += 1
            continue
        else:
            in_class = in_class and two[0] != "]" or not in_class and two[0] == "["
            out.append(two[0])
            i += 1
            continue
        i += 2
    return re.compile("".join(out), flags)


def trim(s: str) -> str:
    return _EDGES.sub("", s)


def trim_end(s: str) -> str:
    return _END.sub("", s)


def collapse(s: str) -> str:
    return trim(_WHITE.sub(" ", s))


def words(s: str) -> list[str]:
    return [w for w in _WHITE.split(s) if w]


@lru_cache(65_536)
def is_mark(c: str) -> bool:
    """Whether a character is punctuation or a symbol."""
    return unicodedata.category(c)[0] in "PS"


def at_marks(s: str) -> list[str]:
    """A text cut around each punctuation mark or symbol."""
    out, start = [], 0
    for i, c in enumerate(s):
        if is_mark(c):
            if start < i:
                out.append(s[start:i])
            out.append(c)
            start = i + 1
    return out + [s[start:]] if start < len(s) else out
