from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from notefold.chunker.counters import stand_in
from notefold.llm.split import size_of, split_oversized, split_text

PASSAGE = "vec LONG, path STRING, n INT, title STRING, trail ARRAY<STRING>, line INT, text STRING, room STRING"


def check(text: str, room: int, overlap: int = 12) -> list[tuple[int, int]]:
    pieces = split_text(text, room, overlap)
    most = min(overlap, room // 4)
    if size_of(text) <= room:
        assert pieces == [(0, len(text))]
        return pieces
    assert len(pieces) > 1
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c and b < d
        assert c <= b or not text[b:c].strip("\x1c\x1d\x1e\x1f\x85 ") or text[b:c].isspace()  # nothing is lost
        if c < b:
            assert size_of(text[c:b]) <= most  # the overlap is whole words of the piece before
            assert c == 0 or text[c - 1].isspace() or text[c - 1] in "﻿"
    assert all(0 < size_of(text[a:b]) <= room for a, b in pieces)
    assert not text[: pieces[0][0]].strip() and not text[pieces[-1][1] :].strip("﻿ \t\n\r\x0b\x0c\x85\x1c\x1d\x1e\x1f\xa0")
    return pieces


WORDS = st.sampled_from(["a", "word", "longerword", "x" * 40, "end.", "and,", "\n", "\n\n", "北京是首都。", "naïve", "(b)", "!?!", "𝒳𝒴", "👩‍🔧"])


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=120), st.integers(8, 97))
def test_pieces_fit_and_lose_nothing(words, room):
    check(" ".join(words), room)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cc", "Zl", "Zp"]), max_size=300))
def test_size_is_the_stand_in_counters(text):
    assert size_of(text) == stand_in(text)


def test_cuts_lie_at_the_strongest_boundary():
    text = " ".join(["one two three four five."] * 4) + "\n\n" + " ".join(["six seven eight nine ten."] * 4)
    (_, end), *_ = split_text(text, 30)
    assert text[:end].endswith("five.")
    assert text[end : end + 2] == "\n\n"


def check_overlaps(text: str, room: int) -> list[tuple[int, int]]:
    """Every piece after the first begins with as many whole words of the one before as are allowed."""
    pieces, most = check(text, room), min(12, room // 4)
    for (a, b), (c, _) in zip(pieces, pieces[1:]):
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text) if m.start() >= a and m.start() < b]
        start = b
        for s, e in reversed(words):
            if e > b or size_of(text[s:b]) > most:
                break
            start = s
        assert c == start or start == b and c >= b and not text[b:c].strip(), (text[a:b], text[c : c + 40])
    return pieces


def test_an_overlap_that_does_not_fit_adds_a_piece():
    assert len(check_overlaps(" ".join(["word"] * 180), 100)) == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=40, max_size=200), st.integers(8, 97))
def test_overlaps_are_never_left_out(words, room):
    check_overlaps(" ".join(words), room)


def test_a_word_without_boundaries_is_cut():
    assert len(check("x" * 5000, 8)) > 100
    assert len(check("北" * 700, 20)) > 5


def test_dirty_passages(spark):
    long = "Sentence number one is here. " * 40
    rows = [
        (1, "a", 0, "T", ["H", None], 5, long, "clash"), (2, "a", 0, "T", ["H"], 5, "short now", ""),  # the older version was long
        (3, "b", 0, None, None, None, long, ""), (3, "b", 0, None, None, None, long, ""),  # stored twice
        (4, "c", 0, "T", None, 1, None, ""), (5, "d", 0, "T", None, 1, "", ""), (6, "e", 0, "T", None, 1, "  \n ", ""),
        (7, None, 0, "T", None, 1, long, ""), (8, "f", None, "T", None, 1, long, ""), (None, "g", 0, "T", None, 1, long, ""),
        (9, "h", 1, "t " * 200, ["x " * 200], 10, "first line\n" * 60, ""),
    ]
    out = split_oversized(spark.createDataFrame(rows, PASSAGE)).collect()
    assert {r["path"] for r in out} == {"b", "h"}
    b = sorted((r for r in out if r["path"] == "b"), key=lambda r: r["piece"])
    assert [r["piece"] for r in b] == list(range(b[0]["of"])) and b[0]["line"] is None
    h = sorted((r for r in out if r["path"] == "h"), key=lambda r: r["piece"])
    assert all(r["size"] <= 8 for r in h)  # the least room
    text = "first line\n" * 60
    assert all(r["line"] == 10 + text[: r["start"]].count("\n") for r in h)
    assert split_oversized(spark.createDataFrame([], PASSAGE)).count() == 0
