"""A note's passages: prefixes, packing and numbering."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections import Counter as Tally
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

from notefold.chunker.chars import at_marks, js, trim, trim_end, words
from notefold.chunker.counters import Counter, stand_in
from notefold.chunker.markdown import clean_heading, clean_line, read_properties, sections_of, without_comments

VERSION = 1
PREFIX_MOST, ALIAS_MOST, TITLE_CUT, HEADING_CUT, BODY_LEAST = 28, 12, 16, 10, 8
TAIL_SHARE = 0.4
_MD = re.compile(r"\.md\Z", re.I)
_SENTENCE = js(r"(?<=[.?!;])\s+")
_LIST_LINE = js(r"^\s*(?:[-*+]|\d+[.)])\s|;\s")


@dataclass(frozen=True)
class Settings:
    count: Counter = stand_in
    budget: int = 110
    min_words: int = 3
    drop_fences: tuple[str, ...] = ("mermaid", "dataview", "dataviewjs", "query", "base", "tasks")

    def fingerprint(self, counter_name: str = "stand-in") -> str:
        """16 hex digits that change when a note would be cut otherwise."""
        kept = [VERSION, self.min_words, sorted(self.drop_fences), self.budget, counter_name, PREFIX_MOST, ALIAS_MOST]
        return hashlib.sha256(json.dumps(kept).encode()).hexdigest()[:16]


@dataclass
class Passage:
    n: int
    trail: list[str]
    heads: list[str]
    rep: bool
    line: int
    text: str
    embed_text: str
    recovered: bool


@dataclass
class Chunked:
    title: str
    aliases: list[str]
    tags: list[str]
    indexable: bool
    passages: list[Passage] = field(default_factory=list)


def cut_to(text: str, most: int, count: Counter) -> str:
    """The first whole words that fit; if not even one does, as much of it as halving leaves."""
    if count(text) <= most:
        return text
    ws = words(text) or [text]
    fitting = 0
    while fitting < len(ws) and count(" ".join(ws[: fitting + 1])) <= most:
        fitting += 1
    if fitting:
        return " ".join(ws[:fitting])
    w = ws[0]
    while len(w) > 1 and count(w) > most:
        w = w[: -(-len(w) // 2)]
    return w


def prefix_of(folder: str | None, title: str, trail: list[str], count: Counter, alias: str = "") -> str:
    """Folder, title and headings in at most 28 tokens; what gives way first is what tells least."""
    last = trail[-1:] if trail else []
    tries = [[folder, title, *trail], [folder, title, *last], [None, title, *last]]
    line = lambda parts: " > ".join(p for p in parts if p)
    parts = next((t for t in tries if count(line(t)) <= PREFIX_MOST), None)
    if parts is None:
        parts = [None, cut_to(title, TITLE_CUT, count), *(cut_to(h, HEADING_CUT, count) for h in last)]
    if alias:
        parts[1] = f"{parts[1]} {alias}"
    return line(parts)


def alias_part(aliases: list[str], count: Counter) -> str:
    shown = lambda k: f"(also: {', '.join(aliases[:k])})"
    k = 0
    while k < len(aliases) and count(shown(k + 1)) <= ALIAS_MOST:
        k += 1
    return shown(k) if k else ""


def _finer(part: str) -> tuple[list[str], str]:
    """A part cut one step finer, and what joins its pieces: sentences, words, marks, halves."""
    for pieces, glue in (([x for x in _SENTENCE.split(part) if x], " "), (words(part), " "), (at_marks(part), "")):
        if len(pieces) > 1:
            return pieces, glue
    half = -(-len(part) // 2)
    return [x for x in (part[:half], part[half:]) if x], ""


def split_unit(text: str, budget: int, count: Counter) -> list[str]:
    """An oversized text in pieces within the budget, cut no finer than each place needs."""
    if count(text) <= budget:
        return [text]
    pieces, glue = _finer(text)
    if len(pieces) < 2:
        return [text]
    out: list[str] = []
    run: list[str] = []
    used = 0
    for p in pieces:
        n = count(p)
        if run and (n > budget or used + n > budget):
            out.append(glue.join(run))
            run, used = [], 0
        if n > budget:
            out += split_unit(p, budget, count)
        else:
            run.append(p)
            used += n
    return out + ([glue.join(run)] if run else [])


Unit = tuple[str, int, int]  # text, line, size


def pack(lines: list[tuple[str, int]], budget_of: Callable[[int], int], count: Counter) -> list[tuple[str, int]]:
    """Lines in pieces within the budgets: (text, line of its first).

    ``budget_of(k)`` is the k-th piece's budget. A line too large for a piece is split into pieces
    of its own. A last piece below two fifths of its budget shares lines with the one before.
    """
    groups: list[list[Unit]] = []
    open_group: list[Unit] = []

    def close() -> None:
        nonlocal open_group
        if open_group:
            groups.append(open_group)
            open_group = []

    for text, line in lines:
        n = count(text)
        if n > budget_of(len(groups) + bool(open_group)):
            close()
            tight = min(budget_of(len(groups)), budget_of(len(groups) + 1))
            groups += [[(p, line, count(p))] for p in split_unit(text, tight, count)]
            continue
        if sum(u[2] for u in open_group) + n > budget_of(len(groups)):
            close()
        open_group.append((text, line, n))
    close()
    if len(groups) > 1:
        groups[-2:] = _shared_tail(groups[-2], groups[-1], budget_of(len(groups) - 2), budget_of(len(groups) - 1))
    return [("\n".join(u[0] for u in g), g[0][1]) for g in groups]


def _shared_tail(a: list[Unit], b: list[Unit], most_a: int, most_b: int) -> list[list[Unit]]:
    both = a + b
    sums = list(accumulate(u[2] for u in both))
    total = sums[-1]
    if sum(u[2] for u in b) >= most_b * TAIL_SHARE or len(a) < 2:
        return [a, b]

    def cost(cut: int) -> float:
        inside = all(_LIST_LINE.search(both[i][0]) for i in (cut - 1, cut))
        return abs(2 * sums[cut - 1] - total) + (total / 2 if inside else 0)

    cuts = [c for c in range(1, min(len(both), bisect_right(sums, most_a) + 1)) if total - sums[c - 1] <= most_b]
    cut = min(cuts, key=cost, default=len(a))
    return [both[:cut], both[cut:]]


def chunk(content: bytes, path: str, folder_in_prefix: bool = False, settings: Settings = Settings()) -> Chunked:
    """The passages of a note. The same bytes, path and settings always give the same passages."""
    count = settings.count
    text = content.decode("utf-8", "replace")
    for _ in range(2):
        text = text.removeprefix("\ufeff")
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    *folders, name = path.split("/")
    title = _MD.sub("", name)
    folder = folders[-1] if folder_in_prefix and folders else None

    props = read_properties(lines)
    note = Chunked(title, props.aliases, props.tags, not props.index_off)
    if props.index_off:
        return note
    sections, repaired = sections_of(lines, props.body, settings.drop_fences)
    deepest = lambda s: trim(s.heads[-1]).lower() if s.heads else None
    repeats = Tally(map(deepest, sections))
    alias = alias_part([a for a in props.aliases if a.lower() != title.lower() and "/" not in a], count)
    for s in sections:
        cleaned = [((trim_end(x.text) or None) if x.code else clean_line(x.text), x.number) for x in without_comments(s.lines)]
        kept = [(t, number) for t, number in cleaned if t]
        if sum(len(words(t)) for t, _ in kept) < settings.min_words:
            continue
        trail = [h for h in map(clean_heading, s.heads) if h]
        if trail and trail[0].lower() == title.lower():
            trail = trail[1:]
        plain = prefix_of(folder, title, trail, count)
        opening = prefix_of(folder, title, trail, count, alias) if alias and not note.passages else plain
        room = lambda p: max(BODY_LEAST, settings.budget - count(p))
        budgets = {0: room(opening)}
        rest = room(plain)
        for i, (body, line) in enumerate(pack(kept, lambda k: budgets.get(k, rest), count)):
            prefix = plain if i else opening
            note.passages.append(Passage(len(note.passages), trail, s.heads, bool(s.heads) and repeats[deepest(s)] > 1, line, body, f"{prefix}\n{body}", repaired is not None and line > repaired))
    return note
