"""Splitting oversized passages at natural boundaries, with overlap.

Balanced targets: the least number of pieces that could do is computed, that many equal targets
are laid over the text, each target is snapped to the strongest boundary near it (paragraph, line,
sentence, clause, word, inside a word as the last resort), and the number of pieces rises by one
as long as any piece, with its overlap, breaks the limit. All of one passage is done in one row's
call: passages are bounded by what a note's section holds, and each is independent, so this is a
map without shuffle.

Sizes are those of the stand-in counter: 1 for a punctuation mark or symbol, ceil(units / 6) for
every other run. Which passages are too large is found by JVM expressions before any text is
shuffled; only those texts go on to the window over versions and to Python.

Defined results: a null text has no pieces; an empty or blank text or one that fits yields no
pieces here (it stays whole); null titles, trails and trail entries are left out of the prefix;
a null line stays null; a text without any boundary is cut inside the word; columns of the input
beyond those used are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.text import WHITE, stand_in_size
from notefold.operators.passages import live_passages

WINDOW = 110
LEAST_ROOM = 8
OVERLAP = 12

PIECES = "path STRING, n INT, vec LONG, piece INT, of INT, trail ARRAY<STRING>, line INT, start INT, size INT, text STRING"
_ATOM = regex.compile(rf"[\p{{P}}\p{{S}}]|[^{WHITE}\p{{P}}\p{{S}}]{{1,6}}")
_RUN = regex.compile(rf"[\p{{P}}\p{{S}}]|[^{WHITE}\p{{P}}\p{{S}}]+")
_BLANK = regex.compile(rf"[{WHITE}]")
_WORD = regex.compile(rf"[^{WHITE}]+")
_SENTENCE, _CLAUSE = frozenset(".?!。！？…"), frozenset(",;:，；：、—–")


def size_of(text: str) -> int:
    n = 0
    for m in _RUN.findall(text.lower()):
        n += max(1, -(-len(m.encode("utf-16-le")) // 12)) if len(m) > 1 else 1
    return n


def room_of(title: Column, trail: Column, window: int = WINDOW) -> Column:
    prefix = F.array_join(F.concat(F.array_compact(F.array(title)), F.array_compact(F.coalesce(trail, F.array().cast("array<string>")))), " > ")
    return F.greatest(F.lit(LEAST_ROOM), F.lit(window) - stand_in_size(prefix))


def _strengths(text: str, atoms: list) -> list[int]:
    """For each atom the strength of the boundary before it."""
    out = [9]
    for a, b in zip(atoms, atoms[1:]):
        gap, last = text[a.end() : b.start()], text[a.end() - 1]
        if "\n\n" in gap:
            out.append(6)
        elif "\n" in gap:
            out.append(5)
        elif last in _SENTENCE and (gap or last > "\x7f"):
            out.append(4)
        elif last in _CLAUSE and (gap or last > "\x7f"):
            out.append(3)
        elif gap:
            out.append(2)
        elif len(a.group()) == 1 and not a.group().isalnum():
            out.append(1)
        else:
            out.append(0)
    return out


def _overlap_start(text: str, begin: int, end: int, most: int) -> int:
    """Where the last whole words of text[begin:end] begin that are together at most ``most``."""
    if end < len(text) and end > 0 and not _BLANK.match(text[end]) and not _BLANK.match(text[end - 1]):
        return end  # the cut is inside a word, so the piece before ends without a whole word
    start, used = end, 0
    for m in reversed(list(_WORD.finditer(text, begin, end))):
        if m.start() == begin and begin > 0 and not _BLANK.match(text[begin - 1]):
            break  # its beginning was cut off
        used += size_of(m.group())
        if used > most:
            break
        start = m.start()
    return start


def split_text(text: str, room: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces of a text as (start, end), overlaps included; one piece if the text fits."""
    atoms = list(_ATOM.finditer(text))
    total = size_of(text)
    if total <= room:
        return [(0, len(text))]
    most = min(overlap, room // 4)
    strength, starts = _strengths(text, atoms), [a.start() for a in atoms]
    k = max(2, 1 + -(-(total - room) // (room - most)))
    while True:
        k = min(k, len(atoms))
        width = len(atoms) / k
        reach = max(1, int(width / 4)) if k < len(atoms) else 0
        cuts, last = [], 0
        for j in range(1, k):
            t = round(j * width)
            near = range(max(last + 1, t - reach), min(len(atoms) - (k - j), t + reach) + 1)
            if not near:
                continue
            best = max(near, key=lambda i: (strength[i], -abs(i - t), -i))
            cuts.append(best)
            last = best
        edges = [0, *(starts[i] for i in cuts), len(text)]
        pieces, ok = [], True
        for a, b in zip(edges, edges[1:]):
            end = b
            while end > a and _BLANK.match(text[end - 1]):
                end -= 1
            begin = _overlap_start(text, pieces[-1][0], pieces[-1][1], most) if pieces else a
            begin = begin if pieces and begin < pieces[-1][1] else a
            if size_of(text[begin:end]) > room:
                ok = False  # with its overlap; more pieces are tried before an overlap is given up
                if k < len(atoms):
                    break
                begin = a
            if pieces and begin <= pieces[-1][0]:
                pieces.pop()  # this one holds the whole of it
            pieces.append((begin, end))
        if ok or k == len(atoms):
            return pieces
        k += 1


def _split_batches(overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c.split()[0]: [] for c in PIECES.split(", ")}
            for r in b.to_pylist():
                cuts = split_text(r["text"], r["room"], overlap)
                line = r["line"]
                for i, (s, e) in enumerate(cuts):
                    for c, v in (
                        ("path", r["path"]), ("n", r["n"]), ("vec", r["vec"]), ("piece", i), ("of", len(cuts)), ("trail", r["trail"]),
                        ("line", None if line is None else line + r["text"].count("\n", 0, s)), ("start", s), ("size", size_of(r["text"][s:e])), ("text", r["text"][s:e]),
                    ):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema(
    [("path", pa.string()), ("n", pa.int32()), ("vec", pa.int64()), ("piece", pa.int32()), ("of", pa.int32()), ("trail", pa.list_(pa.string())), ("line", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("text", pa.string())]
)


def split_oversized(stored: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all live passages that are too large for the window, in order."""
    room = room_of(F.col("title"), F.col("trail"), window)
    large = stand_in_size("text") > F.col("room")
    rows = stored.withColumn("room", room).withColumn("large", F.coalesce(large, F.lit(False)))
    keep = lambda c: F.when(F.col("large"), F.col(c)).alias(c)  # noqa: E731  # only what is to be split is shuffled
    live = live_passages(rows, "room", "large", keep("trail"), keep("line"), keep("text")).where("large")
    return live.drop("large").mapInArrow(_split_batches(overlap), PIECES)


def checked_pieces(stored: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(path, n, all_fit, nothing_lost, overlaps, lines_right) of each passage that was cut, told from its text alone.

    The pieces of one passage are put side by side: as many as its text is long, never more.
    """
    pieces = split_oversized(stored, window, overlap).groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "line", "text"))).alias("p"))
    room = room_of(F.col("title"), F.col("trail"), window)
    whole = live_passages(stored.withColumn("room", room), "room", "text", F.col("line").alias("at")).select("path", "n", "room", "text", "at")
    rows = pieces.join(whole, ["path", "n"]).withColumn("most", F.least(F.lit(overlap), F.floor(F.col("room") / 4)))
    text = F.col("text")
    blank = lambda c: F.rlike(c, F.lit(f"^[{WHITE}]*$"))
    end = lambda x: x["start"] + F.length(x["text"])
    between = lambda a, b: F.substr(text, a + 1, b - a)
    pairs = F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda a, i: F.struct(a.alias("a"), F.element_at("p", i + 2).alias("b")))
    last = F.element_at("p", -1)

    def joined(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.when(b["start"] <= end(a), (b["start"] > a["start"]) & (end(b) > end(a))).otherwise(blank(between(end(a), b["start"])))

    def overlapped(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        word = F.regexp_extract(a["text"], f"[^{WHITE}]+$", 0)
        in_word = ~blank(F.substr(text, end(a) + 1, F.lit(1))) & (end(a) < F.length(text)) & (word != "")
        cut_off = (word == a["text"]) & (a["start"] > 0) & ~blank(F.substr(text, a["start"], F.lit(1)))
        none = in_word | cut_off | (word == "") | (stand_in_size(word) > F.col("most"))
        begins = (b["start"] == 0) | blank(F.substr(text, b["start"], F.lit(1)))
        return F.when(b["start"] < end(a), begins & (stand_in_size(between(b["start"], end(a))) <= F.col("most"))).otherwise(none)

    def lined(x: Column) -> Column:
        before = between(F.lit(0), x["start"])
        return x["line"].eqNullSafe(F.col("at") + F.length(before) - F.length(F.replace(before, F.lit("\n"))))

    return rows.select(
        "path",
        "n",
        F.forall("p", lambda x: stand_in_size(x["text"]) <= F.col("room")).alias("all_fit"),
        (blank(between(F.lit(0), F.element_at("p", 1)["start"])) & blank(between(end(last), F.length(text))) & F.forall(pairs, joined)).alias("nothing_lost"),
        F.forall(pairs, overlapped).alias("overlaps"),
        F.forall("p", lined).alias("lines_right"),
    )
