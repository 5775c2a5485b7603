"""Texts that were read with the wrong encoding: which ones, and the text as it was written.

A wrong code page is a substitution cipher: each byte's letter was replaced by another page's
letter for the same byte. Which swap happened where, and what it made of each letter, is learnt for
each source from the collection itself, by expectation-maximisation over the distinct stretches
(letter runs that hold a character beyond ASCII), against the bigrams of the languages in the texts.

* hidden are, for each stretch, whether it is as written or went through a swap, and the letter
  behind each of its symbols;
* E: the bigram likelihood of the stretch as it is, without its own count, against that of every
  reading that a swap's reversal gives, times how usual the swap is in the stretch's source; and,
  forwards and backwards over the stretch, how often each symbol stood for each letter;
* M: the bigram counts (of stretches as they were most likely written, so that garbled bigrams
  lose their weight round by round), how usual each swap is in each source, and each source's table
  from symbols to letters for each swap. Rounds end when the swaps' shares stay as they are.

Known code pages are only where the tables start: a page's letter counts as ``PAGE_SEEN`` sightings,
which a source's own sightings outweigh. A source whose symbols hardly occur elsewhere and that no
page explains gets one table more, of a page that nobody named: it starts from nothing but how
frequent symbols and letters are (``decipher``), and counts as a swap from then on if its readings
are as likely as the collection's clean text. The learnt tables are applied by ``str.translate``.

Swaps that wrote one letter as several symbols (UTF-8 or GBK read as a single-byte page, also
several times over) are ciphers of byte groups, which no table of letters undoes; they take part in
the same EM, with the byte groups in place of the table. A U+FFFD is what is left of bytes that were
lost: such a stretch is garbled and stays as it is; what stands around it is restored.

A line's or a stretch's log odds decide, so one garbled word is found in a clean text and a
garbled line although each of its words alone could be something else; the rest of a line is then
tried for further swaps, each stretch in its place.

What reaches the driver is cut down on the executors before it is sent: bigrams of
letters (Han and other characters beyond U+2BFF are classes, pairs below ``LEAST_SHARE`` of all are
left out, so there are at most 1 / LEAST_SHARE), counts of single Han characters, sums for each
(source, swap), and the letters of swaps that are at work. Sources below ``LEAST_SOURCE`` of all
stretches are taken as one, but not where tables are learnt from nothing: every source with
``FREE_MASS`` stretches for it is looked at by itself, however small its part and however many there
are. Sources with little text are done in one job, each in one task; the others in rounds over all
tasks, ``FREE_AT_ONCE`` of them at a time. What grows with the input is a table of letters and sums
for each source that got one.

Defined results: null and empty texts are not garbled and are restored to themselves; a null source
is a source of its own; an empty table yields no rows; texts of any length are read whole, line by
line; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.decipher import LETTER_SHARE, Chain, chosen, decipher, improved
from notefold.storage import write_table

MOST_ROUNDS = 12  # EM ends earlier, when no more than STEADY of the swaps' shares moves
STEADY = 1e-2
PAGE_SEEN = 3.0
LIKELY_SWAP = 0.05  # from which posterior on a swap's letters are looked at one by one
# A table from nothing: for sources with so many stretches that nothing explains, of symbols so much more frequent there than elsewhere.
FREE_MASS, FREE_ODD, FOREIGN, LEAST_SYMBOL = 100.0, 0.05, 30.0, 5.0
FREE_ROUNDS, FREE_CLOSE, FREE_BELOW = 60, 1e-4, 1.0
FREE_GROUP, FREE_AT_ONCE = 20_000, 100  # characters of a source that one task does alone; larger sources that are in the driver at a time
# Log odds from which a line or a stretch is garbled. A byte group that is a character hardly comes
# about by chance; another letter in the place of one does, in rare and misspelt words.
LEAST_ODDS_GROUP = 3.0
LEAST_ODDS_LETTER = 9.0
LEAST_SHARE = 1e-7
LEAST_SOURCE = 1e-4
KAPPA = 2.0
CAPITALS = 0.02
CLIP = 8.0  # the most that a stretch can speak against a swap
LEAST_LIKELY = -5.5  # log likelihood a bigram that a reading must have to be one
LEAST_LIKELY_HAN = -4.5  # and so much less for each Han character, of which there are many more
SCRIPT_BREAK = -8.0
CONTROL = -4.0  # nobody writes control characters
HAN = r"\u3400-\u4dbf\u4e00-\u9fff"
# A letter run with a character beyond ASCII; the look behind keeps plain words from being tried at each of their letters.
STRETCH = rf"(?<![A-Za-z])[A-Za-z]*+(?:[^\x00-\x7f{HAN}][A-Za-z]*+)++"
_MATCH = re.compile(STRETCH).finditer
_BEYOND = re.compile(r"[^\x00-\x7f]")
_IS_HAN = re.compile(rf"[{HAN}]")

# Single-byte pages: as what a text may have been read, and as what it may have been written.
PAGES = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman")
GROUPS = ("utf-8", "gbk")
LOST = "lost"
AS_IS = "as is"
FREE = ("?", "learnt")
NULL = "\0"  # the null source where it is looked at by itself; None are all that are taken as one


def _page(name: str) -> dict[int, str]:
    """The characters of a page's upper half; bytes that Windows pages leave open are control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_CHARS = {p: _page(p) for p in PAGES}
# Character to byte. Text read as Latin-1 keeps bytes 80 to 9F as control characters: Windows pages take them as well.
_BYTES = {p: ({chr(b): b for b in range(0x80, 0xA0)} if p.startswith("cp12") else {}) | {c: b for b, c in _CHARS[p].items()} for p in PAGES}
_AS_LATIN = {p: str.maketrans({c: chr(b) for c, b in _BYTES[p].items()}) for p in PAGES}
# A swap (read, written): the table that undoes it.
TABLES = {(r, w): {c: _CHARS[w][b] for c, b in _BYTES[r].items()} for r in PAGES for w in PAGES if r != w}
TABLES["latin1", "cp1252"] = {chr(b): _CHARS["cp1252"][b] for b in range(0x80, 0xA0)}
_TRANSLATE = {k: str.maketrans(t) for k, t in TABLES.items()}
_DOMAIN = {k: frozenset(t) for k, t in TABLES.items()} | {(p, g): frozenset(_BYTES[p]) for p in PAGES for g in GROUPS}
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_LEADS = {p: frozenset(c for c, b in _BYTES[p].items() if 0xC2 <= b <= 0xF4) for p in PAGES}
SWAPS = [*TABLES, *((p, "utf-8") for p in PAGES), ("cp1252", "gbk")]


@lru_cache(100_000)
def _swaps_of(symbols: frozenset) -> list[tuple[str, str]]:
    """The swaps that may have led to these symbols."""
    return [s for s in SWAPS if s[1] == "utf-8" and not symbols.isdisjoint(_LEADS[s[0]]) or symbols <= _DOMAIN[s]]


def _regroup(text: str, swap: tuple[str, str]) -> str:
    """Undo a swap of byte groups wherever its bytes are a character; other characters stay."""
    read, written = swap
    latin = text.translate(_AS_LATIN[read])
    if written == "gbk":
        try:
            return latin.encode("latin-1").decode("gbk")
        except UnicodeError:
            return text
    out, at = [], 0
    for m in _UTF8.finditer(latin):
        try:
            c = m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            continue
        out += [text[at : m.start()], c]
        at = m.end()
    return "".join([*out, text[at:]]) if out else text


def undo(text: str, swap: tuple[str, str]) -> str:
    if swap in _TRANSLATE:
        return text.translate(_TRANSLATE[swap])
    while (new := _regroup(text, swap)) != text:  # some texts were garbled twice; each time it gets shorter
        text = new
    return text


@lru_cache(200_000)
def _readings(stretch: str) -> tuple[tuple[str, str, tuple[tuple[str, str], ...]], ...]:
    """(what it was written in, reading, swaps): the readings by the pages' tables, each with the swaps that agree on it."""
    out: dict[tuple[str, str], list] = {}
    for swap in _swaps_of(frozenset(_BEYOND.findall(stretch))):
        reading = undo(stretch, swap)
        if reading != stretch:
            out.setdefault((swap[1], reading), []).append(swap)
    return tuple((written, reading, tuple(swaps)) for (written, reading), swaps in out.items())


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        return "latin" if c.isalpha() else ""
    if o < 0x250:
        return "latin" if c.isalpha() else ""
    if not c.isalpha():
        return ""
    return "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "han" if _IS_HAN.match(c) else f"block {o >> 8}"


_SCRIPTS: dict[str, str] = {}


def script(c: str) -> str:
    if c not in _SCRIPTS:
        _SCRIPTS[c] = _script(c)
    return _SCRIPTS[c]


def _is_wide(c: str) -> bool:
    """Punctuation and forms of East Asian texts."""
    return "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uffef"


def _symbol(c: str) -> str:
    """A character's place in the bigram model; what is far beyond the alphabets is one class."""
    return c if ord(c) < 0x2C00 or _is_wide(c) else "\u4e00" if _IS_HAN.match(c) else "\U00010000"


def pairs_of(stretch: str) -> list[str]:
    """The bigrams of a stretch, with its edges, that have a character beyond ASCII."""
    s = "^" + "".join(map(_symbol, stretch)) + "$"
    return [a + b for a, b in zip(s, s[1:]) if a > "\x7f" or b > "\x7f"]


class Model:
    """Bigrams of the texts as written, and how usual each swap is, by source."""

    def __init__(self, pairs: dict[str, float], han: dict[str, float], usual: dict[tuple[str | None, tuple[str, str]], float], total: dict[str | None, float], may: dict[tuple[str | None, tuple[str, str]], float], seen: dict[tuple[str | None, tuple[str, str]], dict[str, dict[str, float]]] | None = None):
        self.pairs, self.han, self.may = pairs, han, may
        self.seen = seen or {}  # how often each symbol stood for each letter
        self.tables: dict[tuple[str | None, tuple[str, str]], dict[int, str]] = {}  # learnt ones that aren't their page's
        for k, symbols in self.seen.items():
            page = TABLES[k[1]]
            learnt = {}
            for c, letters in symbols.items():
                of_page = page.get(c)
                best = max(letters, key=lambda x: (letters[x] + PAGE_SEEN * (x == of_page), x))
                if best != of_page and letters[best] > letters.get(of_page, 0.0) + PAGE_SEEN:
                    learnt[c] = best
            if learnt:
                self.tables[k] = str.maketrans(page | learnt)
        self.own = {source for source, _ in self.tables}
        self._chains: dict[str, Chain] = {}
        self.may_overall: dict[tuple[str, str], float] = defaultdict(float)
        for (_, swap), x in may.items():
            self.may_overall[swap] += x
        self.left: dict[str, float] = defaultdict(float)
        self.right: dict[str, float] = defaultdict(float)
        for p, n in pairs.items():
            self.left[p[0]] += n
            self.right[p[1]] += n
        self.n = sum(pairs.values()) + 1.0
        self.kinds = len(self.right) + 1
        self.n_han = sum(han.values()) + 1.0
        self.usual, self.total = usual, total
        self.overall: dict[tuple[str, str], float] = defaultdict(float)
        for (_, swap), x in usual.items():
            self.overall[swap] += x
        self.all = sum(total.values()) + 1.0
        self._prior: dict[tuple[str | None, tuple[str, str]], float] = {}
        self._odds: dict[tuple, tuple[float, dict]] = {}
        self._steps: dict[str, float] = {}
        self._bars: dict[str | None, float] = {}

    def prior(self, source: str | None, swap: tuple[str, str]) -> float:
        """Log odds of a swap before a stretch's letters are looked at: the source's share, leaning on the whole's.

        For byte groups it is the share of the stretches whose bytes are characters that way: hardly
        any text has such bytes by chance. For letters, where nearly all have, of all stretches.
        """
        source = source if source in self.total else None
        k = (source, swap)
        if k not in self._prior:
            if swap in self.may_overall:
                whole = (self.overall.get(swap, 0.0) + 0.5) / (self.may_overall[swap] + 10)
                own = min(0.95, (self.usual.get(k, 0.0) + 20 * whole) / (self.may.get(k, 0.0) + 20))
                self._prior[k] = math.log(own) - math.log(1 - own)
                return self._prior[k]
            whole = (self.overall.get(swap, 0.0) + 1e-4 * self.all / len(SWAPS)) / self.all
            own = (self.usual.get(k, 0.0) + 1000 * whole) / (self.total.get(source, 0.0) + 1000)
            self._prior[k] = math.log(min(own, 0.5))
        return self._prior[k]

    def set_free(self, source: str | None, table: dict[int, str], mass: float) -> None:
        """A table that was learnt from nothing, as one more swap of its source."""
        self.tables[source, FREE] = table
        self.own.add(source)
        self.overall[FREE] += mass - self.usual.get((source, FREE), 0.0)
        self.usual[source, FREE] = mass
        self.total.setdefault(source, mass)  # it may have been taken as one with others so far

    def chain(self, script_: str) -> Chain:
        """The letters of a script with their bigrams."""
        if script_ not in self._chains:
            least = LETTER_SHARE * self.n
            self._chains[script_] = Chain({c: x for c, x in self.right.items() if c > "\x7f" and x > least and script(c) == script_}, self._step)
        return self._chains[script_]

    def bar(self, source: str | None) -> float:
        """The least gain with which a swap can be accepted in a source, by the swaps' log odds."""
        source = source if source in self.total else None
        if source not in self._bars:
            self._bars[source] = min(_least(s) - self.prior(source, s) for s in self.swaps(source)) - 1e-9
        return self._bars[source]

    def swaps(self, source: str | None) -> list[tuple[str, str]]:
        return [*SWAPS, FREE] if (source, FREE) in self.tables else SWAPS

    def _step(self, before: str, c: str, mine: float = 0.0) -> float:
        """Log probability of a character after another ("^" and "$" are the edges); ``mine`` is the count to leave out."""
        s_before, s = script(before) if before != "^" else "", script(c) if c != "$" else ""
        if s == "han":
            return (-1.2 if before == "^" or s_before in ("han", "") else -9.0) + math.log((self.han.get(c, 0.0) + 0.01) / (self.n_han + 200))
        if s_before == "han":
            return -1.2 if c == "$" else -2.5 if _is_wide(c) else -9.0
        a, b = _symbol(before), _symbol(c)
        pair = max(0.0, self.pairs.get(a + b, 0.0) - mine)
        left = max(0.0, self.left.get(a, 0.0) - mine)
        right = max(0.0, self.right.get(b, 0.0) - mine)
        la, lb = a.lower(), b.lower()
        if len(la) == len(lb) == 1 and (la != a or lb != b):  # capitals lean on what their small letters do
            pair += CAPITALS * self.pairs.get(la + lb, 0.0)
            left += CAPITALS * self.left.get(la, 0.0)
        ll = math.log((pair + KAPPA * (right + 0.1) / (self.n + 0.1 * self.kinds)) / (left + KAPPA))
        if s and s_before and s != s_before:
            ll += SCRIPT_BREAK
        if "\x80" <= c <= "\x9f":
            ll += CONTROL
        return ll

    def likelihood(self, stretch: str, own: float = 0.0, floor: float = -math.inf) -> float:
        """Log likelihood by bigrams; ``own`` is the stretch's own count, left out. Ends early at ``floor``."""
        ll, before = 0.0, "^"
        mine: dict[str, float] = {}
        if own:
            for p in pairs_of(stretch):
                mine[p] = mine.get(p, 0.0) + own
        steps = self._steps
        for c in stretch + "$":
            if c > "\x7f" or before > "\x7f":
                if own:
                    ll += self._step(before, c, mine.get(_symbol(before) + _symbol(c), 0.0))
                else:
                    k = before + c
                    x = steps.get(k)
                    if x is None:
                        x = steps[k] = self._step(before, c)
                    ll += x
                if ll < floor:
                    return floor
            before = c
        return ll

    def odds(self, source: str | None, stretch: str, own: float = 0.0, possible: list | None = None) -> dict[tuple[str, str], tuple[float, str]]:
        """For each swap that the stretch could have gone through: (gain in log likelihood, reading).

        ``possible`` takes up the swaps of byte groups that have a reading, likely or not.
        """
        if "\ufffd" in stretch:
            return {(LOST, LOST): (1e6, stretch)}
        base = self.likelihood(stretch, own)
        least = base if own else base - CLIP
        out = {}
        for written, reading, swaps in self.readings(source, stretch):
            if possible is not None and written in GROUPS:
                possible.extend(swaps)
            # Pages that agree in these bytes are one, the more usual one.
            swap = swaps[0] if len(swaps) == 1 else max(swaps, key=lambda s: self.prior(source, s))
            likely = self.likelihood(reading, floor=least)
            if likely > least and likely >= LEAST_LIKELY * (1 + len(reading)) + LEAST_LIKELY_HAN * len(_IS_HAN.findall(reading)):
                out[swap] = (likely - base, reading)
            elif not own:
                out[swap] = (-CLIP, reading)
        return out

    def readings(self, source: str | None, stretch: str):
        """The pages' readings, with those of the tables that the source has of its own."""
        every = _readings(stretch)
        if source not in self.own:
            return every
        own = [s for s in self.swaps(source) if (source, s) in self.tables]
        kept = [(w, r, tuple(s for s in swaps if s not in own)) for w, r, swaps in every]
        every = [x for x in kept if x[2]]
        for swap in own:
            table = self.tables[source, swap]
            if swap == FREE and not any(ord(c) in table for c in stretch) or swap != FREE and swap not in _swaps_of(frozenset(_BEYOND.findall(stretch))):
                continue
            reading = stretch.translate(table)
            if reading != stretch:
                every.append((swap[1], reading, (swap,)))
        return every

    def cached(self, source: str | None, stretch: str) -> tuple[float, dict]:
        """(the most that a swap gains, the odds) of a stretch."""
        k = (source if source in self.own else None, stretch)
        if k not in self._odds:
            if len(self._odds) > 300_000:
                self._odds.clear()
            odds = self.odds(k[0], stretch)
            self._odds[k] = (max((g for g, _ in odds.values()), default=0.0), odds)
        return self._odds[k]

    def letters(self, source: str | None, swap: tuple[str, str], stretch: str, reading: str) -> dict[tuple[str, str], float]:
        """(symbol, letter) to how likely it stood for it, by the source's table so far and the letters around."""
        kinds = {script(c) for c in reading if c > "\x7f"} - {"", "han"}
        if len(kinds) != 1:
            return {}
        chain = self.chain(kinds.pop())
        n = len(chain.letters)
        if not n:
            return {}
        page, seen, table = TABLES[swap], self.seen.get((source, swap), {}), {}
        for c in set(stretch):
            if page.get(c) not in chain.at or c < "\x80":
                continue
            x = np.full(n, 0.1 / n)
            x[chain.at[page[c]]] += PAGE_SEEN
            for letter, times in seen.get(c, {}).items():
                if letter in chain.at:
                    x[chain.at[letter]] += times
            table[c] = x / x.sum()
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        chain.expect(stretch, table, 1.0, sums)
        return {(c, chain.letters[i]): float(x[i]) for c, x in sums.items() for i in np.flatnonzero(x > 0.02)}


def _posterior(model: Model, source: str | None, stretch: str, count: float, possible: list) -> dict:
    """(swap or AS_IS) to (probability, reading) of a stretch."""
    found = model.odds(source, stretch, count, possible)
    if (LOST, LOST) in found:
        return {(LOST, LOST): (1.0, "")}
    logs = {AS_IS: (0.0, stretch)} | {s: (g + model.prior(source, s), r) for s, (g, r) in found.items()}
    top = max(x for x, _ in logs.values())
    z = sum(math.exp(x - top) for x, _ in logs.values())
    return {s: (math.exp(x - top) / z, r) for s, (x, r) in logs.items()}


_SUMS = "kind STRING, source STRING, a STRING, b STRING, x DOUBLE"


def _summed(sums: dict[tuple, float]) -> pa.RecordBatch:
    cols = list(zip(*((*k, v) for k, v in sums.items()))) or [[], [], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i < 4 else pa.float64()) for i, c in enumerate(cols)], names=["kind", "source", "a", "b", "x"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _expect(model_b):
    """The E step over the distinct stretches and the sums that the M step needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value if model_b is not None else None
        sums: dict[tuple, float] = defaultdict(float)
        for source, stretch, count, own in _rows(batches):
            if model is not None and (own, FREE) in model.tables:
                source = own
            sums["total", source, "", ""] += count
            if model is None:
                if "\ufffd" not in stretch:
                    for p in pairs_of(stretch):
                        sums["pair", None, p[0], p[1]] += count
                continue
            possible: list[tuple[str, str]] = []
            posterior = _posterior(model, source, stretch, count, possible)
            for swap in possible:
                sums["may", source, *swap] += count
            for swap, (prob, reading) in posterior.items():
                if prob < 1e-4:
                    continue
                for p in pairs_of(reading):
                    sums["pair", None, p[0], p[1]] += count * prob
                if swap == AS_IS:
                    continue
                sums["swap", source, *swap] += count * prob
                if swap in TABLES and prob >= LIKELY_SWAP:
                    for (c, letter), x in model.letters(source, swap, stretch, reading).items():
                        sums["letter", source, f"{swap[0]}>{swap[1]}", c + letter] += count * prob * x
        yield _summed(sums)

    return run


def _gathered(stretches: DataFrame, step, least: float) -> list:
    """The sums of a step, without those that are too small to matter."""
    sums = stretches.mapInArrow(step, _SUMS).groupBy("kind", "source", "a", "b").agg(F.sum("x").alias("x"))
    bar = F.when(F.col("kind") == "pair", F.lit(least)).when(F.col("kind") == "letter", F.lit(0.5)).otherwise(F.lit(0.0))
    return sums.where(F.col("x") >= bar).collect()


def _model(rows: list, han: dict[str, float]) -> Model:
    """The M step."""
    pairs, usual, total, may, seen = {}, {}, {}, {}, {}
    for r in rows:
        if r["kind"] == "pair":
            pairs[r["a"] + r["b"]] = r["x"]
        elif r["kind"] == "swap":
            usual[r["source"], (r["a"], r["b"])] = r["x"]
        elif r["kind"] == "may":
            may[r["source"], (r["a"], r["b"])] = r["x"]
        elif r["kind"] == "total":
            total[r["source"]] = r["x"]
        elif r["kind"] == "letter":
            seen.setdefault((r["source"], tuple(r["a"].split(">"))), {}).setdefault(r["b"][0], {})[r["b"][1]] = r["x"]
    return Model(pairs, han, usual, total, may, seen)


def _moved(old: Model, new: Model) -> float:
    """How much of the swaps' shares moved."""
    keys = old.usual.keys() | new.usual.keys()
    return sum(abs(old.usual.get(k, 0.0) - new.usual.get(k, 0.0)) for k in keys) / (sum(new.usual.values()) + 1.0)


def learn(documents: DataFrame, most_rounds: int = MOST_ROUNDS) -> Model:
    """The model with the tables that EM found."""
    spark = documents.sparkSession
    texts = documents.where(F.col("text").isNotNull()).select("source", "text")
    pieces = texts.select("source", F.explode(F.regexp_extract_all("text", F.lit(f"{STRETCH}|[{HAN}]"), F.lit(0))).alias("stretch"))
    pieces = write_table(pieces.groupBy("source", "stretch").agg(F.count(F.lit(1)).cast("double").alias("n")), "stretches")
    # Sources with less than LEAST_SOURCE of all stretches are taken as one, so there are at most 1 / LEAST_SOURCE; "own" tells them apart.
    one_han = F.col("stretch").rlike(f"^[{HAN}]$")
    sizes = pieces.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.when(~one_han, F.col("n") * F.length("stretch"))).alias("symbols"))
    every = sizes.agg(F.sum("n").alias("n"), F.sum("symbols").alias("symbols")).first()
    least = LEAST_SHARE * (every["symbols"] or 0)
    large = F.broadcast(sizes.where(F.col("source").isNotNull() & (F.col("n") >= LEAST_SOURCE * (every["n"] or 0))).select("source"))
    pieces = pieces.join(large.withColumn("large", F.lit(True)), "source", "left").select(F.when(F.col("large"), F.col("source")).alias("source"), "stretch", "n", F.coalesce("source", F.lit(NULL)).alias("own"))
    han = {r["stretch"]: r["n"] for r in pieces.where(one_han).groupBy("stretch").agg(F.sum("n").alias("n")).collect()}
    stretches = pieces.where(~one_han)
    model = _model(_gathered(stretches, _expect(None), least), han)
    for _ in range(most_rounds - 1):
        new = _model(_gathered(stretches, _expect(spark.sparkContext.broadcast(model)), least), han)
        moved, model = _moved(model, new), new
        if moved <= STEADY:
            break
    return _with_free_tables(stretches, model, han, least)


def _symbols(rows: DataFrame, source: str) -> DataFrame:
    """(source, symbol, x): how often each character beyond ASCII is in each source's stretches."""
    each = F.explode(F.regexp_extract_all("stretch", F.lit(r"[^\x00-\x7f]"), F.lit(0))).alias("symbol")
    return rows.where(~F.contains("stretch", F.lit("\ufffd"))).select(source, "n", each).groupBy(source, "symbol").agg(F.sum("n").alias("x"))


def _foreign(stretches: DataFrame, n: float) -> DataFrame:
    """(of, foreign): of sources that have enough of them, the symbols that are far more frequent there than elsewhere."""
    symbols = write_table(_symbols(stretches, "own"), "symbols")
    every = symbols.groupBy("symbol").agg(F.sum("x").alias("every"))
    here = stretches.groupBy(F.col("own").alias("of")).agg(F.sum("n").alias("here"))
    found = symbols.where(F.col("x") >= LEAST_SYMBOL).join(every, "symbol").join(here, F.col("own") == F.col("of"))
    # A source that is all there is has nothing to be compared with.
    found = found.where((F.col("here") < n) & (F.col("x") * (n - F.col("here")) > FOREIGN * (F.col("every") - F.col("x")) * F.col("here")))
    found = found.groupBy("of").agg(F.concat_ws("", F.collect_list("symbol")).alias("foreign"), F.sum("x").alias("mass"))
    return write_table(found.where(F.col("mass") >= FREE_MASS).select("of", "foreign"), "foreign")


def _odd(stretch: str) -> bool:
    """Whether a stretch is written as no word is: a sign or number between letters, a capital after a small letter, two scripts."""
    kinds = {script(c) for c in stretch if c.isalpha()}
    inside = any(a.isalpha() and b.isalpha() and not c.isalpha() and unicodedata.category(c)[0] in "SNC" for a, c, b in zip(stretch, stretch[1:], stretch[2:]))
    return len(kinds) > 1 or inside or any(a.islower() and b.isupper() and b > "\x7f" for a, b in zip(stretch, stretch[1:]))


def _with_free_tables(stretches: DataFrame, model: Model, han: dict[str, float], least: float) -> Model:
    """The model, with tables for what no known page explains."""
    foreign = _foreign(stretches, sum(model.total.values()))
    if foreign.isEmpty():
        return model
    context = stretches.sparkSession.sparkContext
    has_foreign = F.coalesce(F.expr("translate(stretch, foreign, '') <> stretch"), F.lit(False)).alias("has_foreign")
    marked = write_table(stretches.join(foreign, F.col("own") == F.col("of"), "left").select(*stretches.columns, has_foreign), "marked")
    # What no foreign symbol is in gives the bigrams to hold readings against.
    clean = _model(_gathered(marked.where("NOT has_foreign").select(*stretches.columns), _expect(context.broadcast(model)), least), han)
    if not clean.pairs:
        return model
    bar = sum(x * clean._step(p[0], p[1]) for p, x in clean.pairs.items()) / clean.n - FREE_BELOW
    kinds = [k for k in sorted({script(c) for c in clean.right if c > "\x7f"} - {"", "han"}) if len(clean.chain(k).letters) > 4]
    if not kinds:
        return model
    shared = context.broadcast((clean, bar))

    def unexplained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, bar = shared.value
        for b in batches:
            out = []
            for source, stretch, count in _rows([b]):
                if "\ufffd" not in stretch and not any(r.isascii() or clean.likelihood(r) >= bar * len(pairs_of(r)) for _, r, _ in _readings(stretch)):
                    out.append((source, stretch, count, count * len(pairs_of(stretch)), count * _odd(stretch)))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.float64()) for i, c in enumerate(cols)], names=["source", "stretch", "n", "steps", "odd"])

    left = write_table(marked.where("has_foreign").select("own", "stretch", "n").mapInArrow(unexplained, "source STRING, stretch STRING, n DOUBLE, steps DOUBLE, odd DOUBLE"), "unexplained")
    about = left.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("mass"), F.sum("steps").alias("steps"), F.sum("odd").alias("odd"), F.sum(F.length("stretch")).alias("size"))
    about = write_table(about.where((F.col("mass") >= FREE_MASS) & (F.col("odd") >= FREE_ODD * F.col("mass"))), "able")
    chains = {k: clean.chain(k) for k in kinds}
    taken = _free_at_once(left, about.where(F.col("size") <= FREE_GROUP), chains, bar)
    large = about.where(F.col("size") > FREE_GROUP).orderBy("of").collect()
    for i in range(0, len(large), FREE_AT_ONCE):
        taken |= _free_in_rounds(left, large[i : i + FREE_AT_ONCE], chains, bar)
    if not taken:
        return model
    for s, (table, mass) in taken.items():
        clean.set_free(s, table, mass)
    for _ in range(2):  # the other swaps' shares, now that there is one more
        again = _model(_gathered(stretches, _expect(context.broadcast(clean)), least), han)
        for s, (table, _) in taken.items():
            again.set_free(s, table, again.usual.get((s, FREE), 0.0))
        clean = again
    return clean


def _accepted(chains: dict[str, Chain], fits: dict[str, tuple[dict[str, np.ndarray], float]], mass: float, steps: float, bar: float) -> dict[str, str]:
    """Symbol to letter, in the likeliest script, if what is read that way is as likely as clean text."""
    best = max(chains, key=lambda k: fits[k][1])
    table, like = fits[best]
    return chosen(chains[best], table) if like * mass / steps >= bar else {}


def _free_at_once(left: DataFrame, about: DataFrame, chains: dict[str, Chain], bar: float) -> dict[str, tuple[dict[int, str], float]]:
    """Source to (table, mass): of sources with little text, each wholly in one task."""
    spark = left.sparkSession
    chains_b = spark.sparkContext.broadcast(chains)

    def fitted(key: tuple, rows: pa.Table) -> pa.Table:
        chains = chains_b.value
        stretches = dict(zip(rows["stretch"].to_pylist(), rows["n"].to_pylist()))
        fits = {k: decipher(chain, stretches, FREE_ROUNDS, FREE_CLOSE, LEAST_SYMBOL) for k, chain in chains.items()}
        mass, steps = rows["mass"][0].as_py(), rows["all_steps"][0].as_py()
        table = _accepted(chains, fits, mass, steps, bar)
        return pa.table([pa.array([key[0].as_py()], pa.string()), [mass], ["".join(table)], ["".join(table.values())]], names=["source", "mass", "symbols", "letters"])

    rows = left.join(about.select("of", "mass", F.col("steps").alias("all_steps")), F.col("source") == F.col("of")).select("source", "stretch", "n", "mass", "all_steps")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source")  # by number: few bytes, but much to do
    fits = rows.groupBy("source").applyInArrow(fitted, "source STRING, mass DOUBLE, symbols STRING, letters STRING")
    return {r["source"]: (str.maketrans(r["symbols"], r["letters"]), r["mass"]) for r in fits.where("symbols <> ''").collect()}


def _free_in_rounds(left: DataFrame, about: list, chains: dict[str, Chain], bar: float) -> dict[str, tuple[dict[int, str], float]]:
    """As ``_free_at_once``, of a few sources with any amount of text: each round's E step is shared by all tasks."""
    context = left.sparkSession.sparkContext
    mass = {r["of"]: r["mass"] for r in about}
    here = write_table(left.where(F.col("source").isin(list(mass))).select("source", "stretch", "n"), "unexplained")
    symbols: dict[str, dict[str, float]] = defaultdict(dict)
    for r in _symbols(here, "source").where(F.col("x") >= LEAST_SYMBOL).collect():
        symbols[r["source"]][r["symbol"]] = r["x"]
    tables = {(s, k): chain.start(symbols[s]) for s in mass for k, chain in chains.items()}
    like: dict[tuple, float] = dict.fromkeys(tables, -math.inf)
    going = set(tables)
    for _ in range(FREE_ROUNDS):
        state = context.broadcast((chains, {k: tables[k] for k in going}))

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chains, tables = state.value
            sums: dict[tuple, float] = defaultdict(float)
            letters: dict[tuple, dict[str, np.ndarray]] = {k: defaultdict(lambda n=len(chains[k[1]].letters): np.zeros(n)) for k in tables}
            for source, stretch, count in _rows(batches):
                for kind, chain in chains.items():
                    if (source, kind) in tables:
                        sums["like", source, kind, ""] += count * chain.expect(stretch, tables[source, kind], count, letters[source, kind])
            for (source, kind), table in letters.items():
                for c, x in table.items():
                    for i in np.flatnonzero(x > 1e-3):
                        sums["free", source, kind, f"{c}{chains[kind].letters[i]}"] += float(x[i])
            yield _summed(sums)

        sums: dict[tuple, dict[str, np.ndarray]] = {k: defaultdict(lambda n=len(chains[k[1]].letters): np.zeros(n)) for k in going}
        now: dict[tuple, float] = {}
        totals = here.mapInArrow(expected, _SUMS).groupBy("kind", "source", "a", "b").agg(F.sum("x").alias("x"))
        for r in totals.collect():  # FREE_AT_ONCE sources, symbols and letters of bounded tables
            k = (r["source"], r["a"])
            if r["kind"] == "like":
                now[k] = r["x"] / mass[r["source"]]
            else:
                sums[k][r["b"][0]][chains[r["a"]].at[r["b"][1]]] = r["x"]
        for k in list(going):
            tables[k] = improved(sums[k])
            if now[k] - like[k] < FREE_CLOSE * abs(now[k]):
                going.discard(k)
            like[k] = now[k]
        state.unpersist()
        if not going:
            break
    found = {r["of"]: _accepted(chains, {k: (tables[r["of"], k], like[r["of"], k]) for k in chains}, r["mass"], r["steps"], bar) for r in about}
    return {s: (str.maketrans("".join(table), "".join(table.values())), mass[s]) for s, table in found.items() if table}


def _least(swap: tuple[str, str]) -> float:
    return LEAST_ODDS_GROUP if swap[1] in GROUPS else LEAST_ODDS_LETTER


def _whole_line(line: str, swap: tuple[str, str]) -> str | None:
    """A line of which every byte was written in the large Chinese code: it has characters of four bytes, two of them digits."""
    try:
        return line.translate(_AS_LATIN[swap[0]]).encode("latin-1").decode("gb18030")
    except UnicodeError:
        return None


def judge_line(model: Model, source: str | None, line: str) -> tuple[list[str], str]:
    """(the swaps that the line or stretches of it went through, the line as written)."""
    spans = list(_MATCH(line))
    both = [model.cached(source, m.group()) for m in spans]
    if sum(g for g, _ in both if g > 0) < model.bar(source):
        return [], line
    odds = [o for _, o in both]
    swaps, readings = [], {}
    lost = {i for i, o in enumerate(odds) if (LOST, LOST) in o}
    open_ = [i for i in range(len(odds)) if i not in lost]
    if lost:
        swaps.append(LOST)
    while open_:
        # All that is left as one, then each stretch alone: a swap's gain over several of them adds up.
        sums: dict[tuple[str, str], float] = defaultdict(float)
        for i in open_:
            for swap, (gain, _) in odds[i].items():
                sums[swap] += gain
        best, swap = max(((x + model.prior(source, s) - _least(s), s) for s, x in sums.items()), default=(-1.0, None))
        if best < 0:
            best, at, swap = max(((odds[i][s][0] + model.prior(source, s) - _least(s), -i, s) for i in open_ for s in odds[i]), default=(-1.0, 0, None))
            if best < 0:
                break
            taken = [-at]
        else:
            # A stretch that this swap makes worse, but another one better, waits for that.
            waits = lambda i: odds[i][swap][0] < 0 and any(g > _least(s) for s, (g, _) in odds[i].items())
            mine = [i for i in open_ if swap in odds[i]]
            taken = [i for i in mine if not waits(i)] or mine
        swaps.append(f"{swap[0]}>{swap[1]}")
        if swap[1] == "gbk" and not readings and (whole := _whole_line(line, swap)) is not None:
            return sorted(set(swaps)), whole
        readings |= {i: odds[i][swap][1] for i in taken}
        open_ = [i for i in open_ if i not in readings]
    out, at = [], 0
    for i, m in enumerate(spans):
        if i in readings:
            out += [line[at : m.start()], readings[i]]
            at = m.end()
    return sorted(set(swaps)), "".join([*out, line[at:]])


RESULT = "doc_id LONG, garbled BOOLEAN, swaps ARRAY<STRING>, restored STRING"


def repair(documents: DataFrame) -> DataFrame:
    """(doc_id, garbled, swaps, restored) of every document; a map over the texts once EM has run."""
    model = learn(documents)
    model_b = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        for b in batches:
            swaps, texts = [], []
            for source, text in zip(b.column("source").to_pylist(), b.column("text").to_pylist()):
                if not text or text.isascii():
                    swaps.append([])
                    texts.append(text)
                    continue
                if source is None and NULL in model.own:
                    source = NULL
                lines = [judge_line(model, source, x) if not x.isascii() else ([], x) for x in text.split("\n")]
                swaps.append(sorted({s for found, _ in lines for s in found}))
                texts.append("\n".join(x for _, x in lines))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bool(s) for s in swaps]), pa.array(swaps, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["doc_id", "garbled", "swaps", "restored"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, RESULT)
