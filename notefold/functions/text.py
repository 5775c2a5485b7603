"""Token rules, stop words, phrases and snippets, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are too common to tell one passage from another.
STOP_WORDS = (
    "a about above after again all also am an and any are aren as at be because been before being below between both but by "
    "can cannot could couldn did didn do does doesn doing don down during each few for from further get had hadn has hasn "
    "have haven having he her here hers him his how i if in into is isn it its just ll me more most my no nor not now of off "
    "on once only or other our out over own re same shan she should shouldn so some such than that the their them then there "
    "these they this those through to too under until up ve very was wasn we were weren what when where which while who whom "
    "why will with won would wouldn you your yours"
).split()

MAX_TOKEN = 64  # UTF-16 units; longer runs are keys and encoded blobs, not words
WORD = r"[\p{L}\p{N}\p{M}]+"
WHITE = r" \t\n\u000B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"  # white space as in JavaScript


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    c = _c(c)
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def tokens(c: Column | str) -> Column:
    """All tokens in order: lower case, runs of letters, digits and marks, stop words kept.

    Null text has null tokens, a text without words an empty list.
    """
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), F.lit(0))
    return F.filter(runs, lambda t: F.when(F.length(t) <= MAX_TOKEN // 2, F.lit(True)).otherwise(utf16_length(t) <= MAX_TOKEN))


def is_distinctive(t: Column) -> Column:
    """Neither a stop word nor a single letter of a to z."""
    return ~t.isin(*STOP_WORDS) & ~((F.length(t) == 1) & t.between("a", "z"))


def distinctive_tokens(c: Column | str) -> Column:
    return F.filter(tokens(c), is_distinctive)


def has_phrase(toks: Column, phrase: Column) -> Column:
    """Whether ``phrase`` occurs in ``toks`` as neighbours in order; an empty phrase doesn't occur.

    Tokens hold no blanks, so a padded text search is an exact neighbour search.
    """
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.contains(pad(toks), pad(phrase))


def question_words(q: Column | str) -> Column:
    """The distinct distinctive words of a question, in order of first use."""
    return F.array_distinct(distinctive_tokens(q))


def question_phrases(q: Column | str) -> Column:
    """The quoted phrases (straight or curly double quotes) that hold a distinctive word, as token lists."""
    quoted = F.regexp_extract_all(_c(q), F.lit('["“]([^"“”]+)["”]'), F.lit(1))
    return F.filter(F.transform(quoted, tokens), lambda p: F.exists(p, is_distinctive))


def js_trim(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def snippet(c: Column | str, most: int = 400) -> Column:
    """At most ``most`` characters with white space collapsed, cut at the last blank where there is one."""
    s = js_trim(F.regexp_replace(_c(c), f"[{WHITE}]+", " "))
    head = F.substring(s, 1, most + 1)
    cut = F.regexp_extract(head, f"^(.{{1,{most}}}) ", 1)
    return F.when(F.length(s) <= most, s).when(cut != "", cut).otherwise(F.substring(s, 1, most))


def stand_in_size(c: Column | str) -> Column:
    """The stand-in token counter: 1 for each punctuation mark or symbol, ceil(units / 6) for each other run.

    A run of L units is ceil(L / 6) matches of up to six; a character beyond the basic plane is two
    units, so it is counted as two placeholders.
    """
    s = F.regexp_replace(F.lower(_c(c)), r"[\x{10000}-\x{10FFFF}&&[^\p{P}\p{S}]]", "xx")
    return F.regexp_count(s, F.lit(rf"[\p{{P}}\p{{S}}]|[^{WHITE}\p{{P}}\p{{S}}]{{1,6}}"))
