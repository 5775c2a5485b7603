"""Pieces of the SQL that results are held against."""

from __future__ import annotations

from notefold.functions.text import STOP_WORDS

LIVE = "live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, n ORDER BY vec DESC) AS k FROM stored_passages) WHERE k = 1 AND text IS NOT NULL)"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda t: length(t) <= 64)"


DISTINCTIVE = "t NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ") AND NOT regexp_full_match(t, '[a-z]')"


def distinctive(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda t: length(t) <= 64 AND {DISTINCTIVE})"


FIELDS = "list_filter(list_concat([title], list_concat(coalesce(trail, []), [text])), lambda f: f IS NOT NULL)"

POSTINGS = f"""{LIVE},
fl AS (SELECT path, n, title, trail, text, unnest({FIELDS}) AS f FROM live),
tk AS (SELECT path, n, unnest({distinctive("f")}) AS token FROM fl),
post AS (SELECT path, n, token, least(count(*), 255) AS tf FROM tk GROUP BY 1, 2, 3),
len AS (SELECT l.path, l.n, least(coalesce(c.c, 0), 65535) AS doc_len FROM live l LEFT JOIN (SELECT path, n, count(*) AS c FROM tk GROUP BY 1, 2) c ON c.path = l.path AND c.n = l.n),
stats AS (SELECT count(*) AS passages, coalesce(sum(doc_len), 0)::BIGINT AS sum_len, coalesce(sum(doc_len), 0) / count(*) AS avg_len FROM len),
df AS (SELECT token, count(*) AS df FROM post GROUP BY 1)"""


def size(x: str) -> str:
    """The stand-in token counter."""
    white = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    return rf"len(regexp_extract_all(regexp_replace(lower({x}), '[\x{{20000}}-\x{{2FFFF}}]', 'xx', 'g'), '[\p{{P}}\p{{S}}]|[^{white}\p{{P}}\p{{S}}]{{1,6}}'))"


def cosine(a: str, b: str) -> str:
    return f"greatest(0, least(1, list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))))"


def usable(v: str) -> str:
    return f"coalesce(len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0, false)"
