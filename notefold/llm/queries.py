"""Queries of the ``llm`` operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions.text import tokens
from notefold.llm.bpe import count_tokens, encode
from notefold.llm.garbled import repair
from notefold.llm.neighbours import neighbours, ranked, similar_pairs
from notefold.llm.ngrams import banded, ngram_counts
from notefold.llm.pack import CAPACITY, cut_items, pack_documents, windows_report
from notefold.llm.split import checked_pieces, split_oversized
from notefold.llm.terms import term_weights, top_terms
from notefold.operators.cosine import top_k
from notefold.operators.passages import live_passages
from notefold.storage import write_table


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{d}/stored_passages.parquet"))


def p2_pieces_hold(spark: SparkSession, d: str) -> DataFrame:
    """Of each passage that was cut: whether its pieces fit, leave nothing out, and overlap as they must."""
    return checked_pieces(spark.read.parquet(f"{d}/stored_passages.parquet"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("piece = 1").select("path", "n")


def _passage_tokens(spark: SparkSession, d: str) -> DataFrame:
    live = live_passages(spark.read.parquet(f"{d}/stored_passages.parquet"), "text")
    return live.where(F.col("text").isNotNull()).select(tokens("text").alias("tokens"))


def _passages(spark: SparkSession, d: str) -> int:
    live = live_passages(spark.read.parquet(f"{d}/stored_passages.parquet"), F.col("text").isNotNull().alias("has"))
    return live.where("has").count()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    counts = ngram_counts(_passage_tokens(spark, d), "tokens", 1)
    return banded(counts, _passages(spark, d)).where(F.col("band").isNotNull()).select(F.col("gram").alias("term"), "band")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    counts = ngram_counts(_passage_tokens(spark, d), "tokens", 1)
    return banded(counts, _passages(spark, d)).select(F.col("gram").alias("term"), "cf", "df", "band")


def p4_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return ngram_counts(_passage_tokens(spark, d), "tokens", 3)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_terms(term_weights(spark.read.parquet(f"{d}/stored_passages.parquet"), "tf_idf")).select("path", "term")


def p5_log_entropy(spark: SparkSession, d: str) -> DataFrame:
    return term_weights(spark.read.parquet(f"{d}/stored_passages.parquet"), "log_entropy")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(neighbours(spark.read.parquet(f"{d}/passage_vectors.parquet"), k=10), 0.925)


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ranked(neighbours(spark.read.parquet(f"{d}/passage_vectors.parquet"), k=10), 10)


def p6_recall_holds(spark: SparkSession, d: str) -> DataFrame:
    """One row: the positions divisible by 50 against an exact scan of all, and whether recall at 10 is 0.9 or more there."""
    table = spark.read.parquet(f"{d}/passage_vectors.parquet").select("vec", "embedding")
    found = ranked(neighbours(table, k=10), 10).where(F.col("vec") % 50 == 0)
    rows = table.where(F.col("vec").isNotNull()).groupBy("vec").agg(F.max("embedding").alias("vector"))
    rows = write_table(rows.select(F.lit("").alias("path"), F.col("vec").alias("n"), "vector"), "vectors")
    exact = top_k(rows, rows.where(F.col("n") % 50 == 0).select(F.col("n").alias("wording"), "vector"), 11, 64).where("n <> wording")
    w = Window.partitionBy("wording").orderBy("rank")
    exact = write_table(exact.withColumn("k", F.row_number().over(w)).where("k <= 10").select(F.col("wording").alias("vec"), F.col("n").alias("other"), "score"), "exact")
    # A position that is as near as the tenth counts as well as the tenth.
    bar = exact.groupBy("vec").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("of"))
    hits = found.join(bar, "vec").where(F.col("cosine") >= F.col("least") - 1e-5).groupBy("vec").agg(F.count(F.lit(1)).alias("hits"))
    sums = bar.join(hits, "vec", "left").agg(F.count(F.lit(1)).alias("asked"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"), F.sum("of").alias("of"))
    return sums.select("asked", (F.coalesce(F.col("hits") / F.col("of"), F.lit(1.0)) >= 0.9).alias("recall_holds"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(spark.read.parquet(f"{d}/documents.parquet"))


def p9_windows(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(count_tokens(spark.read.parquet(f"{d}/documents.parquet")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document that lies in more than one window."""
    return cut_items(p9_windows(spark, d)).select(F.col("item").alias("doc_id"))


def p9_windows_hold(spark: SparkSession, d: str) -> DataFrame:
    """One row: the documents, and whether each is wholly in windows, cut only if it must be, and no window is too full."""
    assigned = write_table(p9_windows(spark, d), "windows")
    fill = windows_report(assigned).agg(F.coalesce(F.max("fill"), F.lit(0)).alias("most"))
    docs = assigned.groupBy("item").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.count_distinct("part").alias("parts"), F.max("parts").alias("of"))
    once = (F.col("rows") == F.col("parts")) & (F.col("parts") == F.col("of"))
    as_cut = F.col("of") == F.greatest(F.lit(1), F.ceil(F.col("size") / CAPACITY))
    found = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.min(once), F.lit(True)).alias("each_once"), F.coalesce(F.min(as_cut), F.lit(True)).alias("cut_only_if_needed"))
    return found.crossJoin(F.broadcast(fill)).select("documents", "each_once", "cut_only_if_needed", (F.col("most") <= CAPACITY).alias("none_too_full"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repair(spark.read.parquet(f"{d}/documents.parquet")).where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return repair(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_pieces_hold": p2_pieces_hold,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p4_ngrams": p4_ngrams,
    "p5_found": p5_found,
    "p5_log_entropy": p5_log_entropy,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p6_recall_holds": p6_recall_holds,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_windows": p9_windows,
    "p9_windows_hold": p9_windows_hold,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

_LIVE = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, n ORDER BY vec DESC) AS k FROM stored_passages) WHERE k = 1)"""
_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda t: length(t) <= 64)"
_TERMS = f"""
WITH {_LIVE},
t AS (SELECT vec, unnest({_TOKENS.format("text")}) AS term FROM live WHERE text IS NOT NULL),
c AS (SELECT term, count(*) AS cf, count(DISTINCT vec) AS df FROM t GROUP BY 1),
b AS (SELECT *, CASE WHEN df < 3 THEN 'rare' WHEN df > 0.15 * (SELECT count(*) FROM live WHERE text IS NOT NULL) THEN 'common' END AS band FROM c)"""
_NOTE_TERMS = f"""
WITH {_LIVE},
ti AS (SELECT path, max(title) AS title FROM stored_passages WHERE path IS NOT NULL GROUP BY 1),
w AS (SELECT path, unnest({_TOKENS.format("title")}) AS term FROM ti UNION ALL SELECT path, unnest({_TOKENS.format("text")}) FROM live WHERE path IS NOT NULL),
f AS (SELECT path, term, count(*) AS tf FROM w GROUP BY 1, 2),
n AS (SELECT count(DISTINCT path) AS n FROM stored_passages)"""
_SIZE = r"len(regexp_extract_all(lower({}), '[\p{{P}}\p{{S}}]|[^\s\x0B\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}\p{{P}}\p{{S}}]{{1,6}}'))"
_OVERSIZED = f"""
WITH {_LIVE},
s AS (SELECT path, n, text, array_to_string(list_filter(list_prepend(title, coalesce(trail, [])), lambda x: x IS NOT NULL), ' > ') AS prefix FROM live WHERE text IS NOT NULL),
o AS (SELECT path, n FROM s WHERE {_SIZE.format("text")} > greatest(8, 110 - {_SIZE.format("prefix")}))"""
ORACLES = {
    # All more similar vectors of a pair above the limit are above it as well, so the ranks of such pairs are enough.
    "p6_found": """
WITH v AS (SELECT vec, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM passage_vectors
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
u AS (SELECT vec, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))::DOUBLE[64] AS u FROM v),
p AS (SELECT a.vec AS a, b.vec AS b, array_inner_product(a.u, b.u) AS c FROM u a JOIN u b ON a.vec < b.vec AND array_inner_product(a.u, b.u) >= 0.925),
d AS (SELECT a, b, c FROM p UNION ALL SELECT b, a, c FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 7) DESC, b) AS k FROM d)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 10""",
    "p6_recall_holds": """
SELECT count(DISTINCT vec) AS asked, true AS recall_holds FROM passage_vectors WHERE vec % 50 = 0 AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p4_found": _TERMS + " SELECT term, band FROM b WHERE band IS NOT NULL",
    "p4_terms": _TERMS + " SELECT term, cf, df, band FROM b",
    "p4_ngrams": f"""
WITH {_LIVE},
t AS (SELECT vec, {_TOKENS.format("text")} AS tok FROM live WHERE text IS NOT NULL),
g AS (SELECT vec, k AS n, unnest(list_transform(range(1, len(tok) - k + 2), lambda i: array_to_string(tok[i:i + k - 1], ' '))) AS gram
      FROM t, (SELECT unnest([1, 2, 3]) AS k) WHERE len(tok) >= k)
SELECT gram, n, count(*) AS cf, count(DISTINCT vec) AS df FROM g GROUP BY 1, 2""",
    "p5_found": _NOTE_TERMS + """,
d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
s AS (SELECT path, term, row_number() OVER (PARTITION BY path ORDER BY round(tf * ln(n.n::DOUBLE / df), 6) DESC, term) AS k FROM f JOIN d USING (term), n)
SELECT path, term FROM s WHERE k <= 3""",
    "p5_log_entropy": _NOTE_TERMS + """,
d AS (SELECT term, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) AS h FROM f GROUP BY 1)
SELECT path, term, round(ln(1 + tf) * (1 - h / ln(n.n)), 6) AS weight FROM f JOIN d USING (term), n""",
    "p2_found": _OVERSIZED + " SELECT path, n FROM o",
    "p2_pieces_hold": _OVERSIZED + " SELECT path, n, true AS all_fit, true AS nothing_lost, true AS overlaps, true AS lines_right FROM o",
    "p9_windows_hold": "SELECT count(*) AS documents, true AS each_once, true AS cut_only_if_needed, true AS none_too_full FROM documents",
}
