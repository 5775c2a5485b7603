"""Queries of the search operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.text import distinctive_tokens, question_phrases, question_words, snippet, stand_in_size, tokens
from notefold.functions.vectors import vector_ok
from notefold.operators import bm25 as b
from notefold.operators import cosine as c
from notefold.operators import postings as p
from notefold.operators.numbering import stratified
from notefold.operators.passages import live_passages
from notefold.operators.recall import recall_at_k
from notefold.plans import sql
from notefold.storage import evenly, write_table

DIMS = 64
QUESTIONS = [
    "which kettle did we fix with the boiler before winter",
    "garlic and pepper for the compost bed",
    'what about the "last meeting" and the bridge',
    'how do I do it "open questions"',
    "вода и хлеб на зима",
]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def passages(spark: SparkSession, d: str) -> DataFrame:
    return live_passages(_table(spark, d, "stored_passages"), "title", "trail", "heads", "rep", "line", "text", "flags", "recovered").where(F.col("text").isNotNull())


def tokens_count(spark: SparkSession, d: str) -> DataFrame:
    rows = evenly(_table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text"))
    return rows.select("doc_id", F.size(tokens("text")).alias("n_tokens"))


def distinctive_count(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).select("path", "n", F.size(distinctive_tokens("text")).alias("n_tokens"))


def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return p.postings(passages(spark, d))


def postings_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Postings brought up from those of the first half of the rows stored: equal to fresh ones."""
    stored = _table(spark, d, "stored_passages")
    middle = stored.agg(F.percentile_approx("vec", 0.5)).first()[0] or 0
    then = live_passages(stored.where(F.col("vec") <= middle), "title", "trail", "text").where(F.col("text").isNotNull())
    return p.refresh_postings(p.postings(then), p.note_state(then), passages(spark, d))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return p.doc_lengths(passages(spark, d))


def df_idf(spark: SparkSession, d: str) -> DataFrame:
    live = passages(spark, d)
    return p.document_frequencies(p.postings(live), p.doc_lengths(live))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return p.corpus_stats(p.doc_lengths(passages(spark, d))).withColumn("avg_len", F.round("avg_len", 6))


def questions_read(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "wording INT, question STRING")
    return asked.select("wording", F.array_join(question_words("question"), " ").alias("words"), F.array_join(F.transform(question_phrases("question"), lambda x: F.array_join(x, " ")), "/").alias("phrases"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    live = passages(spark, d)
    asked = b.wordings_table(spark, QUESTIONS)
    cut = write_table(p.tokenised(live, b.words_of(asked)), "tokenised")
    return b.bm25(p.postings_of(cut), cut, asked), live, asked


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)[0].withColumn("score", F.round("score", 6))


def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    return b.ranked(_scores(spark, d)[0], 10).withColumn("score", F.round("score", 6))


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """The passages that hold the quoted phrases of each question that has some, all of them."""
    asked = {r["wording"]: [f" {' '.join(p)} " for p in r["phrases"]] for r in b.wordings_table(spark, QUESTIONS).collect() if r["phrases"]}
    rows = passages(spark, d).select("path", "n", p.phrase_fields(p.fields()).alias("padded"))
    holds = lambda phrase: F.exists("padded", lambda f: F.contains(f, F.lit(phrase)))
    hit = [F.when(F.array_min(F.array(*[holds(x) for x in phrases])), F.lit(w)) for w, phrases in asked.items()]
    return rows.select(F.explode(F.array_compact(F.array(*hit))).alias("wording"), "path", "n")


def _exact(spark: SparkSession, d: str) -> DataFrame:
    scores, live, asked = _scores(spark, d)
    return b.exact_words(scores, live, asked)


def exact_words_per_wording(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d).select("wording", "place", "path", "n", F.round("score", 6).alias("score"), F.array_join("words", " ").alias("words"))


def exact_words_interleaved(spark: SparkSession, d: str) -> DataFrame:
    return b.interleaved(_exact(spark, d)).select("pos", "wording", "path", "n", F.round("score", 6).alias("score"))


def exact_not_shown(spark: SparkSession, d: str) -> DataFrame:
    """The list by words without the passages that a list by meaning shows (here: the first two of this list)."""
    hits = b.interleaved(_exact(spark, d))
    return b.not_already_shown(hits, hits.where("pos < 2")).select("rank", "path", "n")


def live_vectors(spark: SparkSession, d: str) -> DataFrame:
    return live_passages(_table(spark, d, "passage_vectors"), F.col("embedding").alias("vector"))


def _question_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("wording"), F.col("embedding").alias("vector"))


def vector_valid(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "passage_vectors").select("vec", vector_ok("embedding", DIMS).alias("ok"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings").select(F.lit("").alias("path"), F.col("vec_id").alias("n"), F.col("embedding").alias("vector"))
    return c.top_k(rows, _question_vectors(spark, d), 10, DIMS).select("wording", "n", "rank", F.round("score", 6).alias("score"))


def meaning_topk(spark: SparkSession, d: str) -> DataFrame:
    return c.top_k(live_vectors(spark, d), _question_vectors(spark, d), 50, DIMS).select("wording", "path", "n", "rank", F.round("score", 6).alias("score"))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return live_passages(_table(spark, d, "stored_passages")).groupBy("path").agg((F.max("n") + 1).alias("passages"))


def collapse_best_passage(spark: SparkSession, d: str) -> DataFrame:
    hits = c.known(c.top_k(live_vectors(spark, d), _question_vectors(spark, d), 50, DIMS), _manifest(spark, d))
    return c.collapse(hits).select("path", "n", F.round("score", 6).alias("score"), "more_passages")


def refetch_topk(spark: SparkSession, d: str) -> DataFrame:
    """Top folders taken as notes, so that few notes crowd the first fetch."""
    v = live_vectors(spark, d).select(F.substring_index("path", "/", 1).alias("path"), F.col("vec").cast("int").alias("n"), "vector")
    manifest = v.groupBy("path").agg((F.max("n") + 1).alias("passages"))
    return c.fetch_each(v, _question_vectors(spark, d), manifest, 8, DIMS).select("wording", "rank", "path", "n", F.round("score", 6).alias("score"), "more_passages")


def semi_known(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose passage the manifest lists."""
    m = _manifest(spark, d)
    return c.known(live_vectors(spark, d).select("path", "n", "vec"), m).select("vec")


def recall(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "embeddings")
    rows = e.select(F.lit("").alias("path"), F.col("vec_id").alias("n"), F.col("embedding").alias("vector"))
    found = c.top_k(rows, _question_vectors(spark, d), 11, DIMS).where(F.col("n") != F.col("wording"))
    label = e.select(F.col("vec_id").alias("n"), F.col("label").alias("found"))
    expect = e.select(F.col("vec_id").alias("wording"), F.col("label").alias("expected"))
    return recall_at_k(found.join(label, "n").join(expect, "wording"), [1, 3, 10])


def snippet_400(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).select("path", "n", snippet("text").alias("snippet"))


def stand_in_tokens(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).select("path", "n", stand_in_size("text").alias("size"))


def densest_passages(spark: SparkSession, d: str) -> DataFrame:
    """The 200 passages of most tokens; ties by text, path and n."""
    return passages(spark, d).select("path", "n", "text", stand_in_size("text").alias("size")).orderBy(F.desc("size"), "text", "path", "n").limit(200).select("path", "n", "size")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """50 positions spread evenly over the vectors, each with its vector's number."""
    distinct = _table(spark, d, "passage_vectors").select("vec").distinct()
    return stratified(distinct, 50, "vec").select("sample", "ordinal", "vec")


QUERIES = {
    f.__name__: f
    for f in (
        tokens_count, distinctive_count, postings_tf, postings_refresh, doc_lengths, df_idf, corpus_stats, questions_read, bm25_scores, bm25_top10, phrase_match,
        exact_words_per_wording, exact_words_interleaved, exact_not_shown, vector_valid, cosine_topk, meaning_topk, collapse_best_passage, refetch_topk, semi_known,
        recall, snippet_400, stand_in_tokens, densest_passages, stratified_sample,
    )
}

_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") AS t(wording, question))"
_ASK = f"""{_Q},
qw AS (SELECT wording, list_filter(list_distinct_ordered, lambda x: true) AS words FROM (SELECT wording, list_filter(tok, lambda t, i: list_position(tok, t) = i) AS list_distinct_ordered FROM (SELECT wording, {sql.distinctive("question")} AS tok FROM q))),
ph AS (SELECT wording, unnest(regexp_extract_all(question, '["“]([^"“”]+)["”]', 1)) AS phrase FROM q),
phr AS (SELECT wording, {sql.tokens("phrase")} AS tok FROM ph WHERE len({sql.distinctive("phrase")}) > 0),
req AS (SELECT DISTINCT wording, token FROM (SELECT wording, unnest(tok) AS token FROM phr) WHERE EXISTS (SELECT 1 FROM qw WHERE qw.wording = wording AND list_contains(qw.words, token)))"""
_SCORES = f"""
WITH {sql.POSTINGS}, {_ASK},
asked AS (SELECT wording, unnest(words) AS token FROM qw),
reqd AS (SELECT r.wording, r.token FROM req r JOIN asked a ON a.wording = r.wording AND a.token = r.token),
parts AS (SELECT a.wording, p.path, p.n, p.token,
            ln(1 + (s.passages - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.doc_len / s.avg_len)) AS part
          FROM post p JOIN asked a ON a.token = p.token JOIN df d ON d.token = p.token JOIN len l ON l.path = p.path AND l.n = p.n, stats s),
scores AS (SELECT wording, path, n, sum(part) AS score FROM parts GROUP BY 1, 2, 3
           HAVING count(*) FILTER (EXISTS (SELECT 1 FROM reqd r WHERE r.wording = parts.wording AND r.token = parts.token)) = coalesce((SELECT count(*) FROM reqd r WHERE r.wording = parts.wording), 0)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY round(score, 9) DESC, path, n) AS rank FROM scores)"""
_PAD = f"list_transform({sql.FIELDS}, lambda f: ' ' || array_to_string({sql.tokens('f')}, ' ') || ' ')"
_EXACT = f"""{_SCORES},
cand AS (SELECT r.*, list_filter(w.words, lambda x: list_contains(flatten(list_transform({sql.FIELDS.replace("title", "l.title").replace("trail", "l.trail").replace("text", "l.text")}, lambda f: {sql.tokens("f")})), x)) AS words,
           NOT EXISTS (SELECT 1 FROM phr WHERE phr.wording = r.wording AND len(list_filter({_PAD.replace("[title]", "[l.title]").replace("trail,", "l.trail,").replace("[text]", "[l.text]")}, lambda f: contains(f, ' ' || array_to_string(phr.tok, ' ') || ' '))) = 0) AS holds
         FROM ranks r JOIN live l ON l.path = r.path AND l.n = r.n JOIN qw w ON w.wording = r.wording),
oks AS (SELECT *, len(words) > 0 AND holds AS ok, coalesce(max(len(words) > 0 AND holds) OVER (PARTITION BY wording, path ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM cand),
chk AS (SELECT *, sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY wording ORDER BY rank) AS checked FROM oks),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY rank) - 1 AS place FROM chk WHERE ok AND NOT before AND checked <= 300) WHERE place < 3),
inter AS (SELECT *, row_number() OVER (ORDER BY place, round(score, 9) DESC, wording) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY place, round(score, 9) DESC, wording) AS k2 FROM ex) WHERE k2 = 1)"""
_LIVE_VECTORS = "lv AS (SELECT path, n, vec, embedding AS v FROM (SELECT *, row_number() OVER (PARTITION BY path, n ORDER BY vec DESC) AS k FROM passage_vectors) WHERE k = 1)"
_MANIFEST = "man AS (SELECT path, max(n) + 1 AS passages FROM stored_passages GROUP BY 1)"
_HITS = f"""
WITH {_LIVE_VECTORS}, {_MANIFEST},
qv AS (SELECT vec_id AS wording, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT wording, path, n, {sql.cosine("v", "q")} AS score FROM lv, qv WHERE {sql.usable("v")}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY round(score, 9) DESC, path, n) AS rank FROM sc) WHERE rank <= 50)"""
_E_TOP = f"""
WITH sc AS (SELECT q.vec_id AS wording, q.label AS expected, e.vec_id AS n, e.label AS found, {sql.cosine("e.embedding", "q.embedding")} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
tk AS (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY round(score, 9) DESC, n) AS rank FROM sc)"""

ORACLES = {
    "tokens_count": f"SELECT doc_id, len({sql.tokens('text')}) AS n_tokens FROM documents WHERE text IS NOT NULL",
    "distinctive_count": f"WITH {sql.LIVE} SELECT path, n, len({sql.distinctive('text')}) AS n_tokens FROM live",
    "postings_tf": f"WITH {sql.POSTINGS} SELECT * FROM post",
    "postings_refresh": f"WITH {sql.POSTINGS} SELECT * FROM post",
    "doc_lengths": f"WITH {sql.POSTINGS} SELECT * FROM len",
    "df_idf": f"WITH {sql.POSTINGS} SELECT token, df, round(ln(1 + (s.passages - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats s",
    "corpus_stats": f"WITH {sql.POSTINGS} SELECT passages, sum_len, round(avg_len, 6) AS avg_len FROM stats",
    "questions_read": f"WITH {_ASK} SELECT wording, array_to_string(words, ' ') AS words, coalesce((SELECT string_agg(array_to_string(tok, ' '), '/') FROM phr WHERE phr.wording = qw.wording), '') AS phrases FROM qw",
    "bm25_scores": f"{_SCORES} SELECT wording, path, n, round(score, 6) AS score FROM scores",
    "bm25_top10": f"{_SCORES} SELECT wording, path, n, rank, round(score, 6) AS score FROM ranks WHERE rank <= 10",
    "phrase_match": f"""WITH {sql.LIVE}, {_ASK}
SELECT q.wording::INT AS wording, l.path, l.n FROM live l, (SELECT DISTINCT wording FROM phr) q
WHERE NOT EXISTS (SELECT 1 FROM phr WHERE phr.wording = q.wording AND len(list_filter({_PAD.replace("[title]", "[l.title]").replace("trail,", "l.trail,").replace("[text]", "[l.text]")}, lambda f: contains(f, ' ' || array_to_string(phr.tok, ' ') || ' '))) = 0)""",
    "exact_words_per_wording": f"{_EXACT} SELECT wording, place, path, n, round(score, 6) AS score, array_to_string(words, ' ') AS words FROM ex",
    "exact_words_interleaved": f"{_EXACT} SELECT pos, wording, path, n, round(score, 6) AS score FROM inter",
    "exact_not_shown": f"{_EXACT} SELECT row_number() OVER (ORDER BY pos) AS rank, path, n FROM inter WHERE pos >= 2 ORDER BY pos LIMIT 3",
    "vector_valid": f"SELECT vec, {sql.usable('embedding')} AS ok FROM passage_vectors",
    "cosine_topk": f"{_E_TOP} SELECT wording, n, rank, round(score, 6) AS score FROM tk WHERE rank <= 10",
    "meaning_topk": f"{_HITS} SELECT wording, path, n, rank, round(score, 6) AS score FROM hits",
    "collapse_best_passage": f"""{_HITS},
kn AS (SELECT h.* FROM hits h JOIN man m ON m.path = h.path AND h.n >= 0 AND h.n < m.passages),
best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, wording, n) AS k FROM kn)
SELECT b.path, b.n, round(b.score, 6) AS score, c.c - 1 AS more_passages FROM best b JOIN (SELECT path, count(DISTINCT n) AS c FROM kn GROUP BY 1) c USING (path) WHERE k = 1""",
    "refetch_topk": f"""
WITH {_LIVE_VECTORS}, qv AS (SELECT vec_id AS wording, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT wording, split_part(path, '/', 1) AS path, vec::INT AS n, {sql.cosine("v", "q")} AS score FROM lv, qv WHERE {sql.usable("v")}),
rk AS (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY round(score, 9) DESC, path, n) AS r FROM sc),
kk AS (SELECT wording, CASE WHEN count(DISTINCT path) FILTER (r <= 64) < 8 AND count(*) >= 64 THEN 256 ELSE 64 END AS k FROM rk GROUP BY 1),
kept AS (SELECT rk.*, row_number() OVER (PARTITION BY wording, path ORDER BY round(score, 9) DESC, n) AS p, count(*) OVER (PARTITION BY wording, path) AS c FROM rk JOIN kk USING (wording) WHERE r <= k),
o AS (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY round(score, 9) DESC, path) AS rank FROM kept WHERE p = 1)
SELECT wording, rank, path, n, round(score, 6) AS score, c - 1 AS more_passages FROM o WHERE rank <= 8""",
    "semi_known": f"WITH {_LIVE_VECTORS}, {_MANIFEST} SELECT vec FROM lv JOIN man m ON m.path = lv.path WHERE lv.n >= 0 AND lv.n < m.passages",
    "recall": f"""{_E_TOP},
o AS (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY rank) AS k FROM tk WHERE rank <= 11 AND n <> wording)
SELECT ks.k, round(avg(hit), 6) AS recall FROM (SELECT ks.k, o.wording, max((expected = found AND o.rank <= ks.k)::INT) AS hit FROM o, (SELECT unnest([1, 3, 10]) AS k) ks GROUP BY 1, 2) ks GROUP BY 1""",
    "snippet_400": rf"""WITH {sql.LIVE}, s AS (SELECT path, n, trim(regexp_replace(text, '[\s\x{{00A0}}\x{{2028}}\x{{2029}}\x{{FEFF}}\x{{3000}}\x{{2000}}-\x{{200A}}]+', ' ', 'g')) AS s FROM live)
SELECT path, n, CASE WHEN length(s) <= 400 THEN s WHEN regexp_matches(s[:401], '^.+ ') THEN regexp_extract(s[:401], '^(.+) ', 1) ELSE s[:400] END AS snippet FROM s""",
    "stand_in_tokens": f"WITH {sql.LIVE} SELECT path, n, {sql.size('text')} AS size FROM live",
    "densest_passages": f"WITH {sql.LIVE} SELECT path, n, size FROM (SELECT path, n, text, {sql.size('text')} AS size FROM live) ORDER BY size DESC, text, path, n LIMIT 200",
    "stratified_sample": """WITH d AS (SELECT vec, row_number() OVER (ORDER BY vec) - 1 AS ordinal FROM (SELECT DISTINCT vec FROM passage_vectors))
SELECT s AS sample, ordinal, vec FROM d JOIN (SELECT unnest(range(50)) AS s) t ON d.ordinal = (t.s * (SELECT count(*) FROM d)) // 50""",
}
