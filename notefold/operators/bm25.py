"""BM25 over postings for many wordings at once, and the exact-words list.

Wordings are a small table (a call's questions). Postings are reduced to the words asked for by a
filter that reaches the scan (``words_of``) and a broadcast of those words before anything else
happens, so what is joined and grouped grows with the matches, not with the corpus. A wording's hits
are never ranked as a whole: each task keeps the first few before they are brought together, and
texts are read back only for those.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.functions.text import question_phrases, question_words, tokens
from notefold.operators.cosine import held, local_table
from notefold.operators.postings import B, K1, corpus_stats, fields, idf, phrase_fields
from notefold.storage import write_table

PER_WORDING, SHOWN, MOST_WORDS, MOST_CHECKED = 3, 3, 255, 300


def wordings_table(spark: SparkSession, questions: list[str]) -> DataFrame:
    """(wording, words, phrases, required): what each wording asks for; words past the 255th distinct one of a call are left out.

    A call's few questions: a local table, cut into words by the same expressions as the texts.
    """
    asked = local_table(spark, pa.table({"wording": pa.array(range(len(questions)), pa.int32()), "question": pa.array(questions, pa.string())}))
    rows = asked.select("wording", question_words("question").alias("words"), question_phrases("question").alias("phrases")).toArrow().sort_by("wording").to_pylist()
    kept = set(list(dict.fromkeys(w for r in rows for w in r["words"]))[:MOST_WORDS])
    out = [(r["wording"], [w for w in r["words"] if w in kept], r["phrases"], [w for w in dict.fromkeys(t for p in r["phrases"] for t in p) if w in kept]) for r in rows]
    words = pa.list_(pa.string())
    types = [("wording", pa.int32()), ("words", words), ("phrases", pa.list_(words)), ("required", words)]
    return local_table(spark, pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(types)], schema=pa.schema(types)))


def words_of(wordings: DataFrame) -> list[str]:
    """The words that one call asks for, at most 255."""
    return sorted({w for r in wordings.select("words").collect() for w in r["words"]})


def bm25(post: DataFrame, lengths: DataFrame, wordings: DataFrame) -> DataFrame:
    """(wording, path, n, score): every passage that holds a word of the wording and all required ones.

    ``wordings`` holds (wording, words, required); its size is that of a call's questions.
    """
    asked = F.broadcast(wordings.select("wording", "required", F.explode("words").alias("token")).select("wording", "token", F.expr("array_contains(required, token)").alias("must")))
    words = wordings.select(F.explode("words").alias("token")).distinct()
    hits = post.join(F.broadcast(words), "token")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(corpus_stats(lengths))
    # The hits are the small side; only their passages' lengths are kept.
    scored = (
        hits.join(F.broadcast(df), "token")  # a row for each word asked for
        .join(lengths, ["path", "n"])
        .crossJoin(stats)
        .join(asked, "token")
        .select("wording", "path", "n", "must", "token", (idf(F.col("passages"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len"))))).alias("part"))
    )
    sums = scored.groupBy("wording", "path", "n").agg(F.sum("part").alias("score"), F.sum(F.col("must").cast("int")).alias("held"))
    need = F.broadcast(wordings.select("wording", F.size("required").alias("need")))
    return sums.join(need, "wording").where(F.col("held") == F.col("need")).select("wording", "path", "n", "score")


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """With ``rank`` within the wording: score descending, ties to the earlier passage."""
    w = Window.partitionBy("wording").orderBy(F.desc(F.round("score", 9)), "path", "n")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def _read_back(cand: DataFrame, passages: DataFrame, asks: DataFrame) -> DataFrame:
    """(wording, path, n, score, words, ok): a few candidates held against their texts."""
    cand = F.broadcast(cand).join(passages.select("path", "n", "title", "trail", "text"), ["path", "n"]).join(F.broadcast(asks), "wording")
    padded = phrase_fields(fields())
    seen = F.array_distinct(F.flatten(F.transform(fields(), tokens)))
    cand = cand.select("wording", "path", "n", "score", "phrases", F.array_intersect("words", seen).alias("words"), padded.alias("padded"))
    holds = F.forall("phrases", lambda p: F.exists("padded", lambda f: F.contains(f, F.concat(F.lit(" "), F.array_join(p, " "), F.lit(" ")))))
    return cand.select("wording", "path", "n", "score", "words", ((F.size("words") > 0) & holds).alias("ok"))


def _walk(rows: list, per_wording: int, most_checked: int) -> tuple[list, bool]:
    """The hits of one wording's candidates in rank order, and whether the walk ended before them."""
    found, notes, checked = [], set(), 0
    for r in sorted(rows, key=lambda r: (-round(r["score"], 9), r["path"], r["n"])):
        if r["path"] in notes:
            continue
        if checked == most_checked or len(found) == per_wording:
            return found, True
        checked += 1
        if r["ok"]:
            found.append(r)
            notes.add(r["path"])
    return found, checked == most_checked or len(found) == per_wording


def exact_words(scores: DataFrame, passages: DataFrame, wordings: DataFrame, per_wording: int = PER_WORDING, most_checked: int = MOST_CHECKED) -> DataFrame:
    """(wording, place, path, n, score, words): the best passages of each wording, one for each note.

    Candidates are read back in rank order until ``per_wording`` notes are found or
    ``most_checked`` candidates of notes that were not found yet have been looked at. With no
    phrase every candidate passes, so the best ``per_wording`` notes are enough; with one, the first
    ``most_checked`` are looked at, and as often as a note was found and candidates may be left,
    the first ones of the other notes. What is held is that many rows a wording of one call.
    """
    spark = scores.sparkSession
    asks = wordings.select("wording", "words", "phrases")
    quoted = [r["wording"] for r in wordings.where(F.size("phrases") > 0).select("wording").collect()]
    if quoted:  # they may be ranked more than once
        scores = write_table(scores, "scores")
    plain = scores.where(~F.col("wording").isin(quoted))
    best = F.max_by(F.struct("n", "score"), F.struct(F.round("score", 9), -F.col("n")))
    firsts = plain.groupBy("wording", "path").agg(best.alias("b")).select("wording", "path", "b.n", "b.score")
    w = Window.partitionBy("wording").orderBy(F.desc(F.round("score", 9)), "path")
    firsts = firsts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_wording).drop("k")
    cand = firsts
    if quoted:
        cand = cand.unionByName(ranked(scores.where(F.col("wording").isin(quoted)), most_checked).select("wording", "path", "n", "score"))
    hits: dict[int, list] = {}
    for r in _read_back(held(cand), passages, asks).collect():
        hits.setdefault(r["wording"], []).append(r)
    out = {w: _walk(rows, per_wording, most_checked)[0] for w, rows in hits.items() if w not in quoted}
    rows = {w: hits.get(w, []) for w in quoted}
    more = {w for w in quoted if len(rows[w]) >= most_checked}
    for _ in range(per_wording):
        walks = {w: _walk(rows[w], per_wording, most_checked) for w in quoted}
        out |= {w: found for w, (found, _) in walks.items()}
        open_ = [(w, h["path"]) for w, (found, ended) in walks.items() if w in more and not ended for h in found]
        if not open_:
            break
        asked = sorted({w for w, _ in open_})
        passed = spark.createDataFrame(open_, "wording INT, path STRING")
        others = scores.where(F.col("wording").isin(asked)).join(F.broadcast(passed), ["wording", "path"], "left_anti")
        known = {w: {(r["path"], r["n"]) for r in rows[w]} for w in asked}
        new = _read_back(held(ranked(others, most_checked).select("wording", "path", "n", "score")), passages, asks).collect()
        more = {w for w in asked if sum(r["wording"] == w for r in new) >= most_checked}
        for r in new:
            if (r["path"], r["n"]) not in known[r["wording"]]:
                rows[r["wording"]].append(r)
    rows = [(w, i, r["path"], r["n"], r["score"], r["words"]) for w in sorted(out) for i, r in enumerate(out[w])]
    types = pa.schema([("wording", pa.int32()), ("place", pa.int32()), ("path", pa.string()), ("n", pa.int32()), ("score", pa.float64()), ("words", pa.list_(pa.string()))])
    return local_table(spark, pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.types)], schema=types))


def interleaved(hits: DataFrame) -> DataFrame:
    """The wordings' hits as one list: by place, score, wording; a note's first hit only. With ``pos`` from 0."""
    order = [F.asc("place"), F.desc(F.round("score", 9)), F.asc("wording")]
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("k = 1").drop("k")
    return first.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def not_already_shown(hits: DataFrame, shown: DataFrame, most: int = SHOWN) -> DataFrame:
    """The hits that the other list doesn't show, at most ``most``, with ``rank`` from 1."""
    left = hits.join(shown.select("path", "n"), ["path", "n"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.orderBy("pos"))).where(F.col("rank") <= most)
