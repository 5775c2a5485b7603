"""How distinctive a term is for each note, by two SQL aggregations.

The first aggregation counts each term within each note, the second what the collection has of the
term: the notes that hold it (for tf-idf) or the entropy of its spread over the notes (for
log-entropy weights). The weight is then a matter of one row.

Layout: the live passages are put together by note, so most of the first aggregation happens
where the texts lie and its rows are never shuffled. A note with more stored rows than a quarter of
what a partition holds on average (so at most four for each partition, a list that doesn't grow
with the input) is spread by passage number over half as many salts as there are partitions, and
only the counts of those notes are added up once more. The terms that many notes
hold come back to their rows by broadcast: a list of at most ``FREQUENT`` terms, bounded because
only terms in more than rows / FREQUENT notes are on it. All others join by shuffle; none of them
is large enough to skew it.

Defined results: a null title or text has no terms; a title counts once per note however many
rows repeat it (of several titles of a note the greatest counts); a note without terms has no
row; N counts the distinct non-null paths of all stored rows; ties go to the smaller term by code
points; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions.text import tokens
from notefold.operators.passages import live_passages
from notefold.storage import write_table

HOT_ROWS = 2_000
SALTS = 16
FREQUENT = 20_000


def note_terms(stored: DataFrame) -> DataFrame:
    """(path, term, tf): the first aggregation."""
    has_path = stored.where(F.col("path").isNotNull())
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_rows, salts = max(HOT_ROWS, stored.count() // (4 * parts)), max(SALTS, parts // 2)
    hot = has_path.groupBy("path").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows).select("path", F.lit(True).alias("hot"))
    titles = has_path.groupBy("path").agg(F.max("title").alias("text")).select("path", F.lit(0).alias("n"), F.lit(0).cast("long").alias("vec"), "text", F.lit(True).alias("is_title"))
    texts = has_path.select("path", "n", "vec", "text", F.lit(False).alias("is_title"))
    rows = texts.unionByName(titles).join(F.broadcast(hot), "path", "left")
    rows = rows.withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("n"), F.lit(salts))).otherwise(F.lit(0)))
    live = live_passages(rows.repartition("path", "salt"), "text", "hot", by=["salt", "is_title"])
    words = live.select("path", "salt", "hot", F.explode(tokens("text")).alias("term"))
    # The rows lie by (path, salt), so this needs no shuffle; it is written because it is read often.
    counts = write_table(words.groupBy("path", "salt", "hot", "term").agg(F.count(F.lit(1)).alias("tf")), "note-terms")
    again = counts.where("hot").groupBy("path", "term").agg(F.sum("tf").alias("tf"))
    return counts.where("NOT hot").select("path", "term", "tf").unionByName(again)


def term_weights(stored: DataFrame, weighting: str = "tf_idf") -> DataFrame:
    """(path, term, weight) of every term of every note, by ``tf_idf`` or ``log_entropy``.

    tf_idf is tf * ln(N / df). log_entropy is ln(1 + tf) * (1 - H / ln N), with H the entropy of
    the term's occurrences over the notes: H = ln(gf) - sum(tf ln tf) / gf. Both to 6 decimals.
    """
    notes = stored.where(F.col("path").isNotNull()).select("path").distinct().count()
    first = note_terms(stored)
    tf = F.col("tf").cast("double")
    spread = first.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("gf"), F.sum(tf * F.ln(tf)).alias("tlt"))
    if weighting == "tf_idf":
        spread = spread.select("term", "df", F.ln(F.lit(float(notes)) / F.col("df")).alias("weight"))
        local = tf
    elif weighting == "log_entropy":
        scale = F.lit(math.log(notes)) if notes > 1 else F.lit(1.0)
        entropy = F.ln("gf") - F.col("tlt") / F.col("gf")
        spread = spread.select("term", "df", (F.lit(1.0) - entropy / scale).alias("weight"))
        local = F.ln(F.lit(1.0) + tf)
    else:
        raise ValueError(f"no such weighting: {weighting}")
    spread = write_table(spread, "term-spread")
    often = first.count() / FREQUENT  # the df sum up to that count, so at most FREQUENT terms are above
    frequent = F.broadcast(spread.where(F.col("df") > often).select("term", "weight"))
    by_broadcast = first.join(frequent, "term")
    by_shuffle = first.join(frequent, "term", "left_anti").join(spread.where(F.col("df") <= often).select("term", "weight"), "term")
    return by_broadcast.unionByName(by_shuffle).select("path", "term", F.round(local * F.col("weight"), 6).alias("weight"))


def top_terms(weights: DataFrame, k: int = 3) -> DataFrame:
    """Each note's ``k`` highest terms, with their rank."""
    w = Window.partitionBy("path").orderBy(F.desc("weight"), F.asc("term"))
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
