"""Postings of passages: term counts, lengths, document frequencies, and their upkeep.

A passage's fields are its title, its trail's headings and its text; only distinctive tokens are
posted. Exploding and counting happen in one partial and one final aggregate. Where both postings
and lengths are wanted of texts that aren't indexed, ``tokenised`` reads and cuts each text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.functions.text import distinctive_tokens, tokens

MOST_TF, MOST_LEN = 255, 65_535
K1, B = 1.2, 0.75


def fields(title: str = "title", trail: str = "trail", text: str = "text") -> Column:
    """The searched parts of a passage, each on its own; null parts are left out."""
    heads = F.coalesce(F.col(trail), F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(F.col(title)), heads, F.array(F.col(text))))


def field_tokens() -> Column:
    """The distinctive tokens of all fields: a line break between fields ends a token as a field's end does."""
    return distinctive_tokens(F.array_join(fields(), "\n"))


def postings(passages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(path, n, token, tf), tf at most 255; with ``only``, of these tokens, the others never leaving their row."""
    found = field_tokens()
    if only is not None:
        found = F.filter(found, lambda t: t.isin(*only) if only else F.lit(False))
    words = passages.select("path", "n", F.explode(found).alias("token"))
    return words.groupBy("path", "n", "token").agg(F.count(F.lit(1)).alias("hits")).select("path", "n", "token", F.least(F.col("hits"), F.lit(MOST_TF)).alias("tf"))


def tokenised(passages: DataFrame, only: list[str]) -> DataFrame:
    """(path, n, doc_len, words): each passage's length and, of its tokens, those asked for; from one cut of its text."""
    rows = passages.select("path", "n", field_tokens().alias("tokens"))
    wanted = F.filter("tokens", lambda t: t.isin(*only) if only else F.lit(False))
    return rows.select("path", "n", F.least(F.size("tokens"), F.lit(MOST_LEN)).cast("long").alias("doc_len"), wanted.alias("words"))


def postings_of(tokenised_: DataFrame) -> DataFrame:
    """As ``postings``, of what ``tokenised`` gave."""
    words = tokenised_.select("path", "n", F.explode("words").alias("token"))
    return words.groupBy("path", "n", "token").agg(F.count(F.lit(1)).alias("hits")).select("path", "n", "token", F.least(F.col("hits"), F.lit(MOST_TF)).alias("tf"))


def doc_lengths(passages: DataFrame) -> DataFrame:
    """(path, n, doc_len): the distinctive tokens of each passage, at most 65535; passages without any have 0."""
    return passages.select("path", "n", F.least(F.size(field_tokens()), F.lit(MOST_LEN)).cast("long").alias("doc_len"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def document_frequencies(post: DataFrame, lengths: DataFrame) -> DataFrame:
    """(token, df, idf): the passages that hold each token."""
    stats = corpus_stats(lengths)
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats.select("passages"))).select("token", "df", F.round(idf(F.col("passages"), F.col("df")), 6).alias("idf"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: passages, sum_len, avg_len."""
    return lengths.agg(F.count(F.lit(1)).alias("passages"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("sum_len")).withColumn("avg_len", F.when(F.col("passages") > 0, F.col("sum_len") / F.col("passages")).otherwise(F.lit(0.0)))


def note_state(passages: DataFrame) -> DataFrame:
    """(path, state): a fingerprint of what a note's postings depend on."""
    one = F.struct("n", "title", "trail", "text")
    return passages.groupBy("path").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.xxhash64(one).cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(one, F.lit(1))).alias("xor")).select(
        "path", F.sha2(F.concat_ws("/", "path", F.col("passages").cast("string"), F.col("sum").cast("string"), F.col("xor").cast("string")), 256).alias("state")
    )


def refresh_postings(old: DataFrame, old_state: DataFrame, passages: DataFrame) -> DataFrame:
    """The postings of ``passages``, reusing the rows of notes whose state is as it was.

    Only texts of new and changed notes are tokenised: the state join is on narrow columns, and the
    texts are reached by a semi-join.
    """
    state = note_state(passages)
    same = state.join(old_state, ["path", "state"], "left_semi").select("path")
    changed = state.join(old_state, ["path", "state"], "left_anti").select("path")
    return old.join(same, "path", "left_semi").unionByName(postings(passages.join(changed, "path", "left_semi")))


def phrase_fields(fields_: Column) -> Column:
    """Each field as its tokens with blanks around, for a search of neighbours within one field."""
    return F.transform(fields_, lambda f: F.concat(F.lit(" "), F.array_join(tokens(f), " "), F.lit(" ")))
