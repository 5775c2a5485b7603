"""A question's two lists: passages nearest by meaning and passages with its exact words, never fused."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.links import build_link
from notefold.functions.screen import mask_secrets
from notefold.functions.text import snippet
from notefold.operators.bm25 import SHOWN, bm25, exact_words, wordings_table, words_of
from notefold.operators.cosine import clamp_count, fetch_notes, local_table

log = logging.getLogger(__name__)


def half_up(c: Column, digits: int) -> Column:
    """Rounding as shown scores are: half up, in floating point."""
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def passage_id(path: str = "path", n: str = "n") -> Column:
    return F.concat(F.col(path), F.lit("#"), F.col(n).cast("string"))


def shape(hits: DataFrame, passages: DataFrame, root: str, vault: str | None) -> DataFrame:
    """Hits with what a reader is shown. Passages are reached only for the hits: late materialisation."""
    rows = F.broadcast(hits).join(passages.select("path", "n", "trail", "heads", "rep", "line", "text", "flags", "recovered"), ["path", "n"])
    text = mask_secrets("text")
    trail = F.coalesce("trail", F.array().cast("array<string>"))
    link = build_link(F.lit(vault), F.col("path"), F.col("heads"), F.col("rep"), F.col("recovered")) if vault else F.lit(None).cast("string")
    return rows.select(
        *hits.columns,
        F.regexp_replace(F.substring_index("path", "/", -1), r"(?i)\.md$", "").alias("note"),
        F.array_join(trail, " > ").alias("section"),
        F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")).alias("file"),
        "line",
        link.alias("link"),
        snippet(text).alias("snippet"),
        text.alias("text"),
        passage_id().alias("passage"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
    )


def search(passages: DataFrame, vectors: DataFrame, manifest: DataFrame, post: DataFrame, lengths: DataFrame, questions: list[str], question_vectors: DataFrame | list[tuple[int, list[float]]], dims: int, count: int | None = None, with_exact: bool = True, root: str = "", vault: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(by meaning, by exact words), both held: what a reader is shown, at most 50 and 3 rows.

    The first list is the same with the second on or off. The two are looked for at the same time.
    Nothing that fails in the second, its reading of texts included, fails the search: the list is
    then None.
    """

    spark = passages.sparkSession

    def by_words() -> list[dict]:
        asked = wordings_table(spark, questions)
        words = words_of(asked)
        found = post.where(F.col("token").isin(words)) if words else post.limit(0)
        return exact_words(bm25(found, lengths, asked), passages, asked).toArrow().to_pylist()  # at most three a wording

    with ThreadPoolExecutor(2) as pool:
        second = pool.submit(inheritable_thread_target(spark)(by_words)) if with_exact else None
        notes = fetch_notes(vectors, question_vectors, manifest, clamp_count(count), dims).toArrow()
        if second is None:
            return _shown(spark, notes, None, passages, root, vault)
        try:
            return _shown(spark, notes, _not_shown(second.result(), notes), passages, root, vault)
        except Exception as e:  # the list by meaning stands without it
            log.warning("the exact-words list was left out: %s", type(e).__name__, exc_info=log.isEnabledFor(logging.DEBUG))
            return _shown(spark, notes, None, passages, root, vault)


def _not_shown(hits: list[dict], notes: pa.Table, most: int = SHOWN) -> pa.Table:
    """What ``interleaved`` and ``not_already_shown`` give, of the few hits of one call."""
    hits = sorted(hits, key=lambda h: (h["place"], -round(h["score"], 9), h["wording"]))
    shown = set(zip(notes["path"].to_pylist(), notes["n"].to_pylist()))
    left = [h for h in {h["path"]: h for h in reversed(hits)}.values() if (h["path"], h["n"]) not in shown]
    left = sorted(left, key=lambda h: (h["place"], -round(h["score"], 9), h["wording"]))[:most]
    types = [("rank", pa.int32()), ("path", pa.string()), ("n", pa.int32()), ("score", pa.float64()), ("words", pa.list_(pa.string()))]
    return pa.table([pa.array([i + 1 for i in range(len(left))], pa.int32()), *(pa.array([h[c] for h in left], t) for c, t in types[1:])], schema=pa.schema(types))


def _shown(spark: SparkSession, notes: pa.Table, exact: pa.Table | None, passages: DataFrame, root: str, vault: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Both lists' passages read in one job, and held."""
    rows = local_table(spark, notes).select("rank", "path", "n", "score", "more_passages", F.lit(None).cast("array<string>").alias("words"), F.lit(1).alias("list"))
    if exact is not None:
        rows = rows.unionByName(local_table(spark, exact).withColumn("list", F.lit(2)), allowMissingColumns=True)
    score = F.when(F.col("list") == 1, half_up(F.col("score"), 3)).otherwise(half_up(F.col("score"), 2))
    both = shape(rows, passages, root, vault).withColumn("score", score).toArrow().sort_by("rank")
    of = lambda k, drop: local_table(spark, both.filter(pc.equal(both["list"], k)).drop_columns(["list", drop]))
    return of(1, "words"), None if exact is None else of(2, "more_passages")
