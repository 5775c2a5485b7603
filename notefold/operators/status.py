"""The consistency checks: does the index say what its source says?

Each source gives one row of counts, and the manifest is held against the postings note for note.
``verify_checks`` goes through the contents: postings made again, passages cut again, vectors of a
sample made again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.embed import Embedder
from notefold.functions.vectors import similarity, vector_ok
from notefold.operators.chunking import embed_passages
from notefold.operators.cosine import top_k
from notefold.operators.numbering import stratified
from notefold.operators.postings import doc_lengths, postings

SAMPLES, SAMPLE_TOP, SAMPLE_OFF = 50, 10, 1e-4


@dataclass
class StatusInput:
    plan: DataFrame  # (path, action) of a shallow plan
    manifest: DataFrame  # (path, passages)
    vectors: DataFrame  # (path, n)
    postings: DataFrame  # (path, n), a row for each passage listed
    dead_records: int = 0
    skipped_last_run: int = 0
    stamps: dict[str, str] = field(default_factory=dict)  # "index" and what was built from it
    versions_match: bool = True


def passage_ids(manifest: DataFrame) -> DataFrame:
    """(path, n) of every passage that a manifest lists."""
    return manifest.where(F.col("passages") > 0).select("path", F.explode(F.sequence(F.lit(0), F.col("passages").cast("int") - 1)).alias("n"))


def id_differences(a: DataFrame, b: DataFrame) -> int:
    """Ids in one but not in the other, both ways."""
    x, y = a.select("path", "n").distinct(), b.select("path", "n").distinct()
    both = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), ["path", "n"], "full_outer")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull()).count()


def note_differences(manifest: DataFrame, listed: DataFrame) -> int:
    """Notes for which a manifest and a table's rows don't give the same number of passages."""
    m = manifest.groupBy("path").agg(F.sum("passages").alias("_m"))
    both = m.join(listed.groupBy("path").agg(F.count(F.lit(1)).alias("_l")), "path", "full_outer")
    return both.where(F.coalesce("_m", F.lit(0)) != F.coalesce("_l", F.lit(0))).count()


def not_listed(manifest: DataFrame, *tables: DataFrame) -> int:
    """Rows of tables (path, n) whose passage a manifest doesn't list: text that should have gone."""
    ids = passage_ids(manifest)
    return sum(t.join(ids, ["path", "n"], "left_anti").count() for t in tables)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@dataclass
class VerifyInput:
    manifest: DataFrame  # (path, passages)
    passages: DataFrame
    vectors: DataFrame  # (path, n, vector)
    postings: DataFrame  # (path, n, token, tf)
    lengths: DataFrame  # (path, n, doc_len)
    fresh: DataFrame  # the passages of the notes whose bytes are as indexed, cut again, with embed_text
    make: Callable[[], Embedder]


def _sampled(v: VerifyInput, dims: int) -> bool:
    """Whether sampled passages' vectors, made again, are the stored ones and find what an exact scan finds."""
    some = stratified(v.fresh, SAMPLES, "path", "n").dropDuplicates(["path", "n"])
    w = Window.orderBy("path", "n")  # at most SAMPLES rows
    some = embed_passages(some.select("path", "n", "embed_text"), v.make).where(F.col("vector").isNotNull()).withColumn("wording", F.row_number().over(w))
    again = v.fresh.sparkSession.createDataFrame(some.select("wording", "path", "n", "vector").collect(), "wording INT, path STRING, n INT, vector ARRAY<FLOAT>")
    stored = v.vectors.where(vector_ok("vector", dims)).select("path", "n", "vector")
    own = again.join(stored.withColumnRenamed("vector", "kept"), ["path", "n"], "left").select(similarity(F.col("vector"), F.col("kept")).alias("s"))
    if not own.where(F.coalesce(F.col("s"), F.lit(0.0)) < 1 - SAMPLE_OFF).isEmpty():
        return False
    found = top_k(stored, again, SAMPLE_TOP, dims).select("wording", "rank", F.col("score").alias("_a"))
    scan = stored.crossJoin(F.broadcast(again.select("wording", F.col("vector").alias("asked")))).select("wording", "path", "n", similarity(F.col("asked"), F.col("vector")).alias("_b"))
    w = Window.partitionBy("wording").orderBy(F.desc("_b"), "path", "n")
    scan = scan.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SAMPLE_TOP).select("wording", "rank", "_b")
    both = found.join(scan, ["wording", "rank"], "full_outer")
    return both.where(F.coalesce(F.abs(F.col("_a") - F.col("_b")) >= SAMPLE_OFF, F.lit(True))).isEmpty()


def verify_checks(spark: SparkSession, v: VerifyInput) -> DataFrame:
    """(name, ok) of the checks that read all contents; the vectors' is a sample."""
    dims = v.make().dimensions
    words = postings(v.passages).select("path", "n", "token", F.col("tf").cast("int").alias("tf"))
    lengths = doc_lengths(v.passages).select("path", "n", F.col("doc_len").cast("int").alias("doc_len"))
    words_ok = same_rows(words, v.postings.select("path", "n", "token", "tf")) and same_rows(lengths, v.lengths.select("path", "n", "doc_len"))
    cols = ["path", "n", "title", "trail", "heads", "rep", "line", "text", "recovered"]
    as_cut = same_rows(v.passages.select(*cols).join(v.fresh.select("path").distinct(), "path", "left_semi"), v.fresh.select(*cols))
    whole = same_rows(v.passages.select("path", "n"), passage_ids(v.manifest)) and v.passages.where(F.col("text").isNull()).isEmpty()
    vectors = v.vectors.where(vector_ok("vector", dims)).select("path", "n")
    checks = [
        ("verify-spot-check", _sampled(v, dims)),
        ("verify-exact-words", words_ok),
        ("verify-sidecar", whole and as_cut and same_rows(vectors, passage_ids(v.manifest))),
    ]
    return spark.createDataFrame(checks, "name STRING, ok BOOLEAN")


def status_checks(spark: SparkSession, s: StatusInput, passages: DataFrame | None = None) -> DataFrame:
    """(name, ok). ``passages`` (path, n), where passage numbers aren't 0 .. count - 1."""
    n = {r["action"]: r["n"] for r in s.plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    notes = s.manifest.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("passages"), F.lit(0)).alias("passages")).first()
    vectors = s.vectors.count()
    removed = n.get("removed", 0) + n.get("dropped", 0)
    pending = n.get("new", 0) + n.get("changed", 0) + removed
    left_out = n.get("left-out", 0) + n.get("dropped", 0)
    seen = sum(v for k, v in n.items() if k != "removed")
    of_index = s.stamps.get("index")
    ids = passages if passages is not None else s.postings
    checks = [
        ("disk-matches-manifest", n.get("new", 0) == 0 and removed == 0),
        ("nothing-pending", pending == 0),
        ("nothing-skipped", n.get("skipped", 0) == 0 and (s.skipped_last_run == 0 or pending == 0)),
        ("counts-add-up", seen == notes["notes"] + left_out),
        ("passages-match", notes["passages"] == vectors),
        ("vectors-current", s.stamps.get("vectors") == of_index),
        ("exact-words-match", note_differences(s.manifest, s.postings) == 0 and s.stamps.get("postings") == of_index),
        ("no-old-text", s.dead_records == 0),
        ("versions-match", s.versions_match),
        ("verify-every-id", id_differences(ids, s.vectors) == 0),
    ]
    return spark.createDataFrame(checks, "name STRING, ok BOOLEAN")
