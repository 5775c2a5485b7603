"""Queries over folders made of the documents and logs made of the records: source, index and stream."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.index import Index
from notefold.operators.cosine import held
from notefold.operators.selftest import round_trip
from notefold.sources.vault import left_out_counts, read_listing
from notefold.storage import fresh_path
from notefold.store import Store
from notefold.streaming.changefeed import records
from notefold.streaming.syncs import stream_log

_LONG_AGO = 1_000_000


def _local(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which all executors can open as files."""
    path = fresh_path(spark, name)
    if "://" in path and not path.startswith("file:"):
        raise ValueError("notes are files: the shared folder must be mounted on every machine")
    return "/" + path.removeprefix("file:").lstrip("/")


def write_files(rows: DataFrame, root: str) -> int:
    """Write (path, content STRING) below a folder, by the executors; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.utime(at, (_LONG_AGO, _LONG_AGO))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("path", "content").repartition(8).mapInArrow(run, "n LONG").agg(F.sum("n")).first()[0] or 0


def _path() -> F.Column:
    i = F.col("doc_id")
    name = F.concat(F.lit("Note "), i.cast("string"))
    return (
        F.when(i % 40 == 3, F.concat(F.lit("Private/"), name, F.lit(".md")))
        .when(i % 40 == 5, F.concat(F.lit(".hidden/"), name, F.lit(".md")))
        .when(i % 40 == 7, F.concat(F.lit("Hidden/"), name, F.lit(".md")))
        .when(i % 40 == 9, F.concat(F.lit("Files/"), name, F.lit(".txt")))
        .when(i % 40 == 11, F.concat(F.lit("Inner/"), name, F.lit(".MD")))
        .otherwise(F.concat(F.lit("Folder "), (i % 7).cast("string"), F.lit("/"), name, F.lit(".md")))
    )


_PATH = """CASE doc_id % 40 WHEN 3 THEN 'Private/Note ' || doc_id || '.md' WHEN 5 THEN '.hidden/Note ' || doc_id || '.md' WHEN 7 THEN 'Hidden/Note ' || doc_id || '.md'
  WHEN 9 THEN 'Files/Note ' || doc_id || '.txt' WHEN 11 THEN 'Inner/Note ' || doc_id || '.MD' ELSE 'Folder ' || (doc_id % 7) || '/Note ' || doc_id || '.md' END"""


def _folder(spark: SparkSession, d: str) -> str:
    root = _local(spark, "vault")
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").isNotNull())
    write_files(docs.select(_path().alias("path"), F.col("text").alias("content")), root)
    for at, text in ((".obsidian/app.json", '{"userIgnoreFilters": ["Hidden/"]}'), ("Inner/.obsidian/app.json", "{}")):
        os.makedirs(os.path.dirname(os.path.join(root, at)), exist_ok=True)
        with open(os.path.join(root, at), "w", encoding="utf-8") as f:
            f.write(text)
    return root


def vault_listing(spark: SparkSession, d: str) -> DataFrame:
    """Every file of a folder, walked: what is a note, how large, and why some are left out."""
    return read_listing(spark, _folder(spark, d), ["private"]).select("path", "kind", "size", "reason")


def vault_left_out(spark: SparkSession, d: str) -> DataFrame:
    return left_out_counts(read_listing(spark, _folder(spark, d), ["private"]))


def _edited(spark: SparkSession, d: str, root: str) -> None:
    """Every tenth note is edited, every tenth of another remainder moved, every tenth of a third deleted."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").isNotNull() & ~(F.col("doc_id") % 40).isin(3, 5, 7, 9, 11))
    edited = docs.where(F.col("doc_id") % 10 == 0).select(_path().alias("path"), F.concat("text", F.lit("\n\nA line about the heliotrope.\n")).alias("content"))
    moved = docs.where(F.col("doc_id") % 10 == 1).select(F.concat(F.lit("Moved/Note "), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    write_files(edited.unionByName(moved), root)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                os.remove(os.path.join(root, path))
            yield b

    docs.where((F.col("doc_id") % 10).isin(1, 2)).select(_path().alias("path")).mapInArrow(remove, "path STRING").count()


def _index(spark: SparkSession, root: str) -> Index:
    return Index.create(spark, root, "file://" + _local(spark, "index"), exclude=["private"])


def index_life(spark: SparkSession, d: str) -> DataFrame:
    """What syncs count: of everything, after edits, moves and removals, and when nothing is left to do."""
    root = _folder(spark, d)
    index = _index(spark, root)
    first = index.sync()
    _edited(spark, d, root)
    second = index.sync(now_ms=10**13)
    third = index.sync()
    notes, left = index.store.read("notes").count(), index.store.read("left_out").count()
    rows = [("first added", first.counts["added"]), ("notes and left out", notes + left), ("edited", second.counts.get("updated", 0)), ("moved", second.counts["renamed"]), ("leaving", second.counts["leaving"])]
    rows += [("waiting at last", sum(third.counts.get(a, 0) for a in ("new", "changed", "added", "updated", "removed", "dropped", "skipped")))]
    return spark.createDataFrame(rows, "name STRING, notes LONG")


def index_as_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Of each table whether an index brought in step after edits holds what one made anew holds, row for row by their hashes."""
    root = _folder(spark, d)
    index = _index(spark, root)
    index.sync()
    _edited(spark, d, root)
    index.sync(now_ms=10**13)
    fresh = _index(spark, root)
    fresh.sync(now_ms=10**13)
    every = None
    for side, store in enumerate((index.store, fresh.store)):
        for t in ("notes", "passages", "vectors", "postings", "lengths", "left_out"):
            rows = store.read(t)
            some = rows.select(F.lit(t).alias("name"), F.lit(side).alias("side"), F.xxhash64(*[c for c in rows.columns if c != "racy"]).alias("h"))
            every = some if every is None else every.unionByName(some)
    sums = every.groupBy("name", "h").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return held(sums.groupBy("name").agg(F.min(F.col("a") == F.col("b")).alias("same")))


def index_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of an index just made, contents included, and a search for what some notes say."""
    root = _folder(spark, d)
    _edited(spark, d, root)
    index = _index(spark, root)
    index.sync()
    rows = [(r["name"], r["ok"]) for r in index.status(verify=True).collect()]
    meaning, exact = index.search(["where is the heliotrope"])
    hits, shown = [r["text"] for r in exact.collect()], [r["text"] for r in meaning.collect()]
    rows.append(("search finds the planted word", all("heliotrope" in t for t in hits) and any("heliotrope" in t for t in shown + hits) and 0 < len(shown) <= 8))
    return spark.createDataFrame(rows, "name STRING, ok BOOLEAN")


def self_test(spark: SparkSession, d: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{d}/embeddings.parquet"))


def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """An index kept by a stream of logs, a file for each generation, worked off two files at a time and once more from where it ended."""
    log, store = fresh_path(spark, "logs"), Store(spark, fresh_path(spark, "streamed"))
    feed = records(spark.read.parquet(f"{d}/put_del_log.parquet"))
    passage = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("trail"), F.lit(1).alias("line"), F.coalesce("title", "path").alias("text"), F.array().cast("array<string>").alias("flags"))
    line = F.to_json(F.struct("op", "path", "sha256", "size", F.col("mtime_ms").alias("mtimeMs"), "title", F.array(passage).alias("passages")))
    lines = feed.select(F.format_string("%06d", "gen").alias("gen"), "pos", line.alias("value"))
    lines.repartition("gen").sortWithinPartitions("gen", "pos", "value").drop("pos").write.partitionBy("gen").text(log)
    for _ in range(2):
        stream_log(spark, log, store, f"{log}-checkpoint", files_per_batch=2)
    passages, vectors, lengths = (store.read(t) for t in ("passages", "vectors", "lengths"))
    vectors, lengths = vectors.select("path", "n", F.lit(True).alias("has_vector")), lengths.select("path", "n", F.lit(True).alias("has_words"))
    rows = store.read("notes").select("path", "sha256").join(passages.select("path", "n", "text"), "path").join(vectors, ["path", "n"], "left").join(lengths, ["path", "n"], "left")
    return held(rows.select("path", "sha256", "text", "has_vector", "has_words"))


QUERIES = {f.__name__: f for f in (vault_listing, vault_left_out, index_life, index_as_fresh, index_checks, self_test, stream_sync)}

_FILES = f"""WITH f AS (SELECT doc_id, {_PATH} AS path, text, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL),
l AS (SELECT path, CASE WHEN path LIKE '%.txt' THEN 'other' ELSE 'note' END AS kind, CASE WHEN path LIKE '%.txt' THEN 0 ELSE size END AS size,
        CASE WHEN path LIKE 'Private/%' THEN 'excluded' WHEN path LIKE 'Hidden/%' THEN 'obsidian-excluded' WHEN path LIKE 'Inner/%' THEN 'nested-vault' END AS reason FROM f WHERE path NOT LIKE '.hidden/%'),
k AS (SELECT * FROM f WHERE doc_id % 40 NOT IN (3, 5, 7, 9, 11)),
w AS (SELECT *, len(regexp_extract_all(regexp_replace(regexp_replace(text, '^---\\r?\\n(?s:.*?)\\n---\\r?(\\n|$)', ''), '(^|\\n)#+ [^\\n]*', '', 'g'), '\\S+')) >= 3 AS enough FROM k)"""
_TABLES = ["notes", "passages", "vectors", "postings", "lengths", "left_out"]
_CHECKS = ["disk-matches-manifest", "nothing-pending", "nothing-skipped", "counts-add-up", "passages-match", "vectors-current", "exact-words-match", "no-old-text", "versions-match",
           "verify-every-id", "verify-spot-check", "verify-exact-words", "verify-sidecar", "search finds the planted word"]
ORACLES = {
    "vault_listing": f"{_FILES} SELECT * FROM l",
    "vault_left_out": f"{_FILES} SELECT reason, count(*) AS notes FROM l WHERE reason IS NOT NULL GROUP BY 1",
    "index_life": f"""{_FILES}
SELECT 'first added' AS name, count(*) AS notes FROM w WHERE enough UNION ALL
SELECT 'notes and left out', count(*) FROM k WHERE doc_id % 10 <> 2 UNION ALL
SELECT 'edited', count(*) FROM w WHERE doc_id % 10 = 0 AND enough UNION ALL
SELECT 'moved', count(*) FROM w WHERE doc_id % 10 = 1 AND enough UNION ALL
SELECT 'leaving', count(*) FROM w WHERE doc_id % 10 = 2 AND enough UNION ALL
SELECT 'waiting at last', 0""",
    "index_as_fresh": f"SELECT unnest({_TABLES!r}) AS name, true AS same",
    "index_checks": f"SELECT unnest({_CHECKS!r}) AS name, true AS ok",
    "self_test": "SELECT unnest(['top-k is an exact scan''s', 'vectors come back as written', 'each vector finds itself']) AS name, true AS ok",
    "stream_sync": """
SELECT path, sha256, coalesce(title, path) AS text, true AS has_vector, true AS has_words FROM (
  SELECT *, lower(trim(op)) AS o, row_number() OVER (PARTITION BY path ORDER BY gen DESC, pos DESC) AS k
  FROM put_del_log WHERE op IS NOT NULL AND path IS NOT NULL AND lower(trim(op)) <> 'header') WHERE k = 1 AND o = 'put'""",
}
