"""Passages kept in step with a stream of note records.

New log files are picked up by a checkpointed file source, by name: what a run finds is its one
micro-batch, worked off in the order of the files' names (not of their dates, which tell nothing of
files written side by side), some files at a time. Their lines are read in splits, so a file may be
of any length. The records of some files are reduced to the last one of each note, by file name and
line, and applied as one commit of the index's store: notes, passages, vectors, postings and lengths
together. The store remembers, for each streaming query, the last batch that it holds and the file
that it has reached in the next one, so what is repeated after a failure changes nothing, and a query
with a new checkpoint starts from its own beginning. ``availableNow`` works off what is there and ends.

Defined results: records without path or with another op than put and del change nothing; of several
records of a note in a run the last by (file, line) counts; a note whose last record is a put
without passages has none; passages without text are left out; a torn line ends its file.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from notefold.embed import Embedder, HashedWords
from notefold.functions.shown import duration
from notefold.operators.chunking import embed_passages
from notefold.operators.postings import doc_lengths, postings
from notefold.sources.log import log_lines, log_text
from notefold.storage import Scratch
from notefold.store import Change, Store

log = logging.getLogger(__name__)
FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"  # the contents are never asked for, and not read
AS_NAMED = {"recursiveFileLookup": "true", "__globPaths__": "false"}  # as the file source itself reads files: brackets in a name are no pattern


def apply_records(store: Store, records: DataFrame, batch: int, query: str = "", make: Callable[[], Embedder] = HashedWords, reached: str | None = None) -> bool:
    """One commit of (file, pos, record fields): each note's last put replaces what the index has of it, a delete takes it away.

    False if the store holds this batch of this query already. With ``reached`` they are only the batch's
    records up to the file of this name, and more of the batch is to come.
    """
    state = store.state()
    done = state.meta.get("batches", {})
    if done.get(query, -1) >= batch:
        return False  # it was committed before the stream broke off
    with store.lock(), Scratch(store.spark) as scratch:
        known = records.where(F.col("path").isNotNull() & F.col("op").isin("put", "del"))
        fields = F.struct("op", "sha256", "size", "mtimeMs", "fip", "title", "passages")
        last = scratch.table(known.groupBy("path").agg(F.max_by(fields, F.struct("file", "pos")).alias("r")).select("path", "r.*"), "last")
        puts = last.where("op = 'put'")
        rows = puts.select("path", "title", F.explode("passages").alias("p")).select("path", "title", "p.*").where(F.col("text").isNotNull())
        head = F.array_join(F.concat(F.array_compact(F.array("title")), F.coalesce("trail", F.array().cast("array<string>"))), " > ")
        rows = embed_passages(rows.withColumn("embed_text", F.concat(head, F.lit("\n"), "text")).drop("vec"), make)
        rows = scratch.table(rows, "passages")
        count = F.size(F.filter("passages", lambda p: p["text"].isNotNull()))
        flagged = F.size(F.filter("passages", lambda p: p["text"].isNotNull() & (F.size(p["flags"]) > 0)))
        none = F.array().cast("array<string>")
        notes = puts.select(
            "path", "sha256", "size", F.col("mtimeMs").alias("mtime_ms"), F.lit(True).alias("racy"), F.coalesce("fip", F.lit(False)).alias("fip"), "title", none.alias("aliases"), none.alias("tags"),
            F.greatest(F.lit(0), count).alias("passages"), F.greatest(F.lit(0), flagged).alias("flagged"),
        )
        gone = last.select("path")
        changes = {
            "notes": Change(gone, notes, True),
            "passages": Change(gone, rows, True),
            "vectors": Change(gone, rows.where(F.col("vector").isNotNull()), True),
            "postings": Change(gone, postings(rows).withColumn("tf", F.col("tf").cast("int")), True),
            "lengths": Change(gone, doc_lengths(rows).withColumn("doc_len", F.col("doc_len").cast("int")), True),
        }
        within = {q: at for q, at in state.meta.get("within", {}).items() if q != query}
        held = {"within": within, "batches": done | {query: batch}} if reached is None else {"within": within | {query: [batch, reached]}}
        store.commit(state, changes, state.meta | held, True)
    return True


def waiting_files(store: Store, files: set[tuple[str, str]], batch: int, query: str) -> list[tuple[str, str]]:
    """Of a batch's files, (name, path), those that the store doesn't hold yet, by name."""
    meta = store.state().meta
    if meta.get("batches", {}).get(query, -1) >= batch:
        return []
    number, reached = meta.get("within", {}).get(query, (batch, ""))
    return sorted(f for f in files if number != batch or f[0] > reached)


def files_a_batch(rate: float) -> int:
    """How much to ask for at once: about five seconds' work at a rate a second, within bounds."""
    return max(8, min(128, round(rate * 5)))


def settled_files(files: DataFrame, settle_ms: int) -> DataFrame:
    """Only files that were last written long enough ago: one that is still growing waits for a later run."""
    age = F.unix_millis(F.current_timestamp()) - F.unix_millis("changed")
    return files.where(age >= settle_ms)


def progress(query: StreamingQuery) -> str | None:
    """A line about a running query, by counts only: batch, rows, rows a second, how long the batch took."""
    p = query.lastProgress
    if not p:
        return None
    return f"batch {p['batchId']}: {p['numInputRows']} rows, {round(p.get('processedRowsPerSecond') or 0)} a second, {duration(p.get('batchDuration') or 0)}"


def stream_log(spark: SparkSession, folder: str, store: Store, checkpoint: str, files_per_batch: int = 100, make: Callable[[], Embedder] = HashedWords, settle_ms: int = 0) -> None:
    """Work off the log files of a folder, in the order of their names, ``files_per_batch`` for each commit, and end.

    With ``settle_ms`` the run refuses to start while a file of the folder was written that shortly before.
    """
    if settle_ms:
        young = spark.read.format("binaryFile").load(folder).select(F.col("modificationTime").alias("changed"))
        if young.count() != settled_files(young, settle_ms).count():
            log.info("stream: a log file is still being written, nothing is read yet")
            return
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder).select(F.col("_metadata.file_path").alias("file"), "path")

    def write(batch: DataFrame, number: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        waiting = waiting_files(store, {(r["file"], r["path"]) for r in batch.collect()}, number, query_id)  # the engine lists names in brackets repeatedly
        for i in range(0, len(waiting), files_per_batch):
            some = waiting[i : i + files_per_batch]
            with Scratch(spark) as scratch:
                records = log_lines(log_text(spark, [path for _, path in some], **AS_NAMED), scratch.table)
                reached = some[-1][0] if i + files_per_batch < len(waiting) else None
                apply_records(store, records.select("file", "pos", "r.*"), number, query_id, make, reached)

    query = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if line := progress(query):
        log.info("stream: %s", line)
