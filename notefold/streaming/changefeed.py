"""Applying a stream of inserts, updates and deletes.

A keyed streaming state holds, for each key, the payload and the sequence of the last record that
counted; a delete stays as a tombstone, so that an older put that comes late can't bring the key
back. Only a record with a greater sequence replaces the state's: the state is the greatest
(sequence, op, payload), kept by the engine's own stateful aggregation, so no record leaves the JVM.
Each micro-batch hands on the state of the keys it touched, as upserts (of a key that saw nothing
newer the same row again), and they replace the folder of that batch's number: a batch that is
repeated after a failure writes the same rows to the same place.

The aggregate is partial before the shuffle: a key with a third of all records sends a row from
each task that read some of it, not its records, to the one task that holds its state.

Defined results: records without op, key or sequence and ``header`` records change nothing; op is
read without case and outer blanks; a repeated record is the same record; of different records
with one sequence the greater (op, payload) counts, in whatever order they come; an op that is
neither ``put`` nor ``del`` is the key's last record all the same and the key isn't live; extra
columns are ignored; an empty feed has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.storage import fresh_path, is_folder

PAYLOAD = "sha256 STRING, size LONG, mtime_ms LONG, title STRING, passages INT"
RECORD = f"path STRING, gen INT, pos LONG, op STRING, {PAYLOAD}"
_PAYLOAD = [c.split()[0] for c in PAYLOAD.split(", ")]


def records(feed: DataFrame) -> DataFrame:
    """The feed's records that count, with ``op`` in one form."""
    op = F.lower(F.regexp_replace("op", r"(?U)^\s+|\s+$", ""))
    good = F.col("op").isNotNull() & F.col("path").isNotNull() & F.col("gen").isNotNull() & F.col("pos").isNotNull() & (F.col("op") != "header")
    return feed.withColumn("op", op).where(good).select("path", "gen", "pos", "op", *_PAYLOAD)


def upserts(feed: DataFrame) -> DataFrame:
    """The state of each key that a batch of the feed touched (tombstones included); for update mode."""
    newest = F.max(F.struct("gen", "pos", "op", *_PAYLOAD)).alias("m")
    return records(feed).groupBy("path").agg(newest).select("path", "m.*")


def apply_feed(spark: SparkSession, path: str, files_per_batch: int = 8, root: str | None = None) -> DataFrame:
    """Run the feed at ``path`` (Parquet) to its end; the upserts of all batches, with ``batch``."""
    root = root or fresh_path(spark, "feed")
    schema = spark.read.parquet(path).schema
    where = path if is_folder(spark, path) else f"{path[:-1]}[{path[-1]}]"  # the file source takes a single file only as a pattern
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(where)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = (
        upserts(feed)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    try:
        return spark.read.schema(RECORD + ", batch INT").parquet(f"{root}/out")
    except Exception as e:  # no batch: an empty feed
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD + ", batch INT")


def live(applied: DataFrame) -> DataFrame:
    """The keys whose last record is a put, each with the record that counts.

    A key's later batches hold its greater sequences, so its greatest sequence is its last upsert.
    """
    last = applied.groupBy("path").agg(F.max(F.struct("gen", "pos", "op")).alias("m"))
    return last.where(F.col("m.op") == "put").select("path", "m.gen", "m.pos")
