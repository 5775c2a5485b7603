"""Record logs in JSON lines: puts with their passages, deletes, headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notefold.storage import write_table

RECORD = (
    "v INT, op STRING, path STRING, sha256 STRING, size LONG, mtimeMs LONG, fip BOOLEAN, title STRING, "
    "passages ARRAY<STRUCT<n: INT, trail: ARRAY<STRING>, heads: ARRAY<STRING>, rep: BOOLEAN, line: INT, text: STRING, vec: LONG, flags: ARRAY<STRING>, recovered: BOOLEAN>>"
)


def log_text(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(file, block, value): the lines of log files, however a scan splits these; ``block`` is where a line's split starts."""
    lines = spark.read.options(**options).option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def log_lines(lines: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(file, pos, r): the whole records of log files (their lines, by ``log_text``), each with its line's number.

    A file is read up to its first torn or unreadable line, as a log that broke off there: what stands
    behind it isn't told apart from what was never finished. Blank lines count but are no records.
    Lines are parsed once, in the tasks that read them, and ``keep`` writes them as a table: a split's
    lines are numbered in their order there, whatever reads them later. What is sent to all tasks is a
    row for each split, with the lines before it and its first torn one.
    """
    read = lines.select("file", "block", F.monotonically_increasing_id().alias("at"), (F.trim("value") == "").alias("blank"), F.from_json("value", RECORD).alias("r"))
    kept = keep(read, "lines")
    torn = F.min(F.when(~F.col("blank") & F.col("r.op").isNull(), F.col("at")))
    blocks = kept.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"), torn.alias("end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")
    blocks = blocks.select("file", "block", "end", shift.alias("shift"), F.count("end").over(before).alias("torn")).where("torn = 0")
    rows = kept.where(F.col("r.op").isNotNull()).join(F.broadcast(blocks), ["file", "block"])
    return rows.where(F.col("end").isNull() | (F.col("at") < F.col("end"))).select("file", (F.col("at") + F.col("shift")).alias("pos"), "r")


def read_log(spark: SparkSession, path: str, gen: int = 1) -> DataFrame:
    """(gen, file, pos, record fields) of every whole record; order within a ``gen`` is by (file, pos). Their table stays below the shared folder."""
    return log_lines(log_text(spark, path), write_table).select(F.lit(gen).alias("gen"), "file", "pos", "r.*")


def write_log(records: DataFrame, path: str) -> None:
    """Records as JSON lines, fields that are null left out."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.text(path)


def live_records(log: DataFrame) -> DataFrame:
    """The put records that count: of each path the last record by (gen, pos), if it is a put."""
    from notefold.operators.lastput import last_put_wins

    rows = log.where("op <> 'header'").select(F.col("path").alias("key"), F.struct("gen", "file", "pos").alias("seq"), "op", *[c for c in log.columns if c not in ("op",)])
    return last_put_wins(rows).drop("key")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of questions with their rewordings and expected notes."""
    schema = "n INT, question STRING, phrasings ARRAY<STRING>, exact STRING, expected STRING, alternates ARRAY<STRING>"
    return spark.read.schema(schema).json(path, multiLine=True)
