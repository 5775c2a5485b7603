"""Processing only new or changed records: the target is the state.

Every output row stores the source's key and the version it was made from (the fingerprint of the
record's bytes). A run reduces what the source shows it to the newest record of each key,
anti-joins that on (key, version) with the target's current rows, and publishes what is left as one
new version of the target. There is no mark of how far earlier runs had read: what is in the target
decides alone. So a record that becomes visible late is taken up by the next run, however old its
arrival date; a run that breaks off before it publishes has no effect; nothing is skipped and
nothing repeated, and results don't depend on where one run ends and the next begins.

The source is read in five columns, reduced in each task before any shuffle (a hot key sends a row
per task), and records that arrived after the run's start are left out by the scan. A source that
lies in buckets of the key isn't shuffled at all: where many runs read one source, it is laid out
that way once. The target's current rows are one base segment and at most ``compact_after`` deltas.

Defined results: records without key, fingerprint, version or arrival change nothing; repeated and
late records lose to the newest (version columns, then the greater fingerprint); a newer record with
the same fingerprint isn't new; a key whose newest record is no longer in the source is put out
again if its newest record there has another fingerprint; extra columns of the source are ignored;
an empty source publishes a version without rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notefold.storage import Scratch, Version, VersionedTarget, fresh_path

TARGET = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("seen_ms", T.LongType()),
        T.StructField("scan_id", T.LongType()),
        T.StructField("run_id", T.IntegerType()),
        T.StructField("number", T.LongType()),  # the target's version that the row was published with
    ]
)


@dataclass(frozen=True)
class Run:
    run_id: int
    until_ms: int


def visible(source: DataFrame, until_ms: int) -> DataFrame:
    """The newest record of each key among those that had arrived."""
    here = (F.col("arrived_ms") <= until_ms) & F.col("sha256").isNotNull() & F.col("path").isNotNull() & F.col("seen_ms").isNotNull()
    return source.where(here).groupBy("path").agg(F.max(F.struct("seen_ms", "scan_id", "sha256")).alias("m")).select("path", "m.*")


def current(rows: DataFrame, *columns: str) -> DataFrame:
    """Of rows of several published versions the last of each key."""
    columns = columns or tuple(c for c in TARGET.names if c not in ("path", "number"))
    return rows.groupBy("path").agg(F.max(F.struct("number", *columns)).alias("m")).select("path", "m.*")


def pending(source: DataFrame, target: VersionedTarget, base: Version, run: Run) -> DataFrame:
    """What a run has to do: rows of the target's schema for keys whose newest version isn't in it."""
    new = visible(source, run.until_ms)
    if base.state:
        new = new.join(current(target.state(base), "sha256").select("path", "sha256"), ["path", "sha256"], "left_anti")
    return new.withColumn("run_id", F.lit(run.run_id).cast("int")).withColumn("number", F.lit(base.number + 1).cast("long"))


def run_once(source: DataFrame, target: VersionedTarget, run: Run, compact_after: int = 8, fail_before_publish: bool = False) -> Version:
    """One run: write its segment, then publish. ``fail_before_publish`` is for tests of broken runs."""
    base = target.current()
    if base.meta.get("until_ms") is not None and run.until_ms < base.meta["until_ms"]:
        raise ValueError("a run can't start before the last published one")
    segment = target.write_segment(pending(source, target, base, run))
    if fail_before_publish:
        raise RuntimeError("broke off before publishing")
    state = (*base.state, segment)
    if len(state) > compact_after:  # the deltas are merged now and then, so a run reads few segments
        state = (target.write_segment(current(target._read(state)), "state"),)
    return target.publish(base, state, (*base.outputs, segment), {"until_ms": run.until_ms, "run_id": run.run_id})


def replay(spark: SparkSession, source: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """Play all runs of a run table in the order of ``started_ms``; (run_id, path) that each put out.

    Only runs with status ``ok`` publish; the others broke off and leave no trace. The run table
    is control data of a few rows, read to the driver; the records never are.
    """
    target = VersionedTarget(spark, root or fresh_path(spark, "incremental"), TARGET)
    good = runs.where((F.col("status") == "ok") & F.col("started_ms").isNotNull()).select("run_id", "started_ms").distinct()
    with Scratch(spark) as scratch:
        source = scratch.clustered(source.select("path", "sha256", "seen_ms", "scan_id", "arrived_ms"), "path", "scans")
        for r in sorted(good.collect(), key=lambda r: (r["started_ms"], r["run_id"])):
            run_once(source, target, Run(r["run_id"], r["started_ms"]))
    return target.outputs().select("run_id", "path")
