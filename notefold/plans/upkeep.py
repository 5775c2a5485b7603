"""Queries of the record-upkeep problems (1, 3 and 7) and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notefold.operators.incremental import replay
from notefold.operators.snapshots import snapshot_changes
from notefold.streaming.changefeed import apply_feed, live


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(spark, spark.read.parquet(f"{d}/note_scans.parquet"), spark.read.parquet(f"{d}/sync_runs.parquet"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(spark.read.parquet(f"{d}/note_snapshots.parquet"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return live(apply_feed(spark, f"{d}/put_del_log.parquet"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p7_found": p7_found}

ORACLES = {
    # A note's fingerprint changes only at the first run that sees a row, so the runs are windowed instead of joined.
    "p1_found": """
WITH ok AS (SELECT run_id, started_ms, row_number() OVER (ORDER BY started_ms, run_id) AS i
            FROM (SELECT DISTINCT run_id, started_ms FROM sync_runs WHERE status = 'ok' AND started_ms IS NOT NULL)),
s AS (SELECT path, struct_pack(t := seen_ms, k := coalesce(scan_id, -1), h := sha256) AS v,
             (SELECT min(i) FROM ok WHERE started_ms >= arrived_ms) AS i
      FROM note_scans WHERE path IS NOT NULL AND sha256 IS NOT NULL AND seen_ms IS NOT NULL),
b AS (SELECT path, i, max(v) AS v FROM s WHERE i IS NOT NULL GROUP BY 1, 2),
c AS (SELECT path, i, (max(v) OVER (PARTITION BY path ORDER BY i)).h AS h FROM b),
d AS (SELECT path, i, h, lag(h) OVER (PARTITION BY path ORDER BY i) AS before FROM c)
SELECT run_id, path FROM d JOIN ok USING (i) WHERE before IS NULL OR before <> h""",
    "p3_found": """
WITH last AS (SELECT snapshot_no, max(delivery_no) AS delivery_no FROM note_snapshots GROUP BY 1),
idx AS (SELECT *, row_number() OVER (ORDER BY snapshot_no) AS i FROM last),
r AS (SELECT DISTINCT i.i, replace(nfc_normalize(s.path), chr(160), ' ') AS path, coalesce(ltrim(lower(trim(s.sha256)), '0'), '-') AS h
      FROM note_snapshots s JOIN idx i ON s.snapshot_no = i.snapshot_no AND s.delivery_no = i.delivery_no
      WHERE s.path IS NOT NULL)
SELECT n.snapshot_no, coalesce(a.path, b.path) AS path,
       CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT r.*, i + 1 AS nxt FROM r WHERE i < (SELECT max(i) FROM idx)) b
FULL JOIN (SELECT * FROM r WHERE i > 1) a ON a.i = b.nxt AND a.path = b.path
JOIN idx n ON n.i = coalesce(a.i, b.nxt)
WHERE a.h IS DISTINCT FROM b.h""",
    "p7_found": """
SELECT path, gen, pos FROM (
  SELECT path, gen, pos, lower(trim(op)) AS op, row_number() OVER (PARTITION BY path ORDER BY gen DESC, pos DESC) AS k
  FROM put_del_log WHERE op IS NOT NULL AND path IS NOT NULL AND lower(trim(op)) <> 'header') WHERE k = 1 AND op = 'put'""",
}
