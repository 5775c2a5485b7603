"""Incremental runs, snapshot changes and the change feed against brute force, with dirty input."""

from __future__ import annotations

import random

import pytest

from notefold.operators.incremental import TARGET, Run, current, replay, run_once
from notefold.operators.snapshots import snapshot_changes
from notefold.storage import VersionedTarget
from notefold.streaming.changefeed import apply_feed, live

SCAN = "scan_id LONG, path STRING, sha256 STRING, seen_ms LONG, arrived_ms LONG, run_id STRING"


def brute_runs(scans, runs):
    before, out = {}, set()
    for run_id, start in sorted(runs, key=lambda r: (r[1], r[0])):
        now = {}
        for scan_id, path, sha, seen, arrived, _ in scans:
            if path is not None and sha is not None and arrived <= start:
                now[path] = max(now.get(path, ((-1, -1), "")), ((seen, scan_id), sha))
        out |= {(run_id, p) for p, (_, sha) in now.items() if before.get(p) != sha}
        before = {p: sha for p, (_, sha) in now.items()}
    return out


def some_scans(rng, n=300, hot=True):
    rows = []
    for i in range(n):
        path = "hot.md" if hot and rng.random() < 0.4 else rng.choice("abcdefg") + ".md"
        seen = rng.randrange(1000)
        rows.append((rng.randrange(80), path, rng.choice(["s1", "s2", "s3", None]), seen, seen + rng.choice([0, 5, 300]), "clash"))
    by_id = {}
    for r in rows:  # a scan id is one look: its repeats are the same row
        by_id.setdefault((r[0], r[3], r[1]), r)
    rows = list(by_id.values())
    return rows + rows[:20] + [(1, None, "s1", 5, 5, "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(spark, seed, tmp_path):
    rng = random.Random(seed)
    scans = some_scans(rng)
    runs = [(i, rng.randrange(1400)) for i in range(12)]
    table = spark.createDataFrame([(i, s, "ok") for i, s in runs] + [(99, 700, "failed"), (98, None, "ok"), (97, 900, None)], "run_id INT, started_ms LONG, status STRING")
    got = {tuple(r) for r in replay(spark, spark.createDataFrame(scans, SCAN), table, f"file://{tmp_path}/t").collect()}
    want = brute_runs([s for s in scans if s[2] is not None], runs)
    ties = {}  # of looks that tie in everything but the fingerprint the greater one counts, in both
    assert got == want, ties


def test_broken_run_is_made_up_for(spark, tmp_path):
    target = VersionedTarget(spark, f"file://{tmp_path}/t", TARGET)
    rows = [(1, "a", "x", 1, 1, ""), (2, "b", "x", 2, 2, "")]
    run_once(spark.createDataFrame(rows[:1], SCAN), target, Run(1, 1))
    source = spark.createDataFrame(rows, SCAN)
    with pytest.raises(RuntimeError):
        run_once(source, target, Run(2, 5), fail_before_publish=True)
    assert target.current().number == 1
    assert {r["path"] for r in target.outputs().collect()} == {"a"}
    run_once(source, target, Run(3, 6))
    assert {(r["run_id"], r["path"]) for r in target.outputs().collect()} == {(1, "a"), (3, "b")}
    assert len(target.vacuum()) == 1  # what the broken run left


def test_a_record_that_becomes_visible_late_is_not_skipped(spark, tmp_path):
    """It arrived, by its date, before the last run, but the source didn't show it then."""
    target = VersionedTarget(spark, f"file://{tmp_path}/t", TARGET)
    rows = [(1, "a", "x", 1, 1, ""), (2, "b", "x", 2, 2, "")]
    run_once(spark.createDataFrame(rows, SCAN), target, Run(1, 10))
    rows += [(3, "late", "y", 3, 3, ""), (4, "b", "z", 4, 4, ""), (5, "a", "x", 9, 9, ""), (0, "b", "old", 0, 0, "")]
    run_once(spark.createDataFrame(rows, SCAN), target, Run(2, 20))
    assert {(r["run_id"], r["path"], r["sha256"]) for r in target.outputs().where("run_id = 2").collect()} == {(2, "late", "y"), (2, "b", "z")}
    run_once(spark.createDataFrame(rows, SCAN), target, Run(3, 30))
    assert target.outputs().where("run_id = 3").count() == 0


def test_results_do_not_depend_on_run_boundaries(spark, tmp_path):
    """Equal versions with other fingerprints: the greater counts, within a run and between runs."""
    rows = [(1, "a", "m", 5, 1, ""), (1, "a", "z", 5, 2, "")]
    for name, ends in (("one", [3]), ("two", [1, 3])):
        target = VersionedTarget(spark, f"file://{tmp_path}/{name}", TARGET)
        for k, until in enumerate(ends):
            run_once(spark.createDataFrame(rows, SCAN), target, Run(k, until))
        assert current(target.state()).first()["sha256"] == "z"


def test_of_two_writers_one_publishes(spark, tmp_path):
    target = VersionedTarget(spark, f"file://{tmp_path}/t", TARGET)
    base = target.current()
    target.publish(base, (), (), {"until_ms": 1})
    with pytest.raises(Exception, match="FileAlreadyExists|already exists"):
        target.publish(base, (), (), {"until_ms": 2})


def test_runs_over_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCAN)
    runs = spark.createDataFrame([(1, 5, "ok")], "run_id INT, started_ms LONG, status STRING")
    assert replay(spark, empty, runs, f"file://{tmp_path}/a").count() == 0
    assert replay(spark, empty, runs.where("run_id > 1"), f"file://{tmp_path}/b").count() == 0


SNAP = "snapshot_no INT, delivery_no INT, path STRING, sha256 STRING, idx STRING"


def test_snapshot_changes(spark):
    e = "caf" + "é"  # decomposed
    rows = [
        (1, 1, "a", "0A", "x"), (1, 1, "a", "a", None), (1, 1, "b", None, ""), (1, 1, e, "1", ""), (1, 1, "sp ace", "2", ""), (1, 1, None, "9", ""),
        (3, 1, "zz", "1", ""),  # an older delivery, replaced
        (3, 2, "a", " 0xA ", ""), (3, 2, "b", "00", ""), (3, 2, "café", "001", ""), (3, 2, "sp ace", "3", ""),
        (7, None, "a", "a", ""), (None, 1, "q", "1", ""),
        (8, 1, "a", "b", ""), (8, 1, "b", None, ""), (8, 1, "café", "1", ""),
    ]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {
        (3, "b", "changed"), (3, "sp ace", "changed"),
        (7, "b", "removed"), (7, "café", "removed"), (7, "sp ace", "removed"),
        (8, "a", "changed"), (8, "b", "added"), (8, "café", "added"),
    }
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0


def test_snapshots_against_pairs(spark):
    rng = random.Random(3)
    snaps = {no: {f"k{rng.randrange(40)}": f"{rng.randrange(4):x}" for _ in range(30)} for no in (2, 3, 5, 9)}
    rows = [(no, 1, p, h, "") for no, s in snaps.items() for p, h in s.items()]
    want = set()
    for a, b in zip([2, 3, 5], [3, 5, 9]):
        for p in snaps[a].keys() | snaps[b].keys():
            x, y = snaps[a].get(p), snaps[b].get(p)
            if x != y:
                want.add((b, p, "added" if x is None else "removed" if y is None else "changed"))
    assert {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()} == want


FEED = "gen INT, pos LONG, v INT, op STRING, path STRING, sha256 STRING, size LONG, mtime_ms LONG, fip BOOLEAN, title STRING, passages INT"


def feed_rows(rng, n):
    rows = []
    for i in range(n):
        path = "hot" if rng.random() < 0.35 else rng.choice([*"abcdef", None])
        rows.append((rng.randrange(3), i, 1, rng.choice(["put", " PUT", "del ", "Del", "header", None, "put"]), path, f"s{i}", rng.choice([None, i]), i, None, None, None))
    rows += rng.sample(rows, n // 5)
    rng.shuffle(rows)
    return rows


def test_feed_in_many_batches(spark, tmp_path):
    rows = feed_rows(random.Random(5), 200)
    for i in range(4):  # four files, worked off two at a time
        spark.createDataFrame(rows[i::4], FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    applied = apply_feed(spark, f"file://{tmp_path}/log", files_per_batch=2, root=f"file://{tmp_path}/out")
    assert applied.select("batch").distinct().count() >= 2
    last = {}
    for r in rows:
        if r[4] is not None and r[3] is not None and r[3].strip().lower() != "header":
            last[r[4]] = max(last.get(r[4], ((-1, -1), "")), ((r[0], r[1]), r[3].strip().lower()))
    want = {(p, *seq) for p, (seq, op) in last.items() if op == "put"}
    assert {tuple(r) for r in live(applied).collect()} == want


def test_feed_again_after_a_stop(spark, tmp_path):
    """The same query started again on its checkpoint repeats nothing and takes up new files."""
    put = (1, 5, 1, "put", "a", "s", 1, 1, None, None, None)
    spark.createDataFrame([put], FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    first = apply_feed(spark, f"file://{tmp_path}/log", root=f"file://{tmp_path}/out")
    assert [tuple(r) for r in live(first).collect()] == [("a", 1, 5)]
    late = [(1, 4, 1, "del", "a", None, None, None, None, None, None), (1, 6, 1, "put", "b", "s", 1, 1, None, None, None), put]
    spark.createDataFrame(late, FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    again = apply_feed(spark, f"file://{tmp_path}/log", root=f"file://{tmp_path}/out")
    assert {tuple(r) for r in live(again).collect()} == {("a", 1, 5), ("b", 1, 6)}
    # Of a key that saw nothing newer the same row is handed on again, which changes nothing.
    assert {tuple(r) for r in again.drop("batch").distinct().collect()} == {("a", 1, 5, "put", "s", 1, 1, None, None), ("b", 1, 6, "put", "s", 1, 1, None, None)}


def test_empty_feed(spark, tmp_path):
    spark.createDataFrame([], FEED).write.parquet(f"{tmp_path}/log")
    assert live(apply_feed(spark, f"file://{tmp_path}/log", root=f"file://{tmp_path}/out")).count() == 0
