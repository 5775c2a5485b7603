"""The index's tables, in buckets of the note's path, with versions published by one rename.

A version lists for each table which folder holds which bucket. A commit rewrites only the buckets
of notes that changed and goes on listing the others' folders. A table's buckets are about
``BUCKET_BYTES`` large: their number doubles as the table grows (then the table is written anew, so
each row is rewritten a bounded number of times on average), so a change of one note costs the
writing of one bucket of each table, however large the index is. Text that left the index must be
gone from the disk after the commit; that is why a change rewrites its bucket instead of being
written beside it.

Folders that no version needs any more are deleted after the commit. A reader that was listing them
finds them gone and reads again from the version that is current then (``reading``).

Within a bucket rows lie by path, postings by token: a search for some words reads the pages that
hold them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.errors import Busy, NewerIndex
from notefold.storage import _Files

SCHEMA_VERSION = 1
BUCKET_BYTES = 64 * 1024 * 1024
LEAST_BUCKETS = 8
STALE_MS = 6 * 3_600_000  # a lock that nobody gave back
TABLES = {
    "notes": "path STRING, sha256 STRING, size LONG, mtime_ms LONG, racy BOOLEAN, fip BOOLEAN, title STRING, aliases ARRAY<STRING>, tags ARRAY<STRING>, passages INT, flagged INT",
    "passages": "path STRING, n INT, title STRING, trail ARRAY<STRING>, heads ARRAY<STRING>, rep BOOLEAN, line INT, text STRING, recovered BOOLEAN, flags ARRAY<STRING>",
    "vectors": "path STRING, n INT, vector ARRAY<FLOAT>",
    "postings": "path STRING, n INT, token STRING, tf INT",
    "lengths": "path STRING, n INT, doc_len INT",
    "left_out": "path STRING, note_hash STRING, reason STRING, size LONG, mtime_ms LONG, racy BOOLEAN",
}
ORDER = {"notes": ["path"], "postings": ["token", "path", "n"], "left_out": ["path"]}


@dataclass
class State:
    number: int = 0
    counter: int = 0  # rises only when passages change
    tables: dict[str, dict[str, str]] = field(default_factory=lambda: {t: {} for t in TABLES})
    meta: dict = field(default_factory=dict)
    built: dict[str, int] = field(default_factory=dict)  # for each table the counter of the passages it was last written for
    buckets: dict[str, int] = field(default_factory=lambda: dict.fromkeys(TABLES, LEAST_BUCKETS))
    sizes: dict[str, dict[str, int]] = field(default_factory=lambda: {t: {} for t in TABLES})  # bytes of each bucket

    @property
    def stamp(self) -> str:
        return f"{self.number}:{self.counter}"


@dataclass
class Change:
    """What becomes of a table: rows of these paths go, these rows come."""

    gone: DataFrame  # (path)
    fresh: DataFrame
    covered: bool = False  # every path of ``fresh`` is in ``gone`` as well

    @property
    def paths(self) -> DataFrame:
        gone = self.gone.select("path")
        return gone if self.covered else gone.union(self.fresh.select("path"))


class Store:
    def __init__(self, spark: SparkSession, root: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.bucket_bytes = spark, root.rstrip("/"), bucket_bytes
        self.files = _Files(spark, self.root)

    def state(self) -> State:
        names = [n for n in self.files.names(f"{self.root}/_versions") if n.endswith(".json")]
        if not names:
            return State()
        try:
            d = json.loads(self.files.read(f"{self.root}/_versions/{names[-1]}"))
        except Exception as e:
            if not _is_gone(e):
                raise
            return self.state()  # a newer one was published meanwhile
        if d["schema"] > SCHEMA_VERSION:
            raise NewerIndex(f"the index has version {d['schema']}")
        fresh = State()
        return State(d["number"], d["counter"], d["tables"], d["meta"], d.get("built", dict.fromkeys(TABLES, d["counter"])), d.get("buckets", fresh.buckets), d.get("sizes", fresh.sizes))

    def read(self, table: str, state: State | None = None, buckets: set[str] | None = None) -> DataFrame:
        held = (state or self.state()).tables[table]
        folders = [f"{self.root}/{f}" for b, f in held.items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*folders)

    def reading(self, use: Callable[[State], object], tries: int = 3):
        """``use`` of the current state, again from the next one if that was published meanwhile."""
        for left in range(tries - 1, -1, -1):
            state = self.state()
            try:
                return use(state)
            except Exception as e:
                if not left or not _is_gone(e) or self.state().number == state.number:
                    raise

    # -- writing

    @contextmanager
    def lock(self, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)) -> Iterator[str]:
        """One writer at a time, refused at the start of its work. A lock older than ``STALE_MS`` is taken over."""
        file, mine = f"{self.root}/_lock", uuid.uuid4().hex
        for _ in range(2):
            try:
                self.files.write_new(file, json.dumps({"token": mine, "since_ms": now_ms()}))
                break
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
            held = self._lock_held()
            if held is None or now_ms() - held["since_ms"] > STALE_MS:
                self.files.delete(file)
            else:
                raise Busy("another run is at work on this index")
        else:
            raise Busy("another run took the index")
        self._token = mine
        try:
            yield mine
        finally:
            self._token = None
            if (held := self._lock_held()) is not None and held["token"] == mine:
                self.files.delete(file)

    _token: str | None = None

    def _lock_held(self) -> dict | None:
        try:
            return json.loads(self.files.read(f"{self.root}/_lock"))
        except Exception:
            return None

    def _still_ours(self) -> None:
        """The fence: a run whose lock was taken over publishes nothing."""
        if self._token is not None and ((held := self._lock_held()) is None or held["token"] != self._token):
            raise Busy("the lock was taken over by another run")

    def commit(self, base: State, changes: dict[str, Change], meta: dict, content_changed: bool, added_bytes: int = 0) -> State:
        """Write the changed buckets and publish; of two commits from one base the second fails.

        ``added_bytes`` is about how much text comes, so that a first commit has as many buckets as it needs.
        """
        new = State(base.number + 1, base.counter + int(content_changed), {t: dict(b) for t, b in base.tables.items()}, meta)
        new.buckets, new.sizes = dict(base.buckets), {t: dict(b) for t, b in base.sizes.items()}
        for t in changes:
            expected = sum(base.sizes[t].values()) + added_bytes
            while new.buckets[t] * self.bucket_bytes < expected:
                new.buckets[t] *= 2
        name = f"data-{new.number:06d}-{uuid.uuid4().hex[:8]}"
        touched = self._touched(base, new, changes)
        with ThreadPoolExecutor(max(1, len(touched))) as pool:
            written = dict(zip(touched, pool.map(lambda t: self._write(name, t, base, new, changes[t], touched[t]), touched)))
        for table, sizes in written.items():
            again = new.buckets[table] != base.buckets[table]
            for held in (new.tables[table], new.sizes[table]):
                for b in list(held) if again else touched[table]:
                    held.pop(b, None)
            new.tables[table] |= {b: f"{name}/{table}/bucket={b}" for b in sizes}
            new.sizes[table] |= sizes
        new.built = base.built | dict.fromkeys(changes, new.counter)
        text = json.dumps({"schema": SCHEMA_VERSION, "number": new.number, "counter": new.counter, "tables": new.tables, "meta": meta, "built": new.built, "buckets": new.buckets, "sizes": new.sizes})
        try:
            self._still_ours()
            self.files.write_new(f"{self.root}/_versions/{new.number:010d}.json", text)
        except Exception as e:
            self.files.delete(f"{self.root}/{name}")
            if "FileAlreadyExists" in str(e):
                raise Busy("another run published first") from e
            raise
        self.tidy(new)
        return new

    def _touched(self, base: State, new: State, changes: dict[str, Change]) -> dict[str, list[str]]:
        """The buckets of each table that a change writes, all tables in one job; tables that nothing touches are left out."""
        # Numbers of buckets are the least one times a power of two, so one hash tells the bucket among any of them.
        most = max((new.buckets[t] for t in changes), default=1)
        sets = {id(c.gone) if c.covered else id(c): c.paths for c in changes.values()}
        every = None
        for i, paths in enumerate(sets.values()):
            some = paths.select(F.lit(i).alias("set"), _bucket(most).alias("bucket"))
            every = some if every is None else every.union(some)
        if every is None:
            return {}
        found: dict[int, set[int]] = {}
        for r in every.distinct().collect():  # at most as many as there are buckets
            found.setdefault(r["set"], set()).add(r["bucket"])
        place = {k: i for i, k in enumerate(sets)}
        out = {t: {str(b % new.buckets[t]) for b in found.get(place[id(c.gone) if c.covered else id(c)], ())} for t, c in changes.items()}
        return {t: sorted(b) for t, b in out.items() if b}

    def _write(self, name: str, table: str, base: State, new: State, change: Change, touched: list[str]) -> dict[str, int]:
        """The buckets written and their bytes."""
        again = new.buckets[table] != base.buckets[table]  # every row may have another bucket now
        paths = change.paths.distinct()
        cols = [c.strip().split(" ")[0] for c in TABLES[table].split(", ")]
        rows = change.fresh.select(*cols)
        if base.tables[table]:
            kept = self.read(table, base, None if again else set(touched)).join(paths, "path", "left_anti")
            rows = kept.select(*cols).unionByName(rows)
        bucket = _bucket(new.buckets[table])
        tasks = new.buckets[table] if again or not base.tables[table] else len(touched)
        rows = rows.withColumn("bucket", bucket).repartition(max(1, tasks), "bucket")
        rows.sortWithinPartitions("bucket", *ORDER.get(table, ["path", "n"])).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{table}")
        return self.files.sizes(f"{self.root}/{name}/{table}", "bucket=")

    def tidy(self, state: State) -> None:
        """Delete versions before this one and every bucket folder that it doesn't list."""
        live = {f for held in state.tables.values() for f in held.values()}
        for n in self.files.names(f"{self.root}/_versions"):
            if n < f"{state.number:010d}.json":
                self.files.delete(f"{self.root}/_versions/{n}")
        for data in [n for n in self.files.names(self.root) if n.startswith("data-")]:
            if not any(f.startswith(data + "/") for f in live):
                self.files.delete(f"{self.root}/{data}")
                continue
            for table in self.files.names(f"{self.root}/{data}"):
                for b in self.files.names(f"{self.root}/{data}/{table}"):
                    if b.startswith("bucket=") and f"{data}/{table}/{b}" not in live:
                        self.files.delete(f"{self.root}/{data}/{table}/{b}")

    def unlisted(self, state: State) -> list[str]:
        """Bucket folders on the disk that a version doesn't list: text that should have gone."""
        live = {f for held in state.tables.values() for f in held.values()}
        found = []
        for data in [n for n in self.files.names(self.root) if n.startswith("data-")]:
            for table in self.files.names(f"{self.root}/{data}"):
                found += [f"{data}/{table}/{b}" for b in self.files.names(f"{self.root}/{data}/{table}") if b.startswith("bucket=")]
        return [f for f in found if f not in live]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")


def _is_gone(e: Exception) -> bool:
    text = str(e)
    return any(s in text for s in ("FileNotFoundException", "PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST", "does not exist"))
