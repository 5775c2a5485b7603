"""A folder of notes as a Spark source: its listing as rows, its bytes read on the executors.

Spark's own file sources hide names that begin with ``_`` and follow links, so the folder is walked
here: each top folder is a partition, and bytes are read only for the notes that are asked for.
"""

from __future__ import annotations

import json
import os
import re
import threading
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path STRING, raw STRING, abs STRING, size LONG, mtime_ms LONG, kind STRING, reason STRING"
READ_TIMEOUT_S = 10.0
_STUB = re.compile(r"^\.(.+\.md)\.icloud$", re.I)


def key_of(rel: str) -> str:
    return unicodedata.normalize("NFC", rel.replace(os.sep, "/")).replace("\u00a0", " ")


def exclude_key(root: str, entry: str) -> str:
    """An exclude entry as a key; empty if it names nothing inside the folder."""
    if not entry:
        return ""
    if os.path.isabs(entry):
        inside = os.path.relpath(entry, root)
        entry = inside if inside != ".." and not inside.startswith(".." + os.sep) else entry
    key = key_of(os.path.normpath(entry)).strip("/")
    return "" if key in (".", "..") or key.startswith("../") else key


@dataclass
class Excludes:
    """What is left out by place: entries of our own and the filters that the notes' editor keeps."""

    entries: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    warning: str | None = None

    @classmethod
    def of(cls, root: str, exclude: list[str], editor_filters: bool) -> Excludes:
        out = cls([k.lower() for k in (exclude_key(root, e) for e in exclude) if k])
        file = os.path.join(root, ".obsidian", "app.json")
        if not editor_filters or not os.path.exists(file):
            return out
        try:
            with open(file, encoding="utf-8") as f:
                filters = json.load(f).get("userIgnoreFilters") or []
        except (OSError, ValueError, AttributeError):
            out.warning = "the editor's settings can't be read, its filters are skipped"
            return out
        for f in filters if isinstance(filters, list) else []:
            if not isinstance(f, str) or not f:
                continue
            if len(f) > 1 and f[0] == f[-1] == "/":
                try:
                    re.compile(f[1:-1])
                    out.patterns.append(f[1:-1])
                except re.error:
                    out.warning = "one of the editor's filters can't be read and is skipped"
            else:
                out.prefixes.append(f.lower())
        return out

    def ours(self, key: str) -> bool:
        k = key.lower()
        return any(k == e or k.startswith(e + "/") for e in self.entries)

    def editors(self, key: str) -> bool:
        return any(re.search(p, key, re.I) for p in self.patterns) or key.lower().startswith(tuple(self.prefixes)) if self.patterns or self.prefixes else False


def _row(root: str, rel: str, reason: str | None, kind: str = "note", stat: os.stat_result | None = None) -> tuple:
    return (key_of(rel), rel.replace(os.sep, "/"), os.path.join(root, rel), stat.st_size if stat else 0, stat.st_mtime_ns // 1_000_000 if stat else 0, kind, reason)


def walk(root: str, rel: str, ex: Excludes, forced: str | None = None, deep: bool = True) -> Iterator[tuple]:
    """Rows of a folder and, if ``deep``, of all below; kinds are note, other, folder (not walked) and unreadable."""
    try:
        entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
    except OSError:
        yield _row(root, rel or ".", "unreadable", "unreadable")
        return
    for e in entries:
        at = os.path.join(rel, e.name) if rel else e.name
        if m := _STUB.match(e.name):
            yield _row(root, os.path.join(rel, m[1]) if rel else m[1], "not-downloaded")
        elif e.name.startswith("."):
            continue
        elif e.is_symlink():
            note = e.name.lower().endswith(".md")
            yield _row(root, at, "symlink" if note else None, "note" if note else "other")
        elif e.is_dir(follow_symlinks=False):
            why = forced or ("nested-vault" if os.path.isdir(os.path.join(root, at, ".obsidian")) else "excluded" if ex.ours(key_of(at)) else None)
            if deep:
                yield from walk(root, at, ex, why)
            else:
                yield _row(root, at, why, "folder")
        elif e.is_file(follow_symlinks=False):
            if not e.name.lower().endswith(".md"):
                yield _row(root, at, None, "other")
                continue
            key = key_of(at)
            try:
                stat = e.stat(follow_symlinks=False)
            except OSError:
                continue  # it went away
            yield _row(root, at, forced or ("excluded" if ex.ours(key) else "obsidian-excluded" if ex.editors(key) else None), "note", stat)


class _Folder(InputPartition):
    """A folder to list, with all below it if ``deep``; ``reason`` holds for everything in it."""

    def __init__(self, rel: str, reason: str | None, deep: bool):
        self.rel, self.reason, self.deep = rel, reason, deep


class VaultReader(DataSourceReader):
    PARTITIONS = 16

    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.exclude = json.loads(options.get("exclude", "[]"))
        self.filters = options.get("editorFilters", "true").lower() != "false"

    def _excludes(self) -> Excludes:
        return Excludes.of(self.root, self.exclude, self.filters)

    def partitions(self) -> list[InputPartition]:
        """Folders from the top down until there are enough to share out; the rest is listed below them."""
        ex, alone, waiting = self._excludes(), [], [("", None)]
        while waiting and len(waiting) + len(alone) < self.PARTITIONS:
            rel, reason = waiting.pop(0)
            alone.append(_Folder(rel, reason, False))
            waiting += [(r[1], r[6]) for r in walk(self.root, rel, ex, reason, deep=False) if r[5] == "folder"]
        return alone + [_Folder(rel, reason, True) for rel, reason in waiting]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        rows = walk(self.root, partition.rel, self._excludes(), partition.reason, partition.deep)
        return (r for r in rows if r[5] != "folder")


class VaultSource(DataSource):
    """``spark.read.format("vault").load(folder)``, options ``exclude`` (a JSON list) and ``editorFilters``."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(self.options)


def read_listing(spark: SparkSession, root: str, exclude: list[str] | None = None, editor_filters: bool = True) -> DataFrame:
    """The folder's rows; of files with one key the first by name is the note."""
    from notefold.operators.plan import without_duplicates

    spark.dataSource.register(VaultSource)
    rows = spark.read.format("vault").option("exclude", json.dumps(exclude or [])).option("editorFilters", str(editor_filters).lower()).load(root)
    notes = without_duplicates(rows.where("kind = 'note'"))
    return notes.unionByName(rows.where("kind <> 'note'"))


def left_out_counts(listing: DataFrame) -> DataFrame:
    """(reason, notes): how many notes are left out and why."""
    return listing.where((F.col("kind") == "note") & F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("notes"))


def unmatched(listing: DataFrame, root: str, exclude: list[str]) -> list[str]:
    """The exclude entries that hold no folder or note; names that begin with a dot are never missed."""
    from notefold.operators.plan import under

    keys = {raw: exclude_key(root, raw) for raw in exclude}
    asked = {raw: k for raw, k in keys.items() if not any(part.startswith(".") for part in k.split("/"))}
    if not asked:
        return []
    hits = listing.agg(*[F.max(under(F.col("path"), F.lit(k))).alias(f"e{i}") for i, k in enumerate(asked.values())]).first()
    return [raw for i, raw in enumerate(asked) if not hits[f"e{i}"]]


def read_bytes(notes: DataFrame, timeout_s: float = READ_TIMEOUT_S) -> DataFrame:
    """With ``content`` of the files named in ``abs``; null for a file that can't be read, stalls or changed meanwhile."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [within(lambda at=p: _steady(at), timeout_s) for p in b.column("abs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(content, pa.binary())], names=[*b.schema.names, "content"])

    return notes.mapInArrow(run, f"{fields}, content BINARY")


def within(read: Callable[[], bytes | None], timeout_s: float) -> bytes | None:
    """What a read gives, or None if it takes too long; the thread of a stalled read is left behind."""
    out: list[bytes | None] = []
    t = threading.Thread(target=lambda: out.append(read()), daemon=True)
    t.start()
    t.join(timeout_s)
    return out[0] if out else None


def _steady(path: str) -> bytes | None:
    """A file's bytes if size and date are the same before and after, tried twice."""
    for _ in range(2):
        try:
            before = os.stat(path)
            with open(path, "rb") as f:
                data = f.read()
            after = os.stat(path)
        except OSError:
            return None
        if (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns):
            return data
    return None


def lookup_vault(root: str, registry: str) -> tuple[str, str | None]:
    """(state, link name) of a folder in the editor's list of vaults, a JSON file.

    The state is ``registered``, ``not-registered`` or ``no-list``. A vault is linked by its name,
    by its id where another vault has the same name.
    """
    name = os.path.basename(os.path.realpath(root))
    try:
        with open(registry, encoding="utf-8") as f:
            vaults = {i: str((v or {}).get("path") or "") for i, v in json.load(f)["vaults"].items()}
    except (OSError, ValueError, KeyError, AttributeError, TypeError):
        return "no-list", name
    mine = next((i for i, p in vaults.items() if p and os.path.realpath(p) == os.path.realpath(root)), None)
    if mine is None:
        return "not-registered", None
    same = sum(os.path.basename(p.rstrip("/")).lower() == name.lower() for p in vaults.values())
    return "registered", mine if same > 1 else name
