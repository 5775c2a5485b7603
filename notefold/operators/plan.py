"""What a sync has to do: a listing of notes against the manifest of what is indexed.

Everything is decided by joins on the note key and by columns; bytes are read only for notes whose
size, date or place differ. Each note gets one action:

``unchanged``, ``touched`` (same bytes, new date), ``added``, ``updated``, ``removed``, ``dropped``
(indexed, now left out), ``kept`` (indexed, can't be read just now), ``left-out``, ``skipped``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.operators.numbering import numbered

RACY_MS = 2_000
MASS_COUNT, MASS_SHARE = 10, 0.2
FIRST_ACTIONS = ("unchanged", "new", "changed", "removed", "dropped", "kept", "left-out")
ACTIONS = ("unchanged", "touched", "added", "updated", "removed", "dropped", "kept", "left-out", "skipped")


def base_name(key: Column | str = "path") -> Column:
    return F.lower(F.substring_index(key, "/", -1))


def folder_flags(listing: DataFrame) -> DataFrame:
    """(path, fip): whether another note has the same file name, letter case ignored.

    By a count and a join rather than a window, so one very common name isn't one task.
    """
    names = listing.select(base_name().alias("_base")).groupBy("_base").agg((F.count(F.lit(1)) > 1).alias("fip"))
    return listing.withColumn("_base", base_name()).join(names, "_base").drop("_base")


def is_racy(now_ms: Column, mtime_ms: Column) -> Column:
    return F.abs(now_ms - mtime_ms) < RACY_MS


def path_hash(key: Column | str) -> Column:
    """16 hex digits that stand for the name of a left-out note: its name is never stored."""
    return F.substring(F.sha2(key, 256), 1, 16)


def under(key: Column, entry: Column) -> Column:
    """Whether a key is an exclude entry or below it, letter case ignored; an empty entry holds nothing."""
    k, e = F.lower(key), F.lower(entry)
    return (e != "") & ((k == e) | F.startswith(k, F.concat(e, F.lit("/"))))


def without_duplicates(listing: DataFrame) -> DataFrame:
    """Of files with one key the first by raw name is the note; ``reason`` of the others is ``duplicate-path``."""
    w = Window.partitionBy("path").orderBy("raw")
    return listing.withColumn("reason", F.when(F.row_number().over(w) > 1, F.coalesce("reason", F.lit("duplicate-path"))).otherwise(F.col("reason")))


def shallow_plan(listing: DataFrame, manifest: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """(path, action, ...) by size, date and place only: what may have changed is ``pending``.

    ``listing``: (path, size, mtime_ms, reason) with reason null for a note that belongs in the
    index. ``manifest``: (path, sha256, size, mtime_ms, racy, fip). ``left_out``: (note_hash,
    reason, size, mtime_ms, racy) of the last run.
    """
    return classify(listing, manifest, left_out, shallow=True)


def classify(listing: DataFrame, manifest: DataFrame, left_out: DataFrame | None, shallow: bool) -> DataFrame:
    """The rows of both sides with ``action``; by size, date and place, before any bytes are read."""
    notes = folder_flags(listing.where(F.col("reason").isNull())).unionByName(listing.where(F.col("reason").isNotNull()).withColumn("fip", F.lit(None).cast("boolean")))
    # A key that wins in the index isn't also left out: a duplicate file's key is the winner's.
    w = F.min_by(F.struct(*[c for c in notes.columns if c != "path"]), F.coalesce("reason", F.lit("")))
    notes = notes.groupBy("path").agg(w.alias("f")).select("path", "f.*")
    old = manifest.select("path", *[F.col(c).alias(f"old_{c}") for c in ("sha256", "size", "mtime_ms", "racy", "fip")], F.lit(True).alias("indexed"))
    both = notes.withColumn("on_disk", F.lit(True)).join(old, "path", "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime_ms")) & (F.col("fip") == F.col("old_fip"))
    if not shallow:
        same = same & ~F.coalesce("old_racy", F.lit(False))
    if left_out is not None:
        lo = left_out.select("note_hash", *[F.col(c).alias(f"lo_{c}") for c in ("reason", "size", "mtime_ms", "racy")])
        both = both.withColumn("note_hash", path_hash("path")).join(lo, "note_hash", "left").drop("note_hash")
        still = F.col("indexed").isNull() & F.col("lo_reason").isNotNull() & (F.col("lo_size") == F.col("size")) & (F.col("lo_mtime_ms") == F.col("mtime_ms"))
        if not shallow:
            still = still & ~F.coalesce("lo_racy", F.lit(False))
        both = both.withColumn("reason", F.coalesce("reason", F.when(still, F.col("lo_reason"))))
    gone = F.col("on_disk").isNull()
    action = (
        F.when(gone, "removed")
        .when(F.col("reason") == "not-downloaded", F.when(F.col("indexed"), "kept").otherwise("left-out"))
        .when(F.col("reason").isNotNull(), F.when(F.col("indexed"), "dropped").otherwise("left-out"))
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .when(F.col("indexed"), "changed")
        .otherwise("new")
    )
    return both.withColumn("action", action)


def full_plan(listing: DataFrame, manifest: DataFrame, left_out: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """The plan where every note's fingerprint is known (``sha256`` in the listing)."""
    return settled(classify(listing, manifest, left_out, shallow=False), unreadable)


def settled(rows: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Classified rows, once the bytes of new and changed notes are known (``sha256``), with their last action.

    A note below a folder that couldn't be listed (``unreadable``: path, ``.`` for the top) is never
    removed: it is ``skipped``.
    """
    same_bytes = (F.col("sha256") == F.col("old_sha256")) & (F.col("fip") == F.col("old_fip"))
    same_date = (F.col("size") == F.col("old_size")) & (F.col("mtime_ms") == F.col("old_mtime_ms"))
    action = F.when(F.col("action") == "changed", F.when(same_bytes, F.when(same_date, "unchanged").otherwise("touched")).otherwise("updated")).when(F.col("action") == "new", "added").otherwise(F.col("action"))
    rows = rows.withColumn("action", action)
    if unreadable is None:
        return rows
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit(".")), F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    hidden = rows.where("action = 'removed'").select("path", F.explode(above).alias("folder")).join(unreadable.select(F.col("path").alias("folder")), "folder", "left_semi").select("path").distinct()
    rows = rows.join(hidden.withColumn("_hidden", F.lit(True)), "path", "left")
    out = rows.withColumn("reason", F.when(F.col("_hidden"), "unreadable").otherwise(F.col("reason"))).withColumn("action", F.when(F.col("_hidden"), "skipped").otherwise(F.col("action")))
    return out.drop("_hidden")


def rename_pairs(plan: DataFrame) -> DataFrame:
    """(from_path, to_path): a new path with a vanished path's content, paired one to one in the order of the paths.

    Many copies of one content make a group, but only removed and added notes are in it.
    """
    w = Window.partitionBy("sha256").orderBy("path")
    gone = plan.where("action = 'removed'").select(F.col("old_sha256").alias("sha256"), "path").withColumn("k", F.row_number().over(w)).withColumnRenamed("path", "from_path")
    come = plan.where("action = 'added'").select("sha256", "path").withColumn("k", F.row_number().over(w)).withColumnRenamed("path", "to_path")
    return gone.join(come, ["sha256", "k"]).select("from_path", "to_path")


def plan_counts(plan: DataFrame) -> DataFrame:
    """(action, notes)."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("notes"))


@dataclass(frozen=True)
class PlanTotals:
    seen: int
    indexed: int
    removed: int
    dropped: int
    renamed: int

    @property
    def leaving(self) -> int:
        return self.removed - self.renamed + self.dropped

    @property
    def source_empty(self) -> bool:
        return self.indexed > 0 and self.seen == 0

    @property
    def mass_delete(self) -> bool:
        return self.leaving > MASS_COUNT and self.leaving > self.indexed * MASS_SHARE


def would_stop(removed: int, new: int, indexed: int, seen: int) -> bool:
    """Whether a sync would stop, told by a shallow plan: a new note may account for a removed one."""
    return PlanTotals(seen, indexed, max(0, removed - new), 0, 0).mass_delete or (indexed > 0 and seen == 0)


def embed_order(plan: DataFrame, large: int = 64) -> DataFrame:
    """With ``place`` from 1 in the order of work: notes of many passages last, the latest first, then by path."""
    placed = numbered(plan, (F.col("passages") > large).asc(), F.desc("mtime_ms"), F.asc("path"), name="place")
    return placed.withColumn("place", F.col("place") + 1)


def saved_counts(plan: DataFrame, committed: DataFrame) -> DataFrame:
    """(action, planned, saved): how much of a broken run's plan the index holds with the planned bytes."""
    work = plan.where(F.col("action").isin("added", "updated")).select("path", "sha256", "action")
    held = committed.select("path", "sha256").withColumn("held", F.lit(1))
    both = work.join(held, ["path", "sha256"], "left")
    return both.groupBy("action").agg(F.count(F.lit(1)).alias("planned"), F.count("held").alias("saved"))
