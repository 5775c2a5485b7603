"""A folder of notes and its index: create, sync, search, status, rebuild."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from notefold.chunker.chunk import Settings
from notefold.embed import Embedder, HashedWords
from notefold.errors import EmbeddingFails, IndexInsideSource, MassDelete, NotefoldError, NotSynced, SourceEmpty, SourceMissing
from notefold.functions.shown import plural
from notefold.functions.screen import screen_flags
from notefold.operators import plan as p
from notefold.operators.chunking import chunk_notes, embed_passages, explode_passages, spread
from notefold.operators.cosine import held
from notefold.operators.postings import doc_lengths, postings
from notefold.operators.search import search as two_lists
from notefold.operators.status import StatusInput, VerifyInput, not_listed, passage_ids, status_checks, verify_checks
from notefold.session import ship
from notefold.sources.vault import lookup_vault, read_bytes, read_listing, unmatched
from notefold.storage import Scratch
from notefold.store import Change, State, Store

log = logging.getLogger(__name__)

MOST_FAILED, FAILED_SHARE = 20, 0.25
MOST_LISTED = 1_000  # skipped notes by name; the count is of all
QUICK = 20


@dataclass
class SyncResult:
    in_step: bool
    counts: dict[str, int]
    passages: int
    stamp: str
    skipped: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Answer:
    meaning: DataFrame
    exact: DataFrame | None
    notices: list[str]


def _counted(scratch: Scratch, rows: DataFrame, name: str, counts: dict[str, Column], sums: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Rows written to a scratch table, and what was counted of them on the way."""
    seen = Observation()
    made = [F.count_if(c).alias(k) for k, c in counts.items()] + [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (sums or {}).items()]
    return scratch.table(rows.observe(seen, *made), name), seen.get


class Index:
    """``root`` holds the notes and is only read; ``out`` holds the index and is only written here."""

    def __init__(self, spark: SparkSession, root: str, out: str, exclude: list[str] | None = None, embedder: Callable[[], Embedder] = HashedWords, settings: Settings | None = None, editor_filters: bool = True, vault: str | None = None, registry: str | None = None):
        real, target = os.path.realpath(root), os.path.realpath(out.removeprefix("file://"))
        if not os.path.isdir(real):
            raise SourceMissing(root)
        if (target + os.sep).startswith(real + os.sep) or (real + os.sep).startswith(target + os.sep):
            raise IndexInsideSource(out)
        self.spark, self.root, self.exclude, self.make = spark, real, exclude or [], embedder
        self.settings = settings or Settings()
        self.editor_filters, self.vault = editor_filters, vault
        if registry and not vault:  # the editor's list of vaults says under which name links are made
            self.vault = lookup_vault(real, registry)[1]
        self.store = Store(spark, out)
        ship(spark)

    @classmethod
    def create(cls, spark: SparkSession, root: str, out: str, **options) -> Index:
        os.makedirs(out.removeprefix("file://"), exist_ok=True)
        return cls(spark, root, out, **options)

    # -- sync

    def _versions(self) -> dict:
        e = self.make()
        return {"settings": self.settings.fingerprint(), "model": e.name, "dimensions": e.dimensions}

    def listing(self) -> DataFrame:
        return read_listing(self.spark, self.root, self.exclude, self.editor_filters)

    def _first_look(self, state: State, rows: DataFrame, verify: bool) -> DataFrame:
        """Every row of the listing and the manifest with its action by size, date and place; to verify is to trust no date."""
        manifest, left = self.store.read("notes", state).select("path", "sha256", "size", "mtime_ms", "racy", "fip"), self.store.read("left_out", state)
        if verify:
            manifest, left = manifest.withColumn("racy", F.lit(True)), left.withColumn("racy", F.lit(True))
        notes = rows.where("kind = 'note'").select("path", "size", "mtime_ms", "reason", "abs")
        looked = p.classify(notes, manifest, left, shallow=False).withColumn("kind", F.lit("note"))
        return looked.unionByName(rows.where("kind <> 'note'").select("path", "kind"), allowMissingColumns=True)

    def _plan(self, looked: DataFrame, to_read: int, any_unreadable: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """The plan, the notes whose bytes had to be read with their passages, and the notes by action."""
        notes = looked.where("kind = 'note'")
        todo = notes.where(F.col("action").isin("new", "changed")).select("path", "fip", "abs", "size", "mtime_ms")
        chunked = scratch.table(chunk_notes(read_bytes(spread(todo, to_read)), self.settings), "chunked")
        found = chunked.select("path", "sha256", F.col("reason").alias("why"))
        seen = notes.join(found, "path", "left")
        left_out = F.col("why").isin("index-false", "empty")
        seen = seen.withColumn("action", F.when(left_out, F.when(F.col("indexed"), "dropped").otherwise("left-out")).otherwise(F.col("action")))
        seen = seen.withColumn("reason", F.coalesce("reason", F.when(left_out, F.col("why"))))
        plan = p.settled(seen, looked.where("kind = 'unreadable'").select("path") if any_unreadable else None)
        lost = F.coalesce(F.col("why") == "unreadable", F.lit(False))
        plan = plan.withColumn("reason", F.when(lost, "unreadable").otherwise(F.col("reason"))).withColumn("action", F.when(lost, "skipped").otherwise(F.col("action")))
        kinds = {a: F.col("action") == a for a in p.ACTIONS} | {"seen": F.col("on_disk").isNotNull(), "indexed": F.col("indexed").isNotNull()}
        plan, found = _counted(scratch, plan.drop("why", "abs", "kind"), "plan", kinds)
        return plan, chunked, found

    def sync(self, verify: bool = False, allow_mass_delete: bool = False, full: bool = False, now_ms: int | None = None) -> SyncResult:
        """Bring the index in step. Only notes that changed are read, cut, embedded and rewritten."""
        with self.store.lock(), Scratch(self.spark) as scratch:
            result = self._sync(scratch, verify, allow_mass_delete, full, now_ms)
        # Counts only: neither texts nor names.
        log.info("sync: %s, passages %d, in step %s, version %s", result.counts, result.passages, result.in_step, result.stamp)
        return result

    def _sync(self, scratch: Scratch, verify: bool, allow_mass_delete: bool, full: bool, now_ms: int | None) -> SyncResult:
        state = self.store.state()
        made_with = self._versions()
        full = full or bool(state.number) and state.meta.get("made_with") != made_with
        looked = self._first_look(State(state.number, state.counter) if full else state, scratch.table(self.listing(), "listing"), verify)
        looked, first = _counted(scratch, looked, "looked", {a: (F.col("kind") == "note") & (F.col("action") == a) for a in p.FIRST_ACTIONS} | {k: F.col("kind") == k for k in ("other", "unreadable")})
        seen_now = {a: first[a] for a in p.FIRST_ACTIONS if first[a]}
        other = {"other-files": first["other"]}
        if state.number and not full and seen_now and set(seen_now) <= {"unchanged", "left-out", "kept"} and not state.meta.get("skipped"):
            return SyncResult(True, seen_now | {"renamed": 0, "leaving": 0} | other, 0, state.stamp)  # nothing to read, nothing to write
        plan, chunked, found = self._plan(looked, first["new"] + first["changed"], bool(first["unreadable"]), scratch)
        counts, seen, indexed = {a: found[a] for a in p.ACTIONS if found[a]}, found["seen"], found["indexed"]
        if full:
            old = self.store.read("notes", state).select("path")
            indexed = old.count()
            counts["removed"] = old.join(plan.where(F.col("action").isin("added", "skipped")).select("path"), "path", "left_anti").count()
        renamed = p.rename_pairs(plan).count() if counts.get("removed") and counts.get("added") and not full else 0
        totals = p.PlanTotals(seen, indexed, counts.get("removed", 0), counts.get("dropped", 0), renamed)
        if totals.source_empty:
            raise SourceEmpty(self.root)
        if totals.mass_delete and not allow_mass_delete:
            raise MassDelete(f"{totals.leaving} of {indexed} notes would leave the index")

        now = F.lit(now_ms) if now_ms is not None else (F.unix_millis(F.current_timestamp()))
        work = plan.where(F.col("action").isin("added", "updated"))
        passages = explode_passages(chunked.join(work.select("path"), "path", "left_semi"))
        passages = embed_passages(spread(passages, 4 * (first["new"] + first["changed"])).withColumn("flags", screen_flags("text")), self.make)
        passages, did = _counted(scratch, passages, "embedded", {"passages": F.lit(True), "lost": F.col("vector").isNull()}, {"bytes": F.length("embed_text")})
        if did["lost"]:
            lost = passages.groupBy("path").agg(F.count_if(F.col("vector").isNull()).alias("lost"))
            notes = lost.agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("lost") > 0).alias("failed")).first()
            if notes["failed"] > MOST_FAILED or (notes["done"] >= 8 and notes["failed"] >= FAILED_SHARE * notes["done"]):
                raise EmbeddingFails(f"{notes['failed']} of {notes['done']} notes got no vector")
        per_note = passages.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("passages"), F.count_if(F.size("flags") > 0).cast("int").alias("flagged"))
        facts = chunked.select("path", "title", "aliases", "tags")
        meta_now = work.select("path", "sha256", "size", "mtime_ms", p.is_racy(now, F.col("mtime_ms")).alias("racy"), "fip")
        fresh_notes = meta_now.join(facts, "path").join(per_note, "path")
        touched = plan.where("action = 'touched'").select("path", "size", "mtime_ms", p.is_racy(now, F.col("mtime_ms")).alias("racy"))
        if counts.get("touched"):
            kept_facts = self.store.read("notes", state).drop("size", "mtime_ms", "racy")
            fresh_notes = fresh_notes.unionByName(kept_facts.join(touched, "path"))
        gone = self.store.read("notes", state).select("path") if full else plan.where(F.col("action").isin("removed", "dropped")).select("path")
        gone = gone.unionByName(work.select("path")).distinct()
        content = full or any(counts.get(a) for a in ("added", "updated", "removed", "dropped"))
        changes = {"notes": Change(gone.unionByName(touched.select("path")), fresh_notes, True)} if content or counts.get("touched") else {}
        if content or not state.number:
            changes |= {
                "passages": Change(gone, passages, True),
                "vectors": Change(gone, passages.where(F.col("vector").isNotNull()), True),
                "postings": Change(gone, postings(passages).withColumn("tf", F.col("tf").cast("int")), True),
                "lengths": Change(gone, doc_lengths(passages).withColumn("doc_len", F.col("doc_len").cast("int")), True),
            }
        changes["left_out"] = self._left_out(plan, now, state)
        n_skipped = counts.get("skipped", 0)
        skipped = [r["path"] for r in plan.where("action = 'skipped'").select("path").orderBy("path").limit(MOST_LISTED).collect()] if n_skipped else []
        meta = {"made_with": made_with, "skipped": n_skipped, "counts": counts, "renamed": renamed}
        if content or counts.get("touched") or not state.number or meta != state.meta:
            state = self.store.commit(state, changes, meta, content, did["bytes"])
        warnings = [f"{e!r} is set to be left out, but nothing has that name" for e in unmatched(looked, self.root, self.exclude)]
        if n_skipped > len(skipped):
            warnings.append(f"{n_skipped - len(skipped)} more notes were skipped than are listed")
        return SyncResult(not n_skipped, counts | {"renamed": renamed, "leaving": totals.leaving} | other, did["passages"], state.stamp, skipped, warnings)

    def _left_out(self, plan: DataFrame, now, state: State) -> Change:
        """What is left out for its content, by the hash of its name only; what hasn't changed stays where it is."""
        rows = plan.where(F.col("action").isin("left-out", "dropped") & F.col("reason").isin("index-false", "empty"))
        rows = rows.select(p.path_hash("path").alias("note_hash"), "reason", "size", "mtime_ms", p.is_racy(now, F.col("mtime_ms")).alias("racy")).withColumn("path", F.col("note_hash"))
        old = self.store.read("left_out", state)
        same = ["path", "reason", "size", "mtime_ms", "racy"]
        return Change(old.join(rows.select(*same), same, "left_anti").select("path"), rows.join(old.select(*same), same, "left_anti"))

    # -- search

    def search(self, questions: str | list[str], count: int | None = None, exact_words: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """(by meaning, by exact words) for one or several wordings of a question; again if the index is published anew meanwhile."""
        wordings = [q.strip() for q in ([questions] if isinstance(questions, str) else questions) if q.strip()]
        embedder = self.make()
        asked = [(i, v.tolist()) for i, v in enumerate(embedder.embed(wordings))] if wordings else []

        def use(state: State) -> tuple[DataFrame, DataFrame | None]:
            if not state.number or not wordings:
                raise NotSynced(self.root)
            read = lambda t: self.store.read(t, state)
            return two_lists(read("passages"), read("vectors"), read("notes"), read("postings"), read("lengths"), wordings, asked, embedder.dimensions, count, exact_words, self.root, self.vault)

        began = time.perf_counter()
        out = self.store.reading(use)
        log.info("search: %d wordings, %d ms", len(wordings), round((time.perf_counter() - began) * 1000))
        return out

    def look(self) -> dict[str, int]:
        """Notes by what a sync would find, by size, date and place only; ``passages`` that wait are guessed from the index."""
        state = self.store.state()
        notes = self.store.read("notes", state)
        plan = p.shallow_plan(self.listing().where("kind = 'note'").select("path", "size", "mtime_ms", "reason"), notes.select("path", "sha256", "size", "mtime_ms", "racy", "fip"), self.store.read("left_out", state))
        plan = plan.join(notes.select("path", "passages"), "path", "left")
        groups = plan.groupBy("action").agg(F.count(F.lit(1)).alias("notes"), F.sum(F.coalesce("passages", F.lit(1))).alias("passages"), F.count("on_disk").alias("seen"), F.count("indexed").alias("indexed")).collect()
        n = {a: sum(r["notes"] for r in groups if r["action"] == a) for a in ("new", "changed", "removed", "dropped")}
        return n | {"waiting": sum(r["passages"] for r in groups if r["action"] in ("new", "changed")), "seen": sum(r["seen"] for r in groups), "indexed": sum(r["indexed"] for r in groups)}

    def ask(self, questions: str | list[str], count: int | None = None, exact_words: bool = True) -> Answer:
        """A search that first brings a little in step: at most ``QUICK`` passages that wait are indexed before it.

        What can't be brought in step, and why, is said in ``notices``; it never keeps a search from being answered.
        """
        found, notices = self.look(), []
        pending = found["new"] + found["changed"] + found["removed"] + found["dropped"]
        if not self.store.state().number:
            raise NotSynced(self.root)
        if p.would_stop(found["removed"] + found["dropped"], found["new"], found["indexed"], found["seen"]):
            notices.append("many notes are gone from the folder: nothing is brought in step before that is looked at")
        elif pending and found["waiting"] <= QUICK:
            try:
                result = self.sync()
                pending = result.counts.get("skipped", 0)
            except NotefoldError as e:
                notices.append(f"not brought in step: {type(e).__name__}")
        if pending:
            notices.append(f"{plural(pending, 'note')} not in step")
        meaning, exact = self.search(questions, count, exact_words)
        if exact_words and exact is None:
            notices.append("the list by exact words couldn't be made")
        return Answer(meaning, exact, notices)

    # -- status

    def status(self, verify: bool = False) -> DataFrame:
        """The consistency checks, (name, ok)."""
        state = self.store.state()
        with Scratch(self.spark) as scratch:
            return held(self._status(state, verify, scratch))

    def _status(self, state: State, verify: bool, scratch: Scratch) -> DataFrame:
        notes = self.store.read("notes", state)
        if verify:
            looked = scratch.table(self._first_look(state, scratch.table(self.listing(), "listing"), True), "looked")
            plan, chunked, _ = self._plan(looked, looked.where(F.col("action").isin("new", "changed")).count(), True, scratch)
            plan = plan.replace({"added": "new", "updated": "changed", "touched": "unchanged"}, subset=["action"])
        else:
            plan = p.shallow_plan(self.listing().where("kind = 'note'").select("path", "size", "mtime_ms", "reason"), notes.select("path", "sha256", "size", "mtime_ms", "racy", "fip"), self.store.read("left_out", state))
        recorded = notes.select("path", "passages")
        passages, vectors, words, lengths = (self.store.read(t, state) for t in ("passages", "vectors", "postings", "lengths"))
        stamps = {"index": state.built.get("passages"), "vectors": state.built.get("vectors"), "postings": state.built.get("postings")}
        given = StatusInput(
            plan, recorded, vectors, lengths, dead_records=not_listed(recorded, passages, vectors, words, lengths) + len(self.store.unlisted(state)),
            skipped_last_run=state.meta.get("skipped", 0), stamps={k: f"{state.number}:{c}" for k, c in stamps.items()},
            versions_match=state.meta.get("made_with") == self._versions(),
        )
        checks = status_checks(self.spark, given, passage_ids(notes))
        if not verify:
            return checks
        same = plan.where("action = 'unchanged'").select("path")
        fresh = explode_passages(chunked.join(same, "path", "left_semi"))
        return checks.unionByName(verify_checks(self.spark, VerifyInput(recorded, passages, vectors, words, lengths, fresh, self.make)))

    def rebuild(self, full: bool = False) -> SyncResult | State:
        """Make the derived tables again from the passages kept, or everything from the notes."""
        if full:
            return self.sync(full=True, allow_mass_delete=True)
        with self.store.lock():
            state = self.store.state()
            passages = self.store.read("passages", state)
            every = passages.select("path").distinct()
            # What is made again is never read: it may be damaged.
            state = replace(state, tables=state.tables | {"postings": {}, "lengths": {}}, sizes=state.sizes | {"postings": {}, "lengths": {}})
            changes = {
                "postings": Change(every, postings(passages).withColumn("tf", F.col("tf").cast("int"))),
                "lengths": Change(every, doc_lengths(passages).withColumn("doc_len", F.col("doc_len").cast("int"))),
            }
            return self.store.commit(state, changes, state.meta, False)
