from __future__ import annotations

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from notefold.errors import Busy, EmbeddingFails, IndexInsideSource, MassDelete, NewerIndex, NotSynced, SourceEmpty, SourceMissing
from notefold.index import Index
from notefold.operators.chunking import chunk_notes, explode_passages, register_sql
from notefold.operators.plan import PlanTotals, would_stop
from notefold.sources.log import live_records, read_log, read_questions, write_log
from notefold.sources.vault import exclude_key, lookup_vault, read_listing, unmatched
from notefold.store import Store
from notefold.streaming.syncs import stream_log


def write(root, **files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture
def vault(tmp_path):
    root = str(tmp_path / "notes")
    write(
        root,
        **{
            "Garden/Tomatoes.md": "# Tomatoes\n\nPlant the tomatoes after the last frost.\n\n## Water\n\nWater them deeply and rarely.\n", "Garden/README.md": "# About\n\nThis folder is about growing things.\n",
            "Kitchen/README.md": "# About\n\nThis folder is about cooking things.\n", "Kitchen/Soup.MD": "Simmer the bones for six hours slowly.\n", "_underscore/_x.md": "These words must be found too.\n",
            "Off.md": "---\nindex: false\n---\nnever shown words here\n", "Empty.md": "", "Private/Diary.md": "secret diary words here\n", ".hidden/x.md": "hidden words here now\n", "pic.png": "x",
            "Hidden by editor/Old.md": "old words kept away\n", ".obsidian/app.json": json.dumps({"userIgnoreFilters": ["Hidden by editor/", "/^Secret.*/"]}), "Secret stuff.md": "also kept away words\n",
            "Inner/.obsidian/app.json": "{}", "Inner/Note.md": "a vault of its own\n", ".Cloud.md.icloud": "",
        },
    )
    os.symlink(os.path.join(root, "Empty.md"), os.path.join(root, "Link.md"))
    return root


def test_listing(spark, vault):
    rows = {r["path"]: r for r in read_listing(spark, vault, ["private"]).collect()}
    notes = {p: r["reason"] for p, r in rows.items() if r["kind"] == "note"}
    assert notes == {
        "Garden/Tomatoes.md": None, "Garden/README.md": None, "Kitchen/README.md": None, "Kitchen/Soup.MD": None, "_underscore/_x.md": None, "Off.md": None, "Empty.md": None, "Private/Diary.md": "excluded",
        "Hidden by editor/Old.md": "obsidian-excluded", "Secret stuff.md": "obsidian-excluded", "Inner/Note.md": "nested-vault", "Cloud.md": "not-downloaded", "Link.md": "symlink",
    }
    assert rows["pic.png"]["kind"] == "other"
    listing = read_listing(spark, vault, ["private"])
    assert unmatched(listing, vault, ["private", "Nowhere", ".git"]) == ["Nowhere"] and unmatched(listing, vault, []) == []
    assert exclude_key("/a/b", "/a/b/C/") == "C" and exclude_key("/a/b", "../x") == "" and exclude_key("/a/b", "./x/") == "x"


def test_listing_is_the_same_however_it_is_shared_out(vault):
    from notefold.sources.vault import VaultReader

    def rows(n):
        r = VaultReader({"path": vault, "exclude": '["private"]'})
        r.PARTITIONS = n
        return sorted((x for p in r.partitions() for x in r.read(p)), key=str)

    assert rows(1) == rows(3) == rows(100) and len(rows(1)) > 10


def test_life_of_an_index(spark, vault, tmp_path):
    out = str(tmp_path / "index")
    index = Index.create(spark, vault, out, exclude=["private"], vault="Notes")
    with pytest.raises(NotSynced):
        index.search("x")
    first = index.sync()
    assert first.counts["added"] == 5 and first.counts["left-out"] == 8 and first.in_step
    again = index.sync()
    assert again.counts["unchanged"] == 5 and again.passages == 0 and again.stamp.split(":")[1] == first.stamp.split(":")[1]

    # An edit, a rename, a removal, a new date only.
    write(vault, **{"Garden/Tomatoes.md": "# Tomatoes\n\nA heliotrope grows beside them now.\n"})
    os.rename(f"{vault}/Kitchen/Soup.MD", f"{vault}/Kitchen/Stock.md")
    os.remove(f"{vault}/_underscore/_x.md")
    os.utime(f"{vault}/Garden/README.md", (1, 1))
    third = index.sync(now_ms=10**13)
    assert {k: third.counts.get(k) for k in ("updated", "added", "removed", "renamed", "touched")} == {"updated": 1, "added": 1, "removed": 2, "renamed": 1, "touched": 1}
    assert all(r["ok"] for r in index.status(verify=True).collect())
    assert not subprocess.run(["grep", "-rlE", "found too|deeply and rarely", out], capture_output=True).stdout  # no old text

    meaning, exact = index.search(["where does the heliotrope grow", "simmer bones"])
    assert meaning.where("rank = 1").first()["path"] in ("Garden/Tomatoes.md", "Kitchen/Stock.md")
    shown = {r["path"] for r in meaning.collect()} | {r["path"] for r in exact.collect()}
    assert {"Garden/Tomatoes.md", "Kitchen/Stock.md"} <= shown

    # From scratch it comes out the same.
    fresh = Index.create(spark, vault, str(tmp_path / "other"), exclude=["private"], vault="Notes")
    fresh.sync(now_ms=10**13)
    for table in ("notes", "passages", "vectors", "postings", "lengths"):
        a, b = index.store.read(table), fresh.store.read(table)
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count(), table
    index.rebuild()
    assert index.sync(full=True).counts["added"] == 4
    assert all(r["ok"] for r in index.status().collect())

    # A second note of the same name makes the first one's prefix change.
    write(vault, **{"Attic/Tomatoes.md": "Some other tomatoes words.\n"})
    assert index.sync().counts["updated"] == 1


def test_status_sees_what_counts_do_not_show(spark, tmp_path):
    from pyspark.sql import functions as F

    from notefold.store import Change

    root, out = str(tmp_path / "n"), str(tmp_path / "i")
    write(root, **{"A.md": "apples ripen slowly in autumn\n", "B.md": "boats drift gently in harbours\n"})
    index = Index.create(spark, root, out)
    index.sync()
    store, good = index.store, index.store.state()

    def failing(table, rows, verify=True, content=False):
        base = store.state()
        gone = store.read(table, base).select("path").distinct()
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        kept = spark.createDataFrame(store.read(table, base).collect(), store.read(table, base).schema)
        store.commit(base, {table: Change(gone, rows)}, good.meta, content)
        bad = {r["name"] for r in index.status(verify).collect() if not r["ok"]}
        store.commit(store.state(), {t: Change(store.read(t).select("path").distinct().union(rows.select("path")), kept if t == table else store.read(t)) for t in store.state().tables}, good.meta, False)
        return bad

    assert len({r["name"] for r in index.status(True).collect() if r["ok"]}) == 13
    other = F.when(F.col("path") == "A.md", "B.md").otherwise("A.md")
    read = store.read
    assert failing("vectors", read("vectors").withColumn("path", other)) == {"verify-spot-check"}
    assert failing("postings", read("postings").withColumn("path", other)) == {"verify-exact-words"}
    assert failing("lengths", read("lengths").withColumn("doc_len", F.col("doc_len") + 1)) == {"verify-exact-words"}
    assert {"verify-sidecar", "verify-exact-words"} <= failing("passages", read("passages").withColumn("path", other))
    twice = read("lengths").withColumn("path", F.lit("A.md"))
    assert failing("lengths", twice, verify=False) == {"exact-words-match"}  # as many in all, but not note for note
    gone = read("postings").union(read("postings").withColumn("path", F.lit("Gone.md")))
    assert failing("postings", gone, verify=False) == {"no-old-text"}
    assert failing("passages", read("passages"), verify=False, content=True) == {"vectors-current", "exact-words-match"}


def test_nothing_to_do(spark, tmp_path):
    root = str(tmp_path / "n")
    write(root, **{f"N{i}.md": f"words of the note number {i}\n" for i in range(3)}, **{"Off.md": "---\nindex: off\n---\nx\n"})
    for f in os.listdir(root):
        os.utime(f"{root}/{f}", (1000, 1000))
    index = Index.create(spark, root, str(tmp_path / "i"))
    first = index.sync()
    second = index.sync()
    assert second.stamp == first.stamp and second.counts == {"unchanged": 3, "left-out": 1, "renamed": 0, "leaving": 0, "other-files": 0}
    os.remove(f"{root}/N0.md")
    third = index.sync()
    assert third.counts["removed"] == 1 and third.stamp != first.stamp
    assert index.sync(verify=True).counts["unchanged"] == 2


def test_stops(spark, tmp_path):
    root, out = str(tmp_path / "n"), str(tmp_path / "i")
    write(root, **{f"N{i}.md": f"words of the note number {i}\n" for i in range(40)})
    index = Index.create(spark, root, out)
    index.sync()
    for i in range(12):
        os.remove(f"{root}/N{i}.md")
    with pytest.raises(MassDelete):
        index.sync()
    assert index.store.read("notes").count() == 40
    assert index.sync(allow_mass_delete=True).counts["removed"] == 12
    for f in os.listdir(root):
        os.remove(f"{root}/{f}")
    with pytest.raises(SourceEmpty):
        index.sync(allow_mass_delete=True)
    with pytest.raises(IndexInsideSource):
        Index(spark, root, f"{root}/index")
    with pytest.raises(SourceMissing):
        Index(spark, f"{root}/no", out)
    base = index.store.state()
    index.store.commit(base, {}, {}, False)
    with pytest.raises(Busy):
        index.store.commit(base, {}, {}, False)
    newest = sorted(os.listdir(f"{out}/_versions"))[-1]
    with open(f"{out}/_versions/9999999999.json", "w") as f:
        f.write(open(f"{out}/_versions/{newest}").read().replace('"schema": 1', '"schema": 2'))
    with pytest.raises(NewerIndex):
        index.store.state()


def test_failing_embedder_stops_a_sync(spark, tmp_path):
    import numpy as np

    from notefold.embed import HashedWords

    class Broken(HashedWords):
        def embed(self, texts):
            return np.full((len(texts), self.dimensions), np.nan, dtype=np.float32)

    root = str(tmp_path / "n")
    write(root, **{f"N{i}.md": f"words of the note number {i}\n" for i in range(9)})
    index = Index.create(spark, root, str(tmp_path / "i"), embedder=Broken)
    with pytest.raises(EmbeddingFails):
        index.sync()
    assert index.store.state().number == 0


def test_vault_registry(tmp_path):
    a, b = tmp_path / "x" / "Notes", tmp_path / "y" / "notes"
    a.mkdir(parents=True), b.mkdir(parents=True)
    reg = tmp_path / "r.json"
    assert lookup_vault(str(a), str(reg)) == ("no-list", "Notes")
    reg.write_text(json.dumps({"vaults": {"id1": {"path": str(a)}}}))
    assert lookup_vault(str(a), str(reg)) == ("registered", "Notes") and lookup_vault(str(b), str(reg)) == ("not-registered", None)
    reg.write_text(json.dumps({"vaults": {"id1": {"path": str(a)}, "id2": {"path": str(b)}}}))
    assert lookup_vault(str(b), str(reg)) == ("registered", "id2")


def test_totals():
    assert PlanTotals(50, 100, 30, 0, 30).leaving == 0
    assert PlanTotals(50, 40, 12, 0, 0).mass_delete and not PlanTotals(50, 100, 10, 0, 0).mass_delete and not PlanTotals(50, 100, 20, 0, 0).mass_delete
    assert not would_stop(30, 30, 100, 100) and would_stop(30, 0, 100, 100) and would_stop(0, 0, 5, 0)


def test_chunking_in_sql(spark):
    notes = spark.createDataFrame([("A.md", bytearray(b"# H\n\nthree words here\n"), False), ("B.md", None, None), ("C.md", bytearray(b"---\nindex: no\n---\nx\n"), False)], "path STRING, content BINARY, fip BOOLEAN")
    chunked = {r["path"]: r["reason"] for r in chunk_notes(notes).collect()}
    assert chunked == {"A.md": None, "B.md": "unreadable", "C.md": "index-false"}
    assert [r["text"] for r in explode_passages(chunk_notes(notes)).collect()] == ["three words here"]
    register_sql(spark)
    notes.createOrReplaceTempView("some_notes")
    got = spark.sql("SELECT n.path, p.text FROM some_notes n, LATERAL chunk_note(n.content, n.path, n.fip) p").collect()
    assert [tuple(r) for r in got] == [("A.md", "three words here")]
    assert spark.sql("SELECT note_tokens('A b-C'), cosine(array(3f, 4f), array(4f, 3f))").first()[0] == ["a", "b", "c"]


LOG = [
    {"v": 1, "op": "header"},
    {"v": 1, "op": "put", "path": "A.md", "sha256": "1", "size": 3, "mtimeMs": 5, "fip": False, "title": "A", "passages": [{"n": 0, "trail": ["T"], "line": 1, "text": "old words here", "vec": 0, "flags": []}]},
    {"v": 1, "op": "put", "path": "B.md", "sha256": "2", "size": 3, "mtimeMs": 5, "fip": False, "title": "B", "passages": [{"n": 0, "trail": [], "line": 1, "text": "other words here", "vec": 1, "flags": ["possible-secret"]}]},
    {"v": 1, "op": "put", "path": "A.md", "sha256": "3", "size": 3, "mtimeMs": 6, "fip": False, "title": "A", "passages": [{"n": 0, "trail": [], "line": 1, "text": "new words here", "vec": 2, "flags": []}]},
    {"v": 1, "op": "del", "path": "B.md"},
]


def test_logs(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [json.dumps(r) for r in LOG]
    (tmp_path / "log" / "1.jsonl").write_text("\n".join(lines) + "\n" + lines[1][:40])  # torn
    log = read_log(spark, f"file://{tmp_path}/log")
    assert log.count() == 5
    (live,) = live_records(log).collect()
    assert (live["path"], live["sha256"], live["passages"][0]["text"]) == ("A.md", "3", "new words here")
    write_log(log.drop("gen", "file", "pos"), f"file://{tmp_path}/copy")
    assert read_log(spark, f"file://{tmp_path}/copy").count() == 5
    (tmp_path / "q.json").write_text(json.dumps([{"n": 1, "question": "q", "phrasings": ["a"], "exact": "e", "expected": "x"}]))
    assert read_questions(spark, f"file://{tmp_path}/q.json").first()["phrasings"] == ["a"]


def test_a_log_ends_at_its_first_torn_line(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [json.dumps(r) for r in LOG]
    (tmp_path / "log" / "1.jsonl").write_text("\n".join([lines[1], "", lines[2][:30], lines[3]]))
    (tmp_path / "log" / "2.jsonl").write_text(lines[4])
    assert [(r["op"], r["path"], r["pos"]) for r in read_log(spark, f"file://{tmp_path}/log").orderBy("file", "pos").collect()] == [("put", "A.md", 0), ("del", "B.md", 0)]


def test_streamed_log(spark, tmp_path):
    from notefold.embed import HashedWords
    from notefold.streaming.syncs import apply_records, files_a_batch

    logs = tmp_path / "log"
    logs.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    (logs / "1.jsonl").write_text("\n".join(json.dumps(r) for r in LOG[:3]) + "\n")
    go = lambda check="check", **o: stream_log(spark, f"file://{logs}", store, f"file://{tmp_path}/{check}", **o)
    go()
    assert {r["text"] for r in store.read("passages").collect()} == {"old words here", "other words here"}
    assert {r["path"]: r["flagged"] for r in store.read("notes").collect()} == {"A.md": 0, "B.md": 1}
    (logs / "2.jsonl").write_text("\n".join(json.dumps(r) for r in LOG[3:]) + "\n")
    go(settle_ms=10**9)  # written too shortly before
    assert store.read("passages").count() == 2
    go()
    go()
    assert {r["text"] for r in store.read("passages").collect()} == {"new words here"}
    assert store.read("postings").where("token = 'old'").count() == 0
    # Vectors follow: the deleted note's is gone, the replaced one's is new.
    (vector,) = store.read("vectors").collect()
    assert vector["path"] == "A.md" and vector["vector"] == HashedWords().embed(["A\nnew words here"])[0].tolist()
    # A repeated batch changes nothing, a new checkpoint isn't taken for one.
    before = store.state()
    again = read_log(spark, f"file://{logs}")
    assert not apply_records(store, again, 0, next(iter(before.meta["batches"]))) and store.state().number == before.number
    (logs / "1.jsonl").unlink(), (logs / "2.jsonl").unlink()
    (logs / "3.jsonl").write_text(json.dumps(LOG[2]) + "\n")
    go("other check")
    assert {r["path"] for r in store.read("notes").collect()} == {"A.md", "B.md"}
    assert [files_a_batch(r) for r in (0.1, 4, 1000)] == [8, 20, 128]


def test_the_last_line_of_the_last_file_counts(spark, tmp_path):
    logs = tmp_path / "log"
    logs.mkdir()
    for k in (2, 1, 3):
        lines = [dict(LOG[1], sha256=f"{k}-{i}") for i in range(200)]
        (logs / f"{k}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    store = Store(spark, f"file://{tmp_path}/store")
    stream_log(spark, f"file://{logs}", store, f"file://{tmp_path}/check")
    assert store.read("notes").first()["sha256"] == "3-199"


def test_a_log_file_is_read_in_splits(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ["" if i % 7 == 3 else json.dumps(dict(LOG[1], path=f"{i}.md", passages=LOG[1]["passages"] * (i % 3))) for i in range(20_000)]
    (tmp_path / "log" / "a [1].jsonl").write_text("\n".join(lines))
    (tmp_path / "log" / "b.jsonl").write_text("\n".join([*lines[:15_000], lines[0][:30], *lines[15_000:]]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        log = read_log(spark, f"file://{tmp_path}/log").select("path", "pos", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["pos"], r["path"]) for r in log) == sorted((i, f"{i}.md") for n in (20_000, 15_000) for i in range(n) if i % 7 != 3)
    assert len({r["part"] for r in log}) > 10


def test_a_stream_goes_by_names_and_on_from_where_it_broke_off(spark, tmp_path):
    logs = tmp_path / "log"
    logs.mkdir()
    for k, age in ((3, 9), (1, 8), (2, 7)):  # the last by name was written first
        (logs / f"[{k}].jsonl").write_text("\n".join(json.dumps(dict(LOG[1], path=p, sha256=str(k))) for p in ("A.md", f"{k}.md")))
        os.utime(logs / f"[{k}].jsonl", (10**9 - age, 10**9 - age))
    store, commit, read = Store(spark, f"file://{tmp_path}/store"), Store.commit, []

    def breaks(self, base, changes, *rest):
        read.append(sorted(r["path"] for r in changes["notes"].fresh.collect()))
        if len(read) == 3:
            raise OSError("broke off")
        return commit(self, base, changes, *rest)

    go = lambda: stream_log(spark, f"file://{logs}", store, f"file://{tmp_path}/check", files_per_batch=1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Store, "commit", breaks)
        with pytest.raises(Exception, match="broke off"):
            go()
        assert {r["path"]: r["sha256"] for r in store.read("notes").collect()} == {"A.md": "2", "1.md": "1", "2.md": "2"}
        go()
        go()
    assert read == [["1.md", "A.md"], ["2.md", "A.md"], ["3.md", "A.md"], ["3.md", "A.md"]]
    assert {r["path"]: r["sha256"] for r in store.read("notes").collect()} == {"A.md": "3", "1.md": "1", "2.md": "2", "3.md": "3"}


def test_one_writer_at_a_time(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with store.lock():
        with pytest.raises(Busy):
            with Store(spark, f"file://{tmp_path}/s").lock():
                pass
        with Store(spark, f"file://{tmp_path}/s").lock(now_ms=lambda: 10**14) as later:  # taken over as stale
            assert later
            with pytest.raises(Busy):
                store._still_ours()
    with store.lock():
        pass


def test_buckets_follow_the_size(spark, tmp_path):
    from notefold.store import Change

    store = Store(spark, f"file://{tmp_path}/s", bucket_bytes=600)
    rows = lambda a, b: spark.createDataFrame([(f"{i:04d}.md", 0, i) for i in range(a, b)], "path STRING, n INT, doc_len INT")
    none = rows(0, 0).select("path")
    state = store.commit(store.state(), {"lengths": Change(none, rows(0, 50))}, {}, True)
    assert state.buckets["lengths"] == 8
    for k in range(1, 9):
        state = store.commit(state, {"lengths": Change(none, rows(50 * k, 50 * k + 50))}, {}, True, added_bytes=4_000)
    assert state.buckets["lengths"] >= 16 and {tuple(r) for r in store.read("lengths").collect()} == {(f"{i:04d}.md", 0, i) for i in range(450)}
    before = dict(state.tables["lengths"])
    state = store.commit(state, {"lengths": Change(rows(3, 4).select("path"), rows(3, 4))}, {}, True)
    assert sum(before[b] != f for b, f in state.tables["lengths"].items()) == 1  # one bucket was written


def test_a_reader_reads_again_when_the_index_was_published_anew(spark, tmp_path):
    root = str(tmp_path / "n")
    write(root, **{"A.md": "apples ripen slowly in autumn\n"})
    index = Index.create(spark, root, str(tmp_path / "i"))
    index.sync()
    seen = []

    def use(state):
        rows = index.store.read("passages", state)
        if not seen:  # a sync comes between listing the files and reading them
            write(root, **{"A.md": "pears ripen slowly in autumn\n"})
            index.sync()
        seen.append(state.number)
        return rows.collect()

    assert [r["text"] for r in index.store.reading(use)] == ["pears ripen slowly in autumn"] and len(seen) == 2


def test_asking_brings_a_little_in_step(spark, tmp_path):
    root = str(tmp_path / "n")
    write(root, **{f"N{i}.md": f"apples ripen slowly in autumn {i}\n" for i in range(12)})
    index = Index.create(spark, root, str(tmp_path / "i"))
    with pytest.raises(NotSynced):
        index.ask("apples")
    index.sync()
    write(root, **{"New.md": "the heliotrope flowers in june\n"})
    answer = index.ask("heliotrope june")
    assert answer.notices == [] and "New.md" in {r["path"] for r in [*answer.meaning.collect(), *answer.exact.collect()]}
    for i in range(12):
        os.remove(f"{root}/N{i}.md")
    answer = index.ask("apples")
    assert any("many notes are gone" in n for n in answer.notices) and index.store.read("notes").count() == 13
    write(root, **{f"M{i}.md": f"boats drift gently {i}\n" for i in range(30)})
    assert any("notes not in step" in n for n in index.ask("boats").notices)


def test_damaged_words_cost_one_list_and_are_made_again(spark, tmp_path):
    root, out = str(tmp_path / "n"), tmp_path / "i"
    write(root, **{f"N{i}.md": f"apples ripen slowly in autumn number {i}\n" for i in range(20)})
    index = Index.create(spark, root, str(out))
    index.sync()
    assert index.search("apples", 1)[1].count() >= 2
    for f in out.glob("data-*/postings/*/*.parquet"):
        f.write_bytes(b"no table")
    for f in out.glob("data-*/postings/*/.*.crc"):
        f.unlink()
    spark.catalog.clearCache()
    meaning, exact = index.search("apples", 1)
    assert exact is None and meaning.count() == 1
    index.rebuild()
    assert index.search("apples", 1)[1].count() >= 2
    assert all(r["ok"] for r in index.status().collect())


def test_a_stalled_read_is_given_up():
    import time

    from notefold.sources.vault import within

    assert within(lambda: time.sleep(5) or b"late", 0.05) is None and within(lambda: b"now", 5) == b"now"


def test_shown_numbers():
    from notefold.embed import padded_to
    from notefold.functions.shown import duration, eta, num, plural

    assert (num(1234567), plural(1, "note"), plural(2_000, "note"), plural(2, "entry", "entries")) == ("1,234,567", "1 note", "2,000 notes", "2 entries")
    assert [duration(ms) for ms in (7, 1_500, 42_000, 125_000, 1_800_000, 9_000_000)] == ["7 ms", "1.5 s", "42 s", "2 min 5 s", "30 min", "2 h 30 min"]
    assert eta(10, 40, 2_000) == "6.0 s" and eta(0, 5, 100) is None
    assert [padded_to(n, 126) for n in (3, 14, 15, 40, 63, 126)] == [16, 16, 32, 64, 128, 128]


def test_command_line(spark, vault, tmp_path, capsys):
    from notefold.cli import main

    out = str(tmp_path / "cli")
    assert main(["init", vault, "--index", out, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["notesFound"] == 8
    assert main(["search", vault, "words", "--index", out, "--json"]) == 5
    assert json.loads(capsys.readouterr().out)["error"]["code"] == "NotSynced"
    assert main(["sync", vault, "--index", out, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["ok"]
    assert main(["search", vault, "tomatoes frost", "--index", out, "--json", "-k", "2"]) == 0
    assert len(json.loads(capsys.readouterr().out)["results"]) == 2
    assert main(["search", vault, "tomatoes frost", "--index", out]) == 0
    assert "match" in capsys.readouterr().out
    assert main(["status", vault, "--index", out]) == 0
    assert "ok  nothing-pending" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nonsense"])
