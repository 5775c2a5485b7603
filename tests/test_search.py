from __future__ import annotations

import math

import pytest

from notefold.operators import bm25 as b
from notefold.operators import cosine as c
from notefold.operators.postings import doc_lengths, note_state, postings, refresh_postings
from notefold.operators.recall import recall_at_k
from notefold.operators.search import search

PASSAGE = "path STRING, n INT, title STRING, trail ARRAY<STRING>, heads ARRAY<STRING>, rep BOOLEAN, line INT, text STRING, flags ARRAY<STRING>, recovered BOOLEAN"


def rows(spark, *notes):
    return spark.createDataFrame([(p, n, p.removesuffix(".md"), trail, trail, False, n + 1, t, [], False) for p, n, trail, t in notes], PASSAGE)


@pytest.fixture(scope="module")
def garden(spark):
    return rows(
        spark,
        ("Tomatoes.md", 0, ["Frost"], "Plant tomatoes after the last frost, tomatoes hate cold."), ("Tomatoes.md", 1, [], "Water tomatoes deeply and rarely in summer heat."),
        ("Beans.md", 0, [], "Runner beans climb poles."), ("Soup.md", 0, [], "Stock from bones."), ("Soup.md", 1, [], "White beans simmer slowly."), ("Soup.md", 2, [], "Frost on the window, the last one of March."),
    ).cache()


def test_postings_and_lengths(spark, garden):
    tf = {(r["path"], r["n"], r["token"]): r["tf"] for r in postings(garden).collect()}
    assert tf["Tomatoes.md", 0, "tomatoes"] == 3 and tf["Tomatoes.md", 0, "frost"] == 2 and ("Tomatoes.md", 0, "the") not in tf
    many = rows(spark, ("Big.md", 0, None, "bean " * 400))
    assert [r["tf"] for r in postings(many).where("token = 'bean'").collect()] == [255]
    assert {r["doc_len"] for r in doc_lengths(many).collect()} == {401}


def test_scores(spark, garden):
    asked = b.wordings_table(spark, ["tomatoes frost"])
    post, lens = postings(garden), doc_lengths(garden)
    got = b.ranked(b.bm25(post, lens, asked)).collect()
    assert [(r["path"], r["n"]) for r in sorted(got, key=lambda r: r["rank"])] == [("Tomatoes.md", 0), ("Tomatoes.md", 1), ("Soup.md", 2)]
    length = {(r["path"], r["n"]): r["doc_len"] for r in lens.collect()}
    avg = sum(length.values()) / 6
    w = lambda df: math.log(1 + (6 - df + 0.5) / (df + 0.5))
    s = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    want = w(2) * s(3, length["Tomatoes.md", 0]) + w(2) * s(2, length["Tomatoes.md", 0])
    assert abs(max(r["score"] for r in got) - want) < 1e-9


def hits(spark, passages, *questions):
    asked = b.wordings_table(spark, list(questions))
    return b.exact_words(b.bm25(postings(passages), doc_lengths(passages), asked), passages, asked)


def test_exact_words(spark, garden):
    (r,) = hits(spark, garden, "how should I water my tomatoes").where("path = 'Tomatoes.md'").collect()
    assert (r["n"], r["words"]) == (1, ["water", "tomatoes"])
    got = hits(spark, garden, 'the "last frost"').collect()
    assert {(r["path"], r["n"]) for r in got} == {("Tomatoes.md", 0)}  # Soup says both words, but not as neighbours
    assert hits(spark, garden, 'a "tomatoes plant" phrase').count() == 0  # title and text are fields of their own
    assert hits(spark, garden, "how do I do it").count() == 0
    none = hits(spark, garden.limit(0), "tomatoes")
    assert none.count() == 0


def test_interleaving_and_what_is_shown(spark):
    notes = rows(spark, *[(f"N{i}.md", 0, [], f"alpha word{i} beta" if i % 2 else f"alpha filler filler word{i}") for i in range(8)])
    got = b.interleaved(hits(spark, notes, "alpha", "beta")).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(got))) and len({r["path"] for r in got}) == len(got) <= 6
    assert [r["place"] for r in got] == sorted(r["place"] for r in got)
    all_hits = b.interleaved(hits(spark, notes, "alpha", "beta"))
    left = b.not_already_shown(all_hits, all_hits.where("pos = 0")).collect()
    assert len(left) == min(3, len(got) - 1) and sorted(r["rank"] for r in left) == list(range(1, len(left) + 1))


def test_word_cap_of_a_call(spark):
    asked = b.wordings_table(spark, [" ".join(f"w{i}x" for i in range(200)), " ".join(f"v{i}x" for i in range(200))]).collect()
    assert sorted(len(r["words"]) for r in asked) == [55, 200]


def test_refresh_equals_fresh(spark, garden):
    old = garden.where("path <> 'Beans.md'")
    new = garden.where("path <> 'Soup.md'").unionByName(rows(spark, ("Soup.md", 0, [], "Another soup entirely.")))
    got = refresh_postings(postings(old), note_state(old), new)
    fresh = postings(new)
    assert got.exceptAll(fresh).count() == 0 == fresh.exceptAll(got).count()


VEC = "path STRING, n INT, vector ARRAY<FLOAT>"


def test_collapse(spark):
    got = spark.createDataFrame([(0, "A.md", 3, 0.9), (0, "B.md", 2, 0.7), (0, "X.md", 0, 0.99), (1, "A.md", 1, 0.85), (1, "C.md", 0, 0.8), (1, "B.md", 1, 0.75), (1, "B.md", 2, 0.75)], "wording INT, path STRING, n INT, score DOUBLE")
    manifest = spark.createDataFrame([("A.md", 4), ("B.md", 3), ("C.md", 1)], "path STRING, passages INT")
    notes = c.best_notes(c.collapse(c.known(got, manifest)), 8).orderBy("rank").collect()
    assert [(r["path"], r["n"], r["score"], r["more_passages"]) for r in notes] == [("A.md", 3, 0.9, 1), ("C.md", 0, 0.8, 0), ("B.md", 1, 0.75, 1)]


def test_a_long_note_makes_a_second_fetch(spark):
    long = [("Long.md", i, [1.0, 0.001 * i]) for i in range(120)]
    others = [(f"N{i}.md", 0, [0.5, 1.0 + i]) for i in range(4)]
    v = spark.createDataFrame(long + others, VEC)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "wording INT, vector ARRAY<FLOAT>")
    manifest = spark.createDataFrame([("Long.md", 120)] + [(p, 1) for p, _, _ in others], "path STRING, passages INT")
    notes = c.fetch_notes(v, q, manifest, 3, 2).orderBy("rank").collect()
    assert [r["path"] for r in notes] == ["Long.md", "N0.md", "N1.md"] and notes[0]["more_passages"] == 119
    assert c.clamp_count(None) == 8 and c.clamp_count(0) == 1 and c.clamp_count(99) == 50


def test_two_lists_are_never_fused(spark):
    passages = rows(spark, ("Meaning.md", 0, [], "plain words"), ("Other.md", 0, [], "other plain words"), ("Exact.md", 0, [], "nothing here"), ("Exact.md", 1, ["Music"], "heliotrope accordion tune"))
    v = spark.createDataFrame([("Meaning.md", 0, [1.0, 0.0, 0.0, 0.0]), ("Other.md", 0, [0.9, 0.1, 0.0, 0.0]), ("Exact.md", 0, [0.0, 1.0, 0.0, 0.0]), ("Exact.md", 1, [0.0, 0.0, 1.0, 0.0]), ("Bad.md", 0, [0.0] * 4)], VEC)
    manifest = passages.groupBy("path").count().withColumnRenamed("count", "passages")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "wording INT, vector ARRAY<FLOAT>")
    args = (passages, v, manifest, postings(passages), doc_lengths(passages), ["heliotrope accordion"], q, 4)
    meaning, exact = search(*args, count=2, root="/notes", vault="V")
    alone, none = search(*args, count=2, with_exact=False, root="/notes", vault="V")
    assert none is None and meaning.exceptAll(alone).count() == 0 == alone.exceptAll(meaning).count()
    assert [r["path"] for r in meaning.orderBy("rank").collect()] == ["Meaning.md", "Other.md"]
    (hit,) = exact.collect()
    assert (hit["passage"], hit["words"], hit["line"], hit["section"], hit["file"]) == ("Exact.md#1", ["heliotrope", "accordion"], 2, "Music", "/notes/Exact.md")
    assert hit["link"].endswith("Exact.md%23Music")


def test_recall(spark):
    found = spark.createDataFrame([(0, 1, "a", "a"), (0, 2, "a", "b"), (1, 1, "a", "b"), (1, 3, "a", "a"), (2, 1, "a", "c")], "wording INT, rank INT, expected STRING, found STRING")
    assert {r["k"]: r["recall"] for r in recall_at_k(found, [1, 3]).collect()} == {1: 0.333333, 3: 0.666667}
