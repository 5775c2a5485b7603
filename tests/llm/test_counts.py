from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from notefold.llm.ngrams import banded, ngram_counts
from notefold.llm.terms import term_weights, top_terms


def brute(docs, max_n):
    cf, df = Counter(), Counter()
    for d in docs:
        grams = [" ".join(d[i : i + n]) for n in range(1, max_n + 1) for i in range(len(d) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    return {g: (len(g.split()), cf[g], df[g]) for g in cf}


@pytest.mark.parametrize("max_n", [1, 2, 3, 5])
def test_ngrams_equal_brute_force(spark, max_n):
    rng = random.Random(max_n)
    docs = [[rng.choice(["the"] * 6 + [*"abcdé北"]) for _ in range(rng.randrange(12))] for _ in range(80)]  # "the" is hot
    docs += [["the"] * 30, docs[0], ["x"], []]
    rows = spark.createDataFrame([(d, "clash") for d in docs] + [(None, "")], "tokens ARRAY<STRING>, gram STRING").repartition(5)
    got = {r["gram"]: (r["n"], r["cf"], r["df"]) for r in ngram_counts(rows, "tokens", max_n).collect()}
    assert got == brute(docs, max_n)


def test_bands_and_nothing(spark):
    docs = [["a", "b"]] * 3 + [["a"]] * 17
    rows = spark.createDataFrame([(d,) for d in docs], "tokens ARRAY<STRING>")
    assert {r["gram"]: r["band"] for r in banded(ngram_counts(rows, "tokens"), len(docs)).collect()} == {"a": "common", "b": None}
    assert banded(ngram_counts(rows.limit(0), "tokens"), 0).count() == 0
    assert ngram_counts(rows.limit(0), "tokens", 3).count() == 0


STORED = "vec LONG, path STRING, n INT, title STRING, text STRING, term STRING"


def test_weights(spark):
    rows = [
        (1, "a", 0, "Garden", "old words gone", ""), (2, "a", 0, "Garden", "tomato tomato frost", "clash"), (2, "a", 0, "Garden", "tomato tomato frost", ""),
        (3, "a", 1, "Garden", None, ""), (4, "b", 0, None, "frost garden soil", ""), (5, "c", 0, "Soil", "", ""), (6, "d", 0, None, None, ""), (7, None, 0, "x", "lost", ""),
    ]
    df = spark.createDataFrame(rows, STORED)
    w = {(r["path"], r["term"]): r["weight"] for r in term_weights(df).collect()}
    n = 4
    want = {("a", "garden"): 1 * math.log(n / 2), ("a", "tomato"): 2 * math.log(n / 1), ("a", "frost"): math.log(n / 2), ("b", "frost"): math.log(n / 2), ("b", "garden"): math.log(n / 2), ("b", "soil"): math.log(n / 2), ("c", "soil"): math.log(n / 2)}
    assert w.keys() == want.keys() and all(abs(w[k] - want[k]) < 1e-6 for k in w)
    top = {(r["path"], r["term"]) for r in top_terms(term_weights(df), 1).collect()}
    assert top == {("a", "tomato"), ("b", "frost"), ("c", "soil")}  # ties go to the smaller term
    ent = {(r["path"], r["term"]): r["weight"] for r in term_weights(df, "log_entropy").collect()}
    assert abs(ent["a", "tomato"] - math.log(3)) < 1e-6  # all in one note
    assert abs(ent["b", "soil"] - math.log(2) * (1 - math.log(2) / math.log(4))) < 1e-6
    with pytest.raises(ValueError):
        term_weights(df, "no such")


def test_hot_notes_and_frequent_terms(spark, monkeypatch):
    """With limits so small that every path of the plan is taken."""
    from notefold.llm import terms

    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 3 + [*"abcde"]), i, rng.choice(["T one", None]), " ".join(rng.choices("the of frost bean soil water".split() + [f"w{k}" for k in range(30)], k=8)), "") for i in range(300)]
    rows = [(v, p, n, "T one", t, x) for v, p, n, _, t, x in rows]
    df = spark.createDataFrame(rows, STORED)
    plain = {tuple(r) for r in term_weights(df).collect()}
    monkeypatch.setattr(terms, "HOT_ROWS", 40)
    monkeypatch.setattr(terms, "FREQUENT", 8)
    assert {tuple(r) for r in term_weights(df).collect()} == plain
    tf = Counter()
    for _, p, _, _, t, _ in rows:
        tf.update((p, w) for w in t.split())
    for p in {r[1] for r in rows}:
        tf.update([(p, "t"), (p, "one")])
    df_ = Counter(t for _, t in tf)
    assert plain == {(p, t, round(c * math.log(6 / df_[t]), 6)) for (p, t), c in tf.items()} or all(abs(w - tf[p, t] * math.log(6 / df_[t])) < 2e-6 for p, t, w in plain)


def test_no_passages(spark):
    assert term_weights(spark.createDataFrame([], STORED)).count() == 0
