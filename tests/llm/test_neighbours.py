from __future__ import annotations

import numpy as np

from notefold.llm.neighbours import neighbours, ranked, similar_pairs, top_of_block, traverse
from tests.conftest import SF

SCHEMA = "vec LONG, embedding ARRAY<FLOAT>, other STRING"


def brute(x: np.ndarray, ids, k: int):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (-round(float(s[i, j]), 6), ids[j]))
        out[ids[i]] = [ids[j] for j in order if j != i][:k]
    return out


def unit(rng, n, dims=64):
    x = rng.standard_normal((n, dims)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_heap_passes_cells_in_order():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(7), rng.random(9)
    cells = traverse(d1, d2, {i: 1 for i in range(63)}, 63)
    sums = [d1[c // 9] + d2[c % 9] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == 63
    assert traverse(d1, d2, {i: 5 for i in range(63)}, 11) == cells[:3]


def test_top_of_block():
    rng = np.random.default_rng(2)
    x = unit(rng, 300)
    best, cos = top_of_block(x, np.arange(300), 10)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert np.allclose(np.sort(cos, axis=1)[:, ::-1], -np.sort(-s, axis=1)[:, :10], atol=1e-6)
    assert top_of_block(x[:1], np.array([0]), 10)[0].shape == (1, 0)


def test_recall_with_many_blocks(spark):
    rng = np.random.default_rng(3)
    centres = unit(rng, 40)
    x = np.concatenate([c + 0.12 * rng.standard_normal((60, 64)) for c in centres]).astype(np.float32)
    x *= rng.uniform(0.2, 5, (len(x), 1)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ranked(neighbours(df, centroids=24, block=150, candidates=600)).collect():
        got.setdefault(r["vec"], []).append(r["other"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = brute(u, list(range(len(x))), 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9


def test_production_recall(spark):
    table = spark.read.parquet(f"{SF}/passage_vectors.parquet")
    rows = {r["vec"]: r["embedding"] for r in table.collect()}
    usable = {i: np.array(v, dtype=np.float64) for i, v in rows.items() if v is not None and len(v) == 64 and np.isfinite(v).all() and any(v)}
    ids = sorted(usable)
    u = np.stack([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    want = brute(u, ids, 10)
    got = {}
    for r in ranked(neighbours(table)).collect():
        got.setdefault(r["vec"], set()).add(r["other"])
    assert set(got) == set(want)
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in ids]) >= 0.9


def test_dirty_vectors_copies_and_ties(spark):
    a, b = [1.0] + [0.0] * 63, [0.9, 0.1] + [0.0] * 62
    rows = [(i, a, "") for i in range(100, 130)]  # thirty copies
    rows += [(1, b, ""), (1, b, ""), (2, None, ""), (3, [0.0] * 64, ""), (4, [float("nan")] + a[1:], ""), (5, [1.0], ""), (6, [float("inf")] + a[1:], ""), (None, a, "")]
    rows += [(7, [2.0] + [0.0] * 63, "")]  # another length
    out = ranked(neighbours(spark.createDataFrame(rows, SCHEMA))).collect()
    by = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by.setdefault(r["vec"], []).append(r["other"])
    assert set(by) == {1, 7, *range(100, 130)}
    assert by[129] == [7, *range(100, 109)] and by[7] == list(range(100, 110)) and by[100] == [7, *range(101, 110)]
    assert by[1] == [7, *range(100, 109)]
    pairs = {tuple(r) for r in similar_pairs(neighbours(spark.createDataFrame(rows, SCHEMA)), 0.999).collect()}
    assert (7, 100) in pairs and (1, 7) not in pairs and all(x < y for x, y in pairs)
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours(empty).count() == 0
    assert neighbours(spark.createDataFrame([(1, a, ""), (2, None, "")], SCHEMA)).count() == 0


def test_hot_and_many_blocks(spark, monkeypatch):
    """A cell with most vectors is several tasks, and the traversal is done by the executors."""
    from notefold.llm import neighbours as nb

    monkeypatch.setattr(nb, "HOT_BLOCKS", 1)
    monkeypatch.setattr(nb, "FEW_BLOCKS", 2)
    rng = np.random.default_rng(5)
    one = unit(rng, 1)[0]
    x = np.concatenate([one + 0.02 * rng.standard_normal((300, 64)), unit(rng, 300)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ranked(neighbours(df, centroids=8, block=40, candidates=500)).collect():
        got.setdefault(r["vec"], []).append(r["other"])
    want = brute(x / np.linalg.norm(x, axis=1, keepdims=True), list(range(600)), 10)
    assert set(got) == set(want) and all(len(set(v)) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9


def test_exact_mode_is_brute_force(spark):
    rng = np.random.default_rng(6)
    x = unit(rng, 400)
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ranked(neighbours(df, centroids=8, block=40, candidates=50, exact=True)).collect():
        got.setdefault(r["vec"], set()).add(r["other"])
    want = brute(x, list(range(400)), 10)
    assert all(got[i] == set(want[i]) for i in want)


def test_a_third_of_all_is_one_vector(spark):
    """Its copies are spread over tasks; each has the class's least positions as neighbours."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(unit(rng, 1), 900, axis=0), unit(rng, 1800)])
    order = rng.permutation(len(x))
    x = x[order]
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA).repartition(5)
    copies = sorted(np.flatnonzero(order < 900).tolist())
    got = {}
    for r in ranked(neighbours(df)).collect():
        got.setdefault(r["vec"], []).append((r["rank"], r["other"]))
    assert set(got) == set(range(len(x))) and all(len(v) == 10 for v in got.values())
    for c in copies:
        assert [o for _, o in sorted(got[c])] == [o for o in copies[:11] if o != c][:10]


def test_routes_deal_blocks_by_size():
    from notefold.llm.neighbours import Routes

    cells, counts = np.arange(40), np.full(40, 3_000)
    counts[0] = 60_000
    own = np.arange(40)
    r = Routes(cells, counts, own, np.repeat(own, 4), np.array([(b + j) % 40 for b in range(40) for j in range(4)]), 40, 3_000, 4)
    load = np.zeros(r.tasks)
    for b in range(40):
        for part in range(r.start[b], r.start[b + 1]):
            load[r.task_of[part]] += sum(counts[c] for c in range(40) if part in r.of(c, 7) or part in r.targets[r.ends[c] : r.ends[c + 1]])
    assert load.max() <= load.mean() * 2 + 70_000 and r.parts[0] == 5


def test_more_vectors_get_more_cells():
    from notefold.llm.neighbours import centroids_for

    assert [centroids_for(n) for n in (10, 10**8, 10**9, 10**12)] == [512, 512, 1024, 2048]
