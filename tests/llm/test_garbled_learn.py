"""What is learnt: tables that no page has, and lines with more than one fault."""

from __future__ import annotations

import random

import pytest

from notefold.llm import garbled as g
from tests.llm.test_garbled import DOC, WORDS, corpus


def permuted(lang: str) -> dict[int, str]:
    """A byte-to-letter table of no page: the language's letters, each as some sign of the upper half."""
    rng = random.Random(lang)
    letters = sorted({c for w in WORDS[lang] for c in w if c > "\x7f"} | {c.upper() for w in WORDS[lang] for c in w if c > "\x7f"})
    letters = [c for c in letters if len(c) == 1]
    signs = rng.sample([chr(c) for c in range(0xA1, 0x180) if c not in (0xAD, 0x149)], len(letters))
    return str.maketrans(dict(zip(letters, signs)))


@pytest.mark.parametrize("lang", ["de", "fr", "ru"])
def test_a_page_that_nobody_named_is_learnt(spark, lang):
    rng = random.Random(11)
    rows, _, originals = corpus(rng, 500)
    table, truth = permuted(lang), {}
    for i in range(3000, 3200):
        truth[i] = " ".join(rng.choices(WORDS[lang], k=20))
        rows.append((i, truth[i].translate(table), "unknown page", ""))
    out = {r["doc_id"]: r for r in g.repair(spark.createDataFrame(rows, DOC)).collect()}
    assert sum(out[i]["garbled"] for i in truth) / len(truth) >= 0.95
    right = sum(a == b for i in truth for a, b in zip(out[i]["restored"].split(), truth[i].split()))
    assert right / sum(len(t.split()) for t in truth.values()) >= 0.9
    assert {s for i in truth for s in out[i]["swaps"]} == {"?>learnt"}
    assert all(out[i]["restored"] == originals[i] for i in originals if not out[i]["garbled"])


def test_a_source_in_a_language_of_its_own_is_left_alone(spark):
    rng = random.Random(12)
    rows, _, _ = corpus(rng, 500)
    parts = "čer řek žiť ůst ěla ďob ňan ýka šum ová pří dle ost".split()
    cz = ["".join(rng.choices(parts, k=rng.choice([1, 2, 3]))) for _ in range(300)]
    rows += [(4000 + i, " ".join(rng.choices(cz, k=20)), "only here", "") for i in range(200)]
    out = {r["doc_id"]: r for r in g.repair(spark.createDataFrame(rows, DOC)).collect()}
    assert not any(r["garbled"] for i, r in out.items() if i >= 4000)


def test_a_page_whose_letters_a_source_had_otherwise(spark):
    """Mostly cp1251 read as cp1252, but this source's table has two letters changed: it is learnt."""
    rng = random.Random(13)
    rows, _, _ = corpus(rng, 700)
    odd = str.maketrans("îå", "åî")
    truth = {}
    for i in range(5000, 5150):
        truth[i] = " ".join(rng.choices(WORDS["ru"], k=20))
        rows.append((i, truth[i].encode("cp1251").decode("cp1252").translate(odd), "two letters", ""))
    model = g.learn(spark.createDataFrame(rows, DOC))
    learnt = model.tables.get(("two letters", ("cp1252", "cp1251")), {})
    assert learnt.get(ord("å")) == "о" and learnt.get(ord("î")) == "е"


@pytest.fixture(scope="module")
def model(spark):
    return g.learn(spark.createDataFrame(corpus(random.Random(7))[0], DOC))


def test_several_swaps_in_one_line(model):
    bad = "fÃ¼r Ã¼ber schÃ¶n " + "вода осень решение дорога".encode("cp1251").decode("cp1252")
    swaps, text = g.judge_line(model, "a", bad)
    assert text == "für über schön вода осень решение дорога" and len(swaps) == 2


def test_each_stretch_is_restored_in_its_place(model):
    swaps, text = g.judge_line(model, "a", "fÃ¼r und xfÃ¼rx bleibt über Straße, fÃ¼r")
    assert text.startswith("für und x") and text.endswith("über Straße, für") and swaps


def test_lost_bytes_do_not_stop_the_rest_of_the_line(model):
    swaps, text = g.judge_line(model, "a", "gr�n und fÃ¼r Ã¼ber schÃ¶n")
    assert text == "gr�n und für über schön" and "lost" in swaps


def test_a_line_in_the_large_chinese_code(model):
    line = "把浇水小路花园土壤秋天是豆子 Größe übersicht 181"
    bad = "".join(chr(b) if 0x80 <= b < 0xA0 else bytes([b]).decode("latin-1") for b in line.encode("gb18030")).translate({b: bytes([b]).decode("cp1252") for b in range(0x82, 0x8D)})
    model = g.Model(dict(model.pairs), {c: 50.0 for c in line if g._IS_HAN.match(c)}, model.usual, model.total, model.may)
    assert g.judge_line(model, "a", bad) == (["cp1252>gbk"], line)


def test_garbled_many_times():
    text = "für"
    for _ in range(6):
        text = text.encode("utf-8").decode("latin-1")
    assert g.undo(text, ("cp1252", "utf-8")) == "für"


def on_page(lang: str, first: int) -> dict[int, str]:
    """A page of no name, as ``permuted``, whose signs are those from ``first`` on."""
    letters = sorted({x for w in WORDS[lang] for c in w if c > "\x7f" for x in (c, c.upper()) if len(x) == 1})
    signs = [chr(first + i) for i in range(len(letters))]
    random.Random(first).shuffle(signs)
    return str.maketrans(dict(zip(letters, signs)))


def with_pages(sizes: dict[str | None, int]) -> tuple[list, dict]:
    """A corpus with documents of a page of its own for each source; rows, and by source what was written."""
    rng = random.Random(21)
    rows, _, _ = corpus(rng, 500)
    truth: dict = {s: {} for s in sizes}
    for k, (source, n) in enumerate(sizes.items()):
        for i in range(n):
            doc = 10_000 * (k + 1) + i
            truth[source][doc] = " ".join(rng.choices(WORDS["ru"], k=20))
            rows.append((doc, truth[source][doc].translate(on_page("ru", 0x100 + 0x50 * k)), source, ""))
    return rows, truth


def restored(out: dict, truth: dict) -> float:
    right = [a == b for i in truth for a, b in zip(out[i]["restored"].split(), truth[i].split())]
    return sum(right) / len(right)


def test_a_source_has_its_table_however_much_others_have(spark):
    rows, truth = with_pages({"much": 900, "little": 8})
    out = {r["doc_id"]: r for r in g.repair(spark.createDataFrame(rows, DOC)).collect()}
    for source in truth:
        assert all(out[i]["swaps"] == ["?>learnt"] for i in truth[source]), source
        assert restored(out, truth[source]) >= 0.9, source


def test_small_parts_of_all_have_tables_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(g, "LEAST_SOURCE", 0.05)
    rows, truth = with_pages({"little": 20, "as little": 20, None: 20})
    rows += [(90_000 + i, r[1], "clean and little", "") for i, r in enumerate(rows[1:12])]
    out = {r["doc_id"]: r for r in g.repair(spark.createDataFrame(rows, DOC)).collect()}
    for source in truth:
        assert all(out[i]["swaps"] == ["?>learnt"] for i in truth[source]), source
        assert restored(out, truth[source]) >= 0.9, source
    assert not any(r["garbled"] for i, r in out.items() if i >= 90_000)


def test_tables_are_the_same_in_one_task_and_in_rounds_of_few(spark, monkeypatch):
    rows, _ = with_pages({"one": 60, None: 50, "three": 40})
    documents = spark.createDataFrame(rows, DOC)
    found = []
    for group, at_once in ((10**9, 1), (0, 2)):
        monkeypatch.setattr(g, "FREE_GROUP", group)
        monkeypatch.setattr(g, "FREE_AT_ONCE", at_once)
        found.append({s: t for (s, swap), t in g.learn(documents).tables.items() if swap == g.FREE})
    assert found[0].keys() == {"one", g.NULL, "three"} and found[0] == found[1]


def test_a_script_of_which_there_is_too_little_has_no_letters():
    chain = g.Chain({}, lambda a, b: -1.0)
    assert chain.letters == [] and chain.start({"ü": 9.0})["ü"].size == 0
