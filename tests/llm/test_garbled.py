from __future__ import annotations

import random

import pytest

from notefold.llm import garbled as g

WORDS = {
    "de": "über schön Straße Gemüse für prüfen löschen Äpfel müde grün Tür Küche größer Möhren Übersicht Schlüssel das ist nicht ein und der".split(),
    "fr": "été déjà forêt hôtel café crème leçon garçon bientôt où être même gelée répéter préparer le la une dans avec".split(),
    "es": "año niño mañana estación razón difícil también pingüino señal corazón jardín búsqueda el la de que para".split(),
    "ru": "вода хлеб зима осень решение страница заметка список проверка морковь дорога грядка задача сделать можно нужно на и в это как".split(),
    "pl": "już śnieg książka łyżka gęś źródło ogród światło kość późno ćwiczenie się na nie to jest".split(),
}
SWAPS = [("de", "cp1252", "utf-8"), ("fr", "cp437", "utf-8"), ("es", "mac_roman", "utf-8"), ("ru", "cp1252", "cp1251"), ("ru", "cp1251", "koi8_r"), ("ru", "koi8_r", "cp1251"), ("pl", "cp1252", "utf-8"), ("fr", "cp437", "cp1252"), ("de", "mac_roman", "cp1252")]


def read_wrongly(text: str, read: str, written: str) -> str:
    out = []
    for b in text.encode(written):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def corpus(rng, n=900):
    rows, truth, originals = [], set(), {}
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = "\n".join(" ".join(rng.choices(WORDS[lang], k=12)) for _ in range(3))
        originals[i] = text
        if i % 12 == 0:
            lang, read, written = SWAPS[(i // 12) % len(SWAPS)]
            text = " ".join(rng.choices(WORDS[lang], k=30))
            originals[i] = text
            text = read_wrongly(text, read, written)
            truth.add(i)
        rows.append((i, text, rng.choice(["a", "b", None]), "clash"))
    return rows, truth, originals


DOC = "doc_id LONG, text STRING, source STRING, restored STRING"


def test_finds_and_restores(spark):
    rng = random.Random(7)
    rows, truth, originals = corpus(rng)
    rows += [(1000, None, "a", ""), (1001, "", "a", ""), (1002, "plain ascii", "a", ""), (1003, "das ist f�r", "b", ""), (1004, "it’s ½ cup · 20 °C", "a", ""), (1005, "STRASSE ÜBER GRÜN", "a", ""), (1006, rows[0][1], "a", "")]
    out = {r["doc_id"]: r for r in g.repair(spark.createDataFrame(rows, DOC)).collect()}
    assert len(out) == len(rows)
    found = {i for i, r in out.items() if r["garbled"]}
    want = truth | {1003, 1006}
    assert len(found & want) / len(want) >= 0.97 and len(found - want) <= 2, (want - found, found - want)
    same = [out[i]["restored"] == originals[i] for i in truth if i in found]
    assert sum(same) / len(same) >= 0.9
    assert out[1000]["restored"] is None and out[1001]["restored"] == "" and out[1003]["swaps"] == ["lost"]
    assert all(out[i]["restored"] == originals[i] for i in originals if i not in found)


def test_a_garbled_word_in_a_clean_text(spark):
    rng = random.Random(9)
    rows, _, _ = corpus(rng, 600)
    rows.append((2000, "das ist nicht fÃ¼r die über Straße und Tür", "a", ""))
    rows.append((2001, "le hÃ´tel de ville", "b", ""))
    out = {r["doc_id"]: r for r in g.repair(spark.createDataFrame(rows, DOC)).collect()}
    assert out[2000]["restored"] == "das ist nicht für die über Straße und Tür"
    assert out[2001]["restored"] == "le hôtel de ville"


@pytest.mark.parametrize("text", ["Ã¼", "ÃƒÂ¼", "plain", "üÃ¼“x”", "ГѓВј"])
def test_byte_groups_leave_the_rest_alone(text):
    back = g.undo(text, ("cp1252", "utf-8"))
    assert back.startswith("ü") or back in ("plain", text)


def test_a_small_gain_is_enough_where_the_swap_is_usual():
    swap = ("cp1252", "utf-8")
    model = g.Model({}, {}, usual={("a", swap): 1000.0}, total={"a": 2000.0, "b": 2000.0}, may={("a", swap): 1000.0, ("b", swap): 1000.0})
    model._odds[None, "fÃ¼r"] = (1.0, {swap: (1.0, "für")})
    assert model.prior("a", swap) > 2 and model.prior("b", swap) < 0
    assert g.judge_line(model, "a", "fÃ¼r dich") == (["cp1252>utf-8"], "für dich")
    assert g.judge_line(model, "b", "fÃ¼r dich") == ([], "fÃ¼r dich")


def test_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert g.repair(empty).count() == 0
    assert g.repair(spark.createDataFrame([(1, None, None, ""), (2, "ascii only", None, "")], DOC)).where("garbled").count() == 0
