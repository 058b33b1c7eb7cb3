import random

import pytest

from storyloom.llm import encoding as X

CLEAN = ["My fiancée’s résumé said “naïve” — über.", "Estábamos más unidos que nunca, ¿no?", "Die Großmutter pflanzte Bäume für uns.", "L'été où j'ai ramené le chien à l'hôpital.", "Я плакал в машине, и всё стало другим.", "我在车里哭了。一切都变了。", "何もかもが変わりました。", "सब कुछ बदल गया।", "ทุกอย่างเปลี่ยนไป", "شعرت بالفخر بنفسي", "NÃO, IRMÃ, MÃE, ficou escrito.", "À l'école, ÂGE et GRÂCE.", "It’s 20 °C and £4, about ½."]


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    return X.train([" ".join(r.sample(CLEAN, 2)) for _ in range(150)])


def test_clean_texts_stay(model):
    for t in CLEAN:
        assert X.diagnose(t, model) is None, t


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1250", "utf-8>cp1251", "utf-8>mac-roman", "utf-8>cp437", "utf-8>cp1252 x2", "utf-8>latin-1 x2"])
def test_round_trip(model, chain):
    for t in CLEAN[:4]:
        bad = X.garble(t, chain)
        assert X.diagnose(bad, model)[1] == t
        # in one place only
        part = "Wholly clean here. " + bad
        assert X.diagnose(part, model)[1] == "Wholly clean here. " + t


def test_cyrillic_and_wide(model):
    assert X.diagnose(X.garble(CLEAN[4], "koi8-r>cp1251"), model)[1] == CLEAN[4]
    assert X.diagnose(X.garble("我在车里哭了", "utf-8>gb18030"), model)[1] == "我在车里哭了"


def test_lost_bytes_are_reported(model):
    chain, text = X.diagnose("It was d�j� vu", model)
    assert chain == "lost" and text == "It was d�j� vu"


def test_table(spark):
    rows = [(i, c, "z") for i, c in enumerate(CLEAN)] + [(100, X.garble(CLEAN[0], "utf-8>cp1252"), "z")] * 2 + [(101, None, "z"), (None, "Ã©", "z"), (102, "", "z"), (103, "plain", "z"), (104, X.garble("é " * 50_000, "utf-8>cp1252"), "z")]
    df = spark.createDataFrame(rows, "id long, text string, r string")
    got = {r.rec_id: r for r in X.garbled(df, "id", "text").collect()}
    assert set(got) == {100, 104} and got[100].restored == CLEAN[0] and got[104].restored == "é " * 50_000
    assert X.garbled(df.where("false"), "id", "text").count() == 0


def test_nothing_is_dropped_before_the_classifier(spark):
    bad = ["Quando eu tinha 26 anos, minha avГі perdeu o emprego.", "mi mejor amigo me llevГі al hospital.", "mi tío pagГі todo el viaje", "й ЧПФ НПК ДЕДХЫЛБ РПФЕТСМ ТБВПФХ ОБ НЕМШОЙГЕ! "]
    good = ["El niño soñó con mañana.", "Wir aßen süße Äpfel.", "A emoção também é memória, não é?"]
    df = spark.createDataFrame(list(enumerate(bad + good + CLEAN * 8)), "id long, text string")
    got = {r.rec_id: r.restored for r in X.garbled(df, "id", "text").collect()}
    assert set(got) == {0, 1, 2, 3} and got[0] == "Quando eu tinha 26 anos, minha avó perdeu o emprego."


@pytest.mark.parametrize("chain", X.CHAINS[1:])
def test_the_quick_test_misses_nothing_a_chain_can_invert(chain):
    for t in CLEAN:
        bad = X.garble(t, chain)
        assert X.invertible(bad) or not X.invert(bad, chain)[1]
        assert X.invertible(t) or not any(X.invert(t, c)[1] for c in X.CHAINS)


@pytest.mark.parametrize("chain", sorted(X.LATIN_CHAINS))
def test_one_byte_latin_chains_are_restored(model, chain):
    for t in ["L'été où j'ai ramené le chien.", "Estábamos más unidos"]:
        bad = X.garble(t, chain)
        if bad != t:
            assert X.diagnose(bad, model) == (chain, t)
    if chain in ("cp1252>mac-roman", "cp1252>cp437", "cp1252>cp1251"):
        assert X.diagnose(X.garble("Hier, l'été.", chain), model) == (chain, "Hier, l'été.")


def test_the_classifier_decides(model):
    import numpy as np

    bad = [X.garble(t, c) for c in ("utf-8>cp1252", "utf-8>cp1251", "utf-8>mac-roman", "utf-8>cp1252 x2", "cp1252>mac-roman") for t in CLEAN[:4]] + [X.garble(CLEAN[4], c) for c in ("koi8-r>cp1251", "cp1251>cp1252")]
    restored = lambda m: sum((X.diagnose(b, m) or ("", ""))[1] in CLEAN for b in bad)
    nothing = X.Model(np.zeros_like(model.weights), model.seen)
    turned = X.Model(np.roll(model.weights, 7, axis=0), model.seen)
    assert restored(model) >= 0.9 * len(bad) and restored(nothing) == 0 and restored(turned) <= 0.8 * len(bad)


def test_every_garbled_sentence_is_restored(model):
    parts = [(t, c) for t in CLEAN[:3] for c in ("utf-8>cp1252", "utf-8>mac-roman", "utf-8>cp1251", "utf-8>cp437", "utf-8>latin-1")]
    text = " ".join(X.garble(t, c) for t, c in parts)
    assert X.diagnose(text, model)[1] == " ".join(t for t, _ in parts)


def test_runs_that_recur_are_looked_at_once(model, monkeypatch):
    bad = X.garble("Estábamos más unidos", "utf-8>cp1252")
    seen, hashed = [], X._hashed
    monkeypatch.setattr(X, "_hashed", lambda raw: seen.append(raw) or hashed(raw))
    first = X.diagnose(bad, model)
    once = len(seen)
    assert all(X.diagnose(bad, model) == first for _ in range(20)) and len(seen) == once
    # kept or not, results are those of the plain computation
    runs = X._around(bad)
    assert all((model.of_run(r) == model.weights[:, hashed(r.encode())].sum(axis=1)).all() for r in runs)
    long = "é" * (X.SHORT + 1)
    model.of_run(long)
    assert long not in model.kept


def test_grams_are_those_of_the_plain_definition():
    text = "é1é aé;éb\né\u2028é Zé…é中é' x"
    t = "".join(" " if c.isascii() and not c.isalpha() else c for c in f" {text} ")
    plain = [t[i - 1 : i + 2] for i, c in enumerate(t) if not c.isascii() and any(x.isascii() and x.isalpha() for x in t[i - 1 : i + 2])]
    assert X.grams(text) == plain and plain
