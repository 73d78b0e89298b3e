import random

import pytest

from plumbline.llm import mojibake as M

SENTENCES = {
    "en": ["The café tables in the old town were tested with a résumé of results.", "It isn’t the cheapest name, yet its quiet kettle costs €40 at 20 °C — nothing failed."],
    "fr": ["Près de cent acheteurs ont répondu ; l’équipe a été très généreuse à propos du délai.", "À Paris, la bouilloire a été jugée légère, malgré le gel, pour les journées fraîches."],
    "de": ["Für späte Lieferungen erhielt das Modell genau hundert Punkte und gilt als müde.", "„Das ist groß genug“, hieß es über die äußere Dichtung während der Prüfung."],
    "ru": ["Компания отправляет товар из города за пять дней, и обзор назвал его дорогим.", "Стоит ли брать чайник вместо мельницы для сырой зимы? Опрос дал сто ответов."],
    "zh": ["我们在城里询问了保修条款的情况，涨价之前共有很多位买家回复。", "如果看重配送时间，榜单把它排在第三名，后面是别的台灯。"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(lang, " ".join(rng.choice(s) for _ in range(4))) for lang, s in SENTENCES.items() for _ in range(60)]
    return M.train(rows)


def garble(text, true, wrong):
    return text.encode(true, "ignore").decode(wrong, "replace")


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_sound_text_stays(model, lang):
    for s in SENTENCES[lang]:
        for text in (s, s.upper(), s.lower(), s[: len(s) // 2]):
            for given in (lang, None):
                assert M.inspect(text, given, model) == (text, "", False)


@pytest.mark.parametrize(("lang", "true", "wrong"), [("en", "utf-8", "latin-1"), ("fr", "utf-8", "latin-1"), ("de", "utf-8", "mac_roman"), ("fr", "utf-8", "cp850"), ("de", "utf-8", "cp437"), ("ru", "utf-8", "latin-1"), ("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "cp1251"), ("zh", "utf-8", "latin-1"), ("zh", "gb18030", "latin-1")])
@pytest.mark.parametrize("given", [True, False])
def test_round_trip(model, lang, true, wrong, given):
    for s in SENTENCES[lang]:
        s = s.encode(true, "ignore").decode(true)
        text = garble(s, true, wrong)
        restored, chain, garbled = M.inspect(text, lang if given else None, model)
        assert garbled and restored == s and chain


def test_two_layers_and_one_character(model):
    s = SENTENCES["fr"][0]
    twice = garble(garble(s, "utf-8", "latin-1"), "utf-8", "latin-1")
    assert M.inspect(twice, "fr", model)[0] == s
    for c in "éè":
        assert M.inspect(s.replace(c, garble(c, "utf-8", "cp1252"), 1), "fr", model)[0] == s


def test_lost_bytes_are_found(model):
    text, _, garbled = M.inspect("Une journ�e de plus", "fr", model)
    assert garbled and text == "Une journ�e de plus"
    assert M.inspect(garble(SENTENCES["zh"][0], "utf-8", "gbk"), "zh", model)[2]


@pytest.mark.parametrize("text", ["naïve", "model ²24.6", "45①9", "👨‍🍳", "año → añø", "ﬁne print", "Ｆｕｌｌ", "x​y", "№ 5"])
def test_other_foreign_signs_are_no_case(model, text):
    assert not M.inspect(f"The old kettle {text} was tested in the town.", "en", model)[2]


def test_edges(model):
    assert M.inspect(None, "en", model) == (None, "", False)
    assert M.inspect("", None, model) == ("", "", False)
    assert M.inspect("plain ascii" * 10_000, "en", model)[2] is False
    long = (SENTENCES["de"][0] + " ") * 3000
    assert M.inspect(garble(long, "utf-8", "latin-1"), "de", model)[0] == long
    empty = M.train([])
    assert M.inspect("cafÃ© was tested", None, empty)[2] and not M.inspect("plain", None, empty)[2]


def test_repair_keeps_rows_and_clashing_names(spark, model):
    rows = [(1, "cafÃ© tables in the old town", "en", "mine"), (1, "cafÃ© tables in the old town", "en", "mine"), (2, None, None, "x"), (3, "", "en", None)]
    df = spark.createDataFrame(rows, "id int, text string, lang string, chain string")
    out = M.repair(df, model, "text", "lang").collect()
    assert [(r.id, r.chain, r.garbled) for r in out] == [(1, "mine", True), (1, "mine", True), (2, "x", False), (3, None, False)]
    assert out[0].restored_text == "café tables in the old town" and out[0]._chain == "cp1252>utf-8"


def test_fit_on_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert M.judge(df, M.fit(df), "text", "lang", "doc_id").count() == 0


def test_letters_that_no_sample_shows_pay_their_price(model):
    for garbled, sound in (("Das Hotel in GyÅ‘r war gut und der Preis auch.", "Győr"), ("Die Stadt ÅÃ³dÅº ist in der Liste.", "ódź")):
        restored, chain, found = M.inspect(garbled, "de", model)
        assert found and sound in restored and chain
    # a Cyrillic letter that looks like a Latin one, before a blank that doesn't break, is no garbled text
    assert M.inspect("Diе\xa0Stadt istа\xa0in der Liste.", "de", model)[2] is False


def test_fit_counts_every_text_to_its_end(spark):
    long = "ő " + "der Kessel war gut " * 8000 + "ű"
    rows = [(0, long, "de"), (1, long, "de")] + [(i, f"Der Kessel {i} war gut.", "de") for i in range(2, 1000)]
    model = M.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"ő", "ű"} <= model.alphabets["de"]


def test_fit_is_the_model_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(lang, f"{rng.choice(s)} {i} {rng.choice(s)}") for i in range(1000) for lang, s in SENTENCES.items()]
    rows += [("fr", garble(rng.choice(SENTENCES["fr"]), "utf-8", "latin-1")) for _ in range(20)] + [("ru", garble(rng.choice(SENTENCES["ru"]), "koi8_r", "cp1251")) for _ in range(12)] + [("it", "Così è più facile.")]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)] + [(-1, None, "en"), (-2, "sans étiquette", None), (-3, "", "fr")], "doc_id long, text string, lang string")
    one, all_ = M.fit(df.repartition(7)), M.train(rows)
    assert (one.alphabets, one.words, one.dictionaries) == (all_.alphabets, all_.words, all_.dictionaries)
    assert "сто" in one.words["ru"] and not one.alphabets["fr"] & set("Ã©") and "ì" in one.alphabets["it"]


def test_a_letter_is_known_by_its_share_of_all_texts(spark):
    rows = [(i, f"Der Kessel {i} war gut" + " ő" * (i % 1000 == 0) + " ű" * (i % 1000 == 7 and i > 1000), "de") for i in range(6000)]
    model = M.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "ő" in model.alphabets["de"] and "ű" not in model.alphabets["de"]


def test_counts_handed_on_in_parts_are_the_same(spark):
    rows = [(lang, s * k) for lang, ss in SENTENCES.items() for s in ss for k in range(1, 9) if M._sound(s * k)]
    whole = M.Counts()
    for lang, t in rows:
        whole.add(lang, t)
    parts = M._counted(spark.createDataFrame(rows, "lang string, text string"), True, flush=20).collect()
    summed: dict = {}
    for *key, n in map(tuple, parts):
        summed[tuple(key)] = summed.get(tuple(key), 0) + n
    assert len(parts) > len(summed) and summed == {(lang, kind, item): n for lang, kind, item, n in whole.rows()}
