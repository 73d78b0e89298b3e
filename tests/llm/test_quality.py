import pickle
import random

import pytest

from plumbline.llm import quality as Q

COMMON = frozenset("the a and of in it is was with for to by from".split())
PROSE = "The quiet kettle was tested in the town, and it is good. It was sold for a low price by the shop in the north of the land. "


def kind(t):
    return Q.judge(t, "en", COMMON, frozenset("的了在"))["text_kind"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (PROSE * 3, "prose"), (PROSE.upper(), "prose"), ("Short one.", "prose"), ("", "prose"), (" \n ", "prose"), (PROSE * 2 + "\n- one\n- two\n- three\n" + PROSE * 2, "prose"),
        ("\n".join(PROSE[i : i + 60] for i in range(0, 120, 60)) + "\n" + PROSE, "prose"),
        ("Heading of it\n- one\n- two\n- three", "list"), ("It was sold in the town.\n1. one\n2. two\n3. three\n4. four", "list"), ("a) x\nb) y\nc) z", "list"), ("Brosk sleeping bag\nmixer (5428)\nSio – plain\nKluv tool chest\nwork glove (12)", "list"),
        ("| a | b | c |\n|---|---|---|\n| d | e | f |", "table"), ("a\tb\tc\nd\te\tf", "table"), ("12;lamp;3.5;no\n13;desk;4.5;yes", "table"), ('1.5,yes,"A & Co",Town\n2.5,no,B,City', "table"), ("Title of it: 5\nkettle      13.00     yes\nlamp        7.00      no\ndesk lamp   9.10      no", "table"),
        ("Home » Login » Brosk 12 » FAQ » " * 10, "junk"), ("var a1=b[2];if(!c){d(3)}\n" * 5, "junk"), ("li.x{width:3px;color:#fff}\n" * 6, "junk"), ("td.kluv{width:290px;color:#aa9463;margin:63 32}\n" * 4, "junk"), ("Kluv desk lamp 1234 " * 40, "junk"), ("qwzx bvnk " + " ".join(random.Random(1).choice(["xkcd", "zzv", "qpr", "wvn", "bnm"]) + str(i) for i in range(60)), "junk"),
        ("\n".join("aB3/" * 15 for _ in range(5)), "junk"), ("&.-x/(c_^ =<;3@[.^?#[/} ^954,>]x1>=-@ 24;b|* a~z?{b x?<(|>.~>", "junk"),
    ],
)
def test_kinds(text, expected):
    assert kind(text) == expected


def test_statistics():
    r = Q.judge("The cat sat.\nIt is 5.", "en", COMMON, frozenset())
    assert (r["n_words"], r["n_lines"], r["terminal_line_share"], r["sentences"]) == (5, 2, 1.0, 2)
    assert r["mean_word_length"] == 2.6 and r["common_word_share"] == 0.6


def texts():
    rng = random.Random(3)
    parts = [PROSE, "- entry one\n", "| a | b | c |\n", "\n\n", "a;b;c;d\n", "x" * 70 + "\n", "你好的世界。", "Home » ", "\t", "a\tb \tc\n", "k   v   w\n", "  \n ", "one, two,three,", "a{b;c;d}\n", "x;{y", "z;w}\n", "3. ", " (12) tail", "e\u0301 ", "Kluv lamp Kluv lamp "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(150)]


def test_chunks_merge_to_the_whole_in_any_order():
    chars = frozenset("的")
    for t in [*texts(), "no end " * 500, "x" * 500, " " * 90 + "- a" + " " * 90, "|" + " a |" * 80]:
        whole = Q.count(t, COMMON, chars)
        assert whole["chars"] == len(t)
        for size in (1, 7, 40, 200):
            cut = list(Q.chunks(t, size))
            assert "".join(cut) == t
            parts = [Q.partial(c, COMMON, chars) for c in cut]
            left = parts[0]
            for p in parts[1:]:
                left = Q.merge(left, p)
            tree = parts
            while len(tree) > 1:
                tree = [Q.merge(*tree[i : i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
            assert Q.close(left) == whole and Q.close(tree[0]) == whole, (t, size)


def test_states_stay_small_without_line_ends():
    text = "word another " * 200_000
    parts = [Q.partial(c, COMMON, frozenset()) for c in Q.chunks(text)]
    state = parts[0]
    for p in parts[1:]:
        state = Q.merge(state, p)
    assert len(parts) > 50 and len(pickle.dumps(state)) < 5_000
    assert Q.close(state) == Q.count(text, COMMON, frozenset())


def test_spark_with_chunks(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(texts())] + [(1000, None, None, "x"), (1001, "", "en", None), (1002, PROSE * 2000, "en", "y"), (1003, "café " * 40_000, "fr", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, text_kind string")
    common = spark.createDataFrame([("en", w) for w in COMMON], "lang string, word string")
    whole = {r.doc_id: r for r in Q.statistics(docs, common).collect()}
    cut = {r.doc_id: r for r in Q.statistics(docs, common, chunk=64).collect()}
    assert len(whole) == len(cut) == len(rows) and whole == cut
    assert whole[1000].text_kind is None and whole[1001].text_kind == "prose" and whole[1002].text_kind == "prose"
    assert all(whole[i].n_chars == len(t) for i, t, *_ in rows if t is not None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    common = spark.createDataFrame([], "lang string, word string")
    assert Q.found(docs, common).count() == 0


def test_long_garbled_text_is_restored_as_a_short_one(spark, sf):
    from plumbline.llm import mojibake

    docs, words = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/common_words.parquet")
    model = mojibake.fit(docs, rows=2000)
    # a Chinese page read as latin-1
    clean = [r.text for r in docs.where("lang = 'zh' and doc_type is not null").select("text").orderBy("doc_id").collect() if len(r.text) > 80][:12]
    text = "\n".join(clean).encode("utf-8").decode("latin-1")
    rows = spark.createDataFrame([(1, text, "zh")], "doc_id long, text string, lang string")
    kinds = [[r.text_kind for r in Q.statistics(rows, words, model, chunk=c).collect()] for c in (len(text), len(text) // 4)]
    assert [r.text_kind for r in Q.statistics(rows, words).collect()] == ["junk"]
    assert kinds == [["prose"], ["prose"]]


def test_the_query_restores_with_the_model_of_every_text(spark, tmp_path, monkeypatch):
    from plumbline.llm import mojibake, queries

    rows = [(i, f"Der Kessel {i} war gut" + " ő" * (i in (5, 2900)) + " ü" * (i % 900 == 0), "de") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("de", "der")], "lang string, word string").write.parquet(f"{tmp_path}/common_words.parquet")
    given = []
    for name in ("found", "statistics"):
        monkeypatch.setattr(Q, name, lambda docs, words, model: given.append(model))
    queries.p9_found(spark, str(tmp_path))
    queries.p9_statistics(spark, str(tmp_path))
    model = mojibake.train([(lang, t) for _, t, lang in rows])
    assert model.alphabets["de"] == {"ü", "Ü"}  # three in 3,000 texts show it, and two the other
    assert [(m.alphabets, m.dictionaries) for m in given] == [(model.alphabets, model.dictionaries)] * 2


def test_sums_are_those_of_the_plain_patterns():
    rng = random.Random(5)
    for i in range(3000):
        t = "".join(rng.choice("aé.!?…。！ ”»“\"’')*\n\t的_-{;あ😀\x1c\x85\xa0 xX1٣") for _ in range(rng.randrange(14))) + "x" * rng.choice((0, 24, 30))
        c, words = Q._sums(t, frozenset("a"), frozenset("的"))
        han = Q.HAN.findall(t)
        assert words == Q.WORD.findall(t.lower()) and c["common"] == words.count("a") + han.count("的") and c["han"] == len(han)
        assert [c[k] for k in ("sentences", "symbols", "ascii_symbols", "noise")] == [len(p.findall(t)) for p in (Q.SENTENCE, Q.SYMBOL, Q.ASCII_SYMBOL, Q.NOISE)], t
        assert c["long_chars"] == sum(len(x) for x in t.split() if len(x) >= 26 and not Q.HAN.search(x)) and c["non_ascii"] == sum(x > "\x7f" for x in t)
