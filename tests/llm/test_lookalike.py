import itertools
import random
import unicodedata

import pytest

from plumbline.llm import lookalike as X


@pytest.mark.parametrize(
    ("a", "b"),
    [("сор", "cop"), ("ｆｕｌｌ，１", "full,1"), ("café", "café"), ("ﬁnd ﬂat", "find flat"), ("a b c　d", "a b c d"), ("so­ft​⁠﻿", "soft"), ("ё", "ë"), ("q̣̇", "q̣̇"), ("ệ", "ệ"), ("ΑΒΕ ο", "ABE o"), ("ｶ", "カ"), ("Й", "Й")],
)
def test_reads_the_same(a, b):
    x, y = X.normalise_all([a, b])
    assert x == y and X.readable(x) == X.readable(y)


@pytest.mark.parametrize(("a", "b"), [("👩‍🔬", "👩🔬"), ("x²", "x2"), ("①", "1"), ("ø", "o"), ("A", "a"), ("é", "e"), ("❤️", "❤"), ("a\nb", "a b"), ("й", "и"), ("’", "'"), ("один два", "один  дв")])
def test_reads_otherwise(a, b):
    x, y = X.normalise_all([a, b])
    assert x != y


def test_form_is_stable_and_batches_make_no_difference():
    rng = random.Random(2)
    signs = "aeо̣́ёﬁ​ｆ ü 👩‍🔬你，̈E"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(500)]
    forms = X.normalise_all(texts)
    assert forms == [X.normalise_all([t])[0] for t in texts]
    assert X.normalise_all(forms) == forms
    assert [X.normalise_all([unicodedata.normalize("NFD", t)])[0] for t in texts] == [X.normalise_all([unicodedata.normalize("NFC", t)])[0] for t in texts]


def test_readable_words_are_of_one_alphabet():
    assert X.readable(X.normalise_text("Поход cор ｆｕｌｌ")) == "Поход cop full"


def test_edges():
    assert X.normalise_all([None, "", "​", "x" * 200_000]) == [None, "", "", "x" * 200_000]


def hashed(spark, rows):
    return X.forms([(spark.createDataFrame([(i, t, b"clash") for i, t in rows], "id long, body string, raw binary"), "id", "body", "t")])


def brute(rows):
    rows = {(i, t) for i, t in rows if t is not None}
    return {("t", min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(sorted(rows), 2) if i != j and a != b and X.normalise_text(a) == X.normalise_text(b)}


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = ["cop", "сор", "ｃｏｐ", "c​op", "dog", "ⅾog", "café", "café", "", "​"]
    rows = [(n, rng.choice(words) + rng.choice(["", " x", " x"])) for n in range(60)] + [(99, None), (1, "other")]
    rows += rows[:5]
    assert {tuple(r) for r in X.pairs(hashed(spark, rows)).collect()} == brute(rows)


def test_many_copies_of_one_variant(spark):
    rows = [(n, "cop") for n in range(2000)] + [(5000, "сор")]
    assert X.pairs(hashed(spark, rows)).count() == 2000


def test_nothing_to_pair(spark):
    assert X.pairs(hashed(spark, [])).count() == 0 and X.pairs(hashed(spark, [(1, "a"), (2, "a"), (3, None)])).count() == 0


def test_normalise_column(spark):
    df = spark.createDataFrame([(1, "ｆｕ x", "old"), (2, None, "old")], "id int, text string, normal_text string")
    assert [(r.id, r.normal_text) for r in X.normalise(df, "text").collect()] == [(1, "fu x"), (2, None)]


def test_forms_of_every_text_of_all_tables(spark, sf):
    from plumbline.llm import queries

    forms = queries.p3_forms(spark, sf).cache()
    assert forms.count() == forms.select("table_name", "rec_id").distinct().count()
    for name, key, text in (("citations", "citation_id", "cited_text"), ("answers", "answer_id", "answer_text"), ("documents", "doc_id", "text")):
        texts = spark.read.parquet(f"{sf}/{name}.parquet").where(f"{text} is not null").select(key, text).distinct().collect()
        got = {r.rec_id: r.normal_text for r in forms.where(forms.table_name == name).collect()}
        assert got == {r[0]: X.readable(X.normalise_text(r[1])) for r in texts}
    form = {(r.table_name, r.rec_id): r.normal_text for r in forms.collect()}
    for r in queries.p3_found(spark, sf).collect():
        assert form[r.table_name, r.rec_a] == form[r.table_name, r.rec_b]


def test_classes(spark):
    rows = [(1, "ab c"), (2, "ａb c"), (3, "ab c"), (3, "ab c"), (4, "other"), (5, None), (6, "a​b c")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.rec_id: (r.class_id, r.n_records, r.n_variants, r.n_links) for r in X.classes(X.forms([(df, "id", "t", "x")])).collect()}
    assert got == {1: (1, 4, 3, 2), 2: (1, 4, 3, 3), 3: (1, 4, 3, 2), 6: (1, 4, 3, 3), 4: (4, 1, 1, 0)}
