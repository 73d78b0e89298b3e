import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import overlap as X


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def brute(rows, least):
    grams = {i: {t[k : k + least] for k in range(len(t) - least + 1)} for i, t in rows.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(rows), 2) if grams[a] & grams[b]}


def corpus(seed):
    rng = random.Random(seed)
    rows = {i: words(rng, rng.randrange(5, 160)) for i in range(60)}
    for i in range(60, 150):
        source = rows[rng.randrange(60)]
        n = rng.choice([120, 190, 199, 200, 201, 230, 400])
        at = rng.randrange(max(1, len(source) - n))
        rows[i] = words(rng, rng.randrange(0, 40)) + source[at : at + n] + words(rng, rng.randrange(0, 40))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in (rows.items() if isinstance(rows, dict) else rows)], "id long, body string, a int")


@pytest.mark.parametrize("hot", [X.HOT, 1])
def test_pairs_against_brute_force(spark, hot):
    rows = corpus(5)
    got = {tuple(r) for r in X.pairs(frame(spark, rows), "id", "body", 200, hot).collect()}
    assert got == brute(rows, 200)


@pytest.mark.parametrize("hot", [X.HOT, 1])
def test_a_passage_that_stands_twice(spark, hot):
    rng, rows = random.Random(34), {}
    for i, n in enumerate([150, 160, 170, 180, 190, 196] * 8):
        s, rest = words(rng, 80)[:n], 201 - n
        span = words(rng, 30)[: rest // 2] + s + words(rng, 30)[: rest - rest // 2]
        rows |= {2 * i: words(rng, 20) + "#" + s + "#" + words(rng, 20) + "#" + span + "#" + words(rng, 20), 2 * i + 1: words(rng, 20) + "+" + span + "+" + words(rng, 20)}
    want = {(2 * i, 2 * i + 1) for i in range(48)}
    assert brute(rows, 200) == want
    assert {tuple(r) for r in X.pairs(frame(spark, rows), "id", "body", 200, hot).collect()} == want


def test_endless_repetition_gives_few_runs():
    t = "abc " * 20_000
    assert len(X.Hashed(t).runs(X.np.array([len(t)]), 200)[0]) < 1000


def test_boilerplate_below_the_least_length_gives_no_pairs(spark):
    rng = random.Random(8)
    footer = words(rng, 60)[:190]
    rows = {i: words(rng, 40) + "\n" + footer for i in range(150)}
    assert X.pairs(frame(spark, rows), "id", "body").count() == 0
    long = {i: words(rng, 40) + "\n" + footer + "#" * 15 for i in range(60)}
    assert X.pairs(frame(spark, long), "id", "body").count() == 60 * 59 // 2


def test_many_copies_and_a_shared_span(spark):
    rng = random.Random(21)
    copy, footer = words(rng, 200), words(rng, 80)[:260]
    rows = {i: copy for i in range(120)} | {i: words(rng, 30) + footer + words(rng, 30) for i in range(200, 290)} | {i: words(rng, 20) + footer[:220] for i in range(300, 340)} | {400: words(rng, 60), 401: copy + footer}
    assert {tuple(r) for r in X.pairs(frame(spark, rows), "id", "body").collect()} == brute(rows, 200)


def test_repeats_nulls_and_short_texts(spark):
    rng = random.Random(9)
    t = words(rng, 60)
    rows = [(1, t), (1, t), (2, t + t), (3, None), (4, ""), (5, t[:150]), (None, t)]
    assert {tuple(r) for r in X.pairs(frame(spark, rows), "id", "body").collect()} == {(1, 2)}
    assert X.pairs(frame(spark, []), "id", "body").count() == 0
    assert X.pairs(frame(spark, [(1, (t + " ") * 20)]), "id", "body").count() == 0


def test_low_entropy_texts(spark):
    rows = [(1, "a" * 500), (2, "b" + "a" * 300), (3, "ab" * 200), (4, "你好，" * 100), (5, "x" + "你好，" * 90)]
    assert {tuple(r) for r in X.pairs(frame(spark, rows), "id", "body").collect()} == {(1, 2), (4, 5)}


def test_very_long_texts(spark):
    rng = random.Random(10)
    a, b = words(rng, 30_000), words(rng, 30_000)
    rows = [(1, a), (2, b[:90_000] + a[70_000:70_200] + b[90_000:])]
    assert X.pairs(frame(spark, rows), "id", "body").count() == 1


def test_hashes_of_substrings():
    rng = random.Random(12)
    t = words(rng, 50)
    h = X.Hashed(t + "🙂" + t)
    at = X.np.arange(len(t) - 30)
    assert (h.of(at, at + 30) == h.of(at + len(t) + 1, at + len(t) + 31)).all() and len(set(h.of(at, at + 30).tolist())) == len(at)


def test_shares_and_cleaning(spark):
    rng = random.Random(13)
    shared, rest = words(rng, 200), words(rng, 200)
    rows = [(1, shared), (2, rest + shared), (3, words(rng, 100))]
    s = {r.rec: r.shared_share for r in X.shares(frame(spark, rows), "id", "body").collect()}
    assert s[1] > 0.85 and 0.4 < s[2] < 0.6 and s[3] == 0.0
    c = {r.rec: r.text for r in X.cleaned(frame(spark, rows), "id", "body").collect()}
    assert c[1] == shared and c[3] == rows[2][1] and rest in c[2][: len(rest) + 1] and len(c[2]) < len(rest) + 0.15 * len(shared)


@pytest.mark.parametrize("hot", [X.HOT, 2, 1])
def test_shares_and_cleaning_against_brute_force(spark, hot):
    rng = random.Random(17)
    rows = dict(list(corpus(5).items())[40:110])
    span, sentence = words(rng, 60)[:200], words(rng, 20)[:80]
    rows |= {200: words(rng, 40) + "#" + span + "#" + words(rng, 9), 201: span + "+" + words(rng, 30) + "+" + span, 202: words(rng, 40) + sentence, 203: sentence + words(rng, 40), 204: rows[41], 205: rows[41], 206: "short", 207: "short"}

    def cover(i, others):
        grams, t = {u[k : k + 200] for u in others for k in range(len(u) - 199)}, rows[i]
        hit = [t[k : k + 200] in grams for k in range(max(0, len(t) - 199))]
        return [any(hit[max(0, k - 199) : k + 1]) for k in range(len(t))]

    s = {r.rec: (r.n_chars, r.shared_chars) for r in X.shares(frame(spark, rows), "id", "body", 200, hot).collect()}
    assert s == {i: (len(t), sum(cover(i, [u for j, u in rows.items() if j != i]))) for i, t in rows.items()}
    assert s[201][1] == 400 and s[202][1] == s[203][1] == 0
    c = {r.rec: r.text for r in X.cleaned(frame(spark, rows), "id", "body", 200, hot).collect()}
    assert c == {i: "".join(x for x, gone in zip(t, cover(i, [u for j, u in rows.items() if j < i]), strict=True) if not gone) for i, t in rows.items()}


def test_spans_that_short_are_refused(spark):
    with pytest.raises(ValueError):
        X.pairs(frame(spark, []).withColumn("x", F.lit(1)), "id", "body", 100)


def test_classes_and_their_pairs(spark):
    rng = random.Random(23)
    span = words(rng, 80)[:230]
    rows = {i: span for i in range(40)} | {50: span + words(rng, 20), 51: words(rng, 20) + span, 60: words(rng, 60), 61: "short"}
    got = {r.rec: (r.class_id, r.n_copies, r.n_links) for r in X.classes(frame(spark, rows), "id", "body").collect()}
    assert got == {i: (0, 40, 2) for i in range(40)} | {50: (50, 1, 2), 51: (51, 1, 2), 60: (60, 1, 0)}
    assert {tuple(r) for r in X.class_pairs(frame(spark, rows), "id", "body").collect()} == {(0, 50), (0, 51), (50, 51)}
    assert X.classes(frame(spark, []), "id", "body").count() == X.class_pairs(frame(spark, []), "id", "body").count() == X.shares(frame(spark, []), "id", "body").count() == X.cleaned(frame(spark, []), "id", "body").count() == 0
