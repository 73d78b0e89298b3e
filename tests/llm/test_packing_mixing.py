import random
from collections import Counter

import pytest

from plumbline.llm import mixing, packing, ranking, tokens


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 512])
    histogram = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 600)))
    used = Counter()
    bins = 0
    for lengths, times in packing.plan(histogram, capacity):
        assert times > 0 and sum(lengths) <= capacity
        for x in lengths:
            used[x] += times
        bins += times
    assert used == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    assert bins <= max(least + 2, 1.1 * least + 1) or max(histogram) * 2 > capacity


def test_exact_complements():
    assert packing.plan({7: 1, 3: 1}, 10) == [((7, 3), 1)]
    assert packing.plan({6: 1, 3: 1, 1: 1}, 10) == [((6, 3, 1), 1)]
    assert packing.plan({5: 4}, 10) == [((5, 5), 2)]
    assert packing.plan({}, 10) == []


@pytest.mark.parametrize("seed", range(20))
def test_sums_name_every_pair_and_triple(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 61, 64, 65, 300])
    there = packing.np.zeros(size + 1, bool)
    there[[rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 80))]] = True
    sums, have = packing.Sums(there), packing.np.nonzero(there)[0].tolist()
    two = {a + b for a in have for b in have}
    three = {a + b for a in two for b in have}
    assert {g for g in range(size + 1) if sums.names(g, 2)} == {g for g in two if g <= size}
    assert {g for g in range(size + 1) if sums.names(g, 3)} == {g for g in three if g <= size}
    for g in range(2, size + 1):
        assert sums.thirds(g) == [x for x in reversed(have) if x < g - 1 and g - x in two]


def test_a_triple_of_middle_lengths_is_found():
    # sixty larger third lengths make no exact triple; the one that does is far down
    histogram = {1000: 1, 300: 1, 201: 1, 99: 1} | {400 + 2 * i: 1 for i in range(60)}
    plan = packing.plan(histogram, 1600)
    assert ((1000, 300, 201, 99), 1) in plan


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 3, 50, 99, 100, 101, 350]), "clash") for i in range(400)] + [(7, 50, "again")]
    df = spark.createDataFrame(rows, "id long, n long, place string")
    out = packing.pack(df, "id", "n", {"s": 100, "l": 1000}).collect()
    for name, capacity in (("s", 100), ("l", 1000)):
        mine = [r for r in out if r.pack_name == name]
        assert sum(r.n_tokens for r in mine) == sum(r[1] for r in rows)
        fill, places = Counter(), Counter()
        for r in mine:
            if r.container is not None:
                fill[r.container] += r.n_tokens
                places[r.container, r.place] += 1
        assert max(fill.values()) <= capacity and set(places.values()) == {1} and sorted(fill) == list(range(1, len(fill) + 1))
        pieces = Counter(r.id for r in mine)
        assert all(pieces[i] == max(1, -(-n // capacity)) * (2 if i == 7 else 1) for i, n, _ in rows if i != 7)
        assert sum(1 for r in mine if r.container is None) == sum(1 for r in rows if r[1] == 0)


def test_pack_nothing_and_bad_capacity(spark):
    df = spark.createDataFrame([], "id long, n long")
    assert packing.pack(df, "id", "n", {"s": 10}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", {"s": 0})
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", {"s": packing.MOST_CAPACITY, "t": 1})


def test_fills(spark):
    df = spark.createDataFrame([(1, 6), (2, 4), (3, 5)], "id long, n long")
    f = packing.fills(packing.pack(df, "id", "n", {"s": 10}), {"s": 10})
    assert sorted((r["items"], r.filled, r.room) for r in f.collect()) == [(1, 5, 5), (2, 10, 0)]
    assert packing.summary(f).first().fill_share == 0.75


def test_rank_within_is_a_permutation(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, i % 5) for i in range(500)], "id long, g boolean, o long")
    rows = ranking.rank_within(df, ["g"], "id", order=ranking.F.col("o"), buckets=8).collect()
    for g in (True, False):
        mine = sorted((r["rank"], r.o) for r in rows if r.g == g)
        assert [r for r, _ in mine] == list(range(len(mine))) and [o for _, o in mine] == sorted(o for _, o in mine)


def docs(spark, seed=1):
    rng = random.Random(seed)
    rows = [(i, s, rng.randrange(1, 400)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 800 + ["small"] * 60)] + [(9000, "big", 0), (9001, None, 5), (9002, "stray", 10)]
    return spark.createDataFrame(rows, "id long, source string, n long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def mixed(spark, t, total=None, d=None):
    d = docs(spark) if d is None else d
    m = mixing.mix(d, "id", "source", "n", t, total)
    return m, {r.source: r for r in mixing.shares(m, t, mixing.planned(d, "source", "n", t, total)).collect()}


def test_exact_mix_meets_its_shares(spark):
    m, s = mixed(spark, targets(spark, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.0, 1)]), mixing.EXACT)
    assert all(abs(s[k].actual_share - s[k].target_share) < 0.005 for k in ("big", "mid", "small"))
    assert all(r.most_copies <= r.max_repeats for r in s.values()) and s["absent"].tokens == 0
    assert s["small"].documents == 60 and s["small"].most_copies == 4 and all(r.shortfall < 400 for r in s.values())
    ids = [r.id for r in m.collect()]
    assert len(ids) == len(set(ids)) and not {9000, 9001, 9002} & set(ids)


def test_whole_corpus_with_a_binding_cap(spark):
    m, s = mixed(spark, targets(spark, [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2)]))
    everything = docs(spark).where("source in ('big', 'mid', 'small')").agg({"n": "sum"}).first()[0]
    assert sum(r.wanted_tokens for r in s.values()) in range(everything - 3, everything + 3)
    assert s["small"].most_copies == 2 and s["small"].documents == 60 and s["small"].shortfall == s["small"].wanted_tokens - s["small"].tokens > 0
    for k in ("big", "mid"):
        assert abs(s[k].tokens - s[k].wanted_tokens) < 0.01 * everything
    m, s = mixed(spark, targets(spark, [("big", 0.5, 1), ("mid", 0.5, 1)]), 10_000)
    assert all(abs(r.tokens - 5_000) < 400 for r in s.values())


def test_absent_source_leaves_its_share_to_the_others(spark):
    _, s = mixed(spark, targets(spark, [("big", 0.4, 1), ("mid", 0.4, 1), ("absent", 0.2, 1)]), mixing.EXACT)
    assert abs(s["big"].actual_share - 0.5) < 0.01 and abs(s["mid"].actual_share - 0.5) < 0.01 and s["absent"].actual_share == 0


def test_mix_of_nothing(spark):
    for total in (None, mixing.EXACT):
        m, s = mixed(spark, targets(spark, [("none", 1.0, 2), ("big", 0.0, 1), ("mid", None, 1)]), total)
        assert m.count() == 0 and {r.tokens for r in s.values()} == {0}


def test_token_counts_are_those_of_the_whole_text():
    text = ("The quiet kettle, 你好 été. " * 3000) + "\n\n  end"
    assert tokens.count(text) == len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(text))
    assert tokens.count("") == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "two words", "x"), (2, None, "y")], "id long, text string, n_chars string")
    assert [(r.id, r.n_chars, r.n_tokens) for r in tokens.sizes(df, "id", "text", "n_chars").collect()] == [(1, "x", 2), (2, "y", 0)]
