import random
from collections import Counter

from pyspark.sql import functions as F

from plumbline.operators import mentions, planning, quotes, spans
from plumbline.operators.mentions import Entity

ENTITIES = [Entity("Ostrevo", "brand", ("OSTVD", "Ostrevo Home")), Entity("Ostre", "competitor"), Entity("晨光牙醫", "competitor", ("晨光牙醫診所",))]


def sweep_model(spans_):
    kept, reach = [], -1
    for s, e, i in sorted(spans_, key=lambda x: (x[0], x[0] - x[1], x[2])):
        if s >= reach:
            kept.append((s, e, i))
            reach = e
    return kept


def test_sweeps_against_a_model(spark):
    rng = random.Random(7)
    cases = []
    for n in range(120):
        one = []
        for _ in range(rng.randrange(9)):
            a = rng.randrange(12)
            one.append((a, a + rng.randrange(1, 6), rng.randrange(3)))
        cases.append((n, one))
    df = spark.createDataFrame(cases, "n int, s array<struct<start:int,end:int,entity:int>>")
    got = {r.n: [tuple(x) for x in r.x] for r in df.select("n", mentions.resolved(F.col("s"), 3).alias("x")).collect()}
    for n, one in cases:
        within = [x for i in range(3) for x in sweep_model([y for y in one if y[2] == i])]
        assert got[n] == sweep_model(within), one


def test_mentions(spark):
    rows = [(1, "We like ostrevo home, Ostre and ＯＳＴＶＤ."), (2, "找晨光牙醫診所"), (3, ""), (4, None), (5, "nothing")]
    got = mentions.mentions(spark.createDataFrame(rows, "id int, t string"), ["id"], "t", ENTITIES).collect()
    by = {(r.id, r.entity): (r.char_start, r.char_end, r.n_spans, r.entity_rank) for r in got}
    assert by == {(1, "Ostrevo"): (8, 20, 2, 1), (1, "Ostre"): (22, 27, 1, 2), (2, "晨光牙醫"): (1, 7, 1, 1)}


def test_unknown_names(spark):
    text = "另外健康牙醫診所 is near Quill Barn Company. Quill Barn Company! 「好店」"
    found = mentions.name_candidates(text)
    assert [n for n, *_ in found] == ["健康牙醫診所", "Quill Barn Company", "Quill Barn Company", "好店"]
    assert all(text[a:b] == n for n, a, b, _ in found) and mentions.name_candidates(None) == []
    df = spark.createDataFrame([(1, text), (2, "x Ostrevo Home Company"), (3, None)], "id int, t string")
    got = sorted((r.id, r.entity, r.char_start) for r in mentions.unknown_entities(df, ["id"], "t", ENTITIES).collect())
    assert got == [(1, "Quill Barn Company", text.index("Quill")), (1, "健康牙醫診所", 2), (1, "好店", text.index("好店"))]


def test_sentences():
    t = "First one. Try Quill Barn Co. and Dr. Sample today! Then。晨光很好！\n- Bullet"
    cut = lambda p: t[slice(*mentions.sentence_at(t, t.index(p)))]
    assert cut("Quill") == "Try Quill Barn Co. and Dr. Sample today!"
    assert cut("晨光") == "晨光很好！" and cut("Bullet") == "- Bullet" and cut("First") == "First one."


def test_sentence_highlights_and_segments(spark):
    df = spark.createDataFrame([(1, "Before. Ostrevo beats ostrevo. After")], "id int, t string")
    s = mentions.sentences(df, ["id"], "t", ENTITIES)
    r = s.select("sentence", "highlights", mentions.segments(F.col("sentence"), F.col("highlights")).alias("p")).first()
    assert r.sentence == "Ostrevo beats ostrevo." and [tuple(h) for h in r.highlights] == [(0, 7), (14, 21)]
    assert [(x.piece, x.marked) for x in r.p] == [("Ostrevo", True), (" beats ", False), ("ostrevo", True), (".", False)]


def window_model(q, p):
    if not q or not p:
        return 0.0
    need, w = Counter(q), min(len(q), len(p))
    return max(sum(min(c, need[t]) for t, c in Counter(p[i : i + w]).items() if t in need) for i in range(len(p) - w + 1)) / len(q)


def _scores(spark, rows):
    df = spark.createDataFrame(rows, "id int, q string, p string")
    return quotes.window_scores(df.select("id", "q", F.col("id").alias("u")), df.select(F.col("id").alias("u"), "p"), "id", "q", "u", "p").collect()


def test_one_page_is_read_in_both_ways(spark):
    q = spark.createDataFrame([(1, "warm tea", "u"), (2, "茶 tea", "u"), (3, "tea", "other")], "id int, q string, u string")
    p = spark.createDataFrame([("u", "warm green tea")], "u string, p string")
    assert {r.id: r.score for r in quotes.window_scores(q, p, "id", "q", "u", "p").collect()} == {1: 0.5, 2: 0.75}


def test_window_scores_against_a_sliding_count(spark):
    rng = random.Random(11)
    rows = [(n, " ".join(rng.choice("abcd") for _ in range(rng.randrange(7))), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(25)))) for n in range(250)]
    got = {r.id: r.score for r in _scores(spark, rows)}
    assert got == {n: round(window_model(q.split(), p.split()), 4) for n, q, p in rows}


def test_window_score_controls(spark):
    rows = [(1, "術後保固五年", "本診所植牙提供術後保固五年服務"), (2, "five year warranty", "We offer dental implants with a five year warranty."), (3, "five year", "")]
    got = {r.id: r.score for r in _scores(spark, rows)}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}


def _checked(spark, quote, page, status="ok"):
    c = spark.createDataFrame([(1, 1, "e", "u", "d", True, quote)], "citation_id int, answer_id int, engine string, url string, domain string, is_cited boolean, cited_text string")
    p = spark.createDataFrame([(1, "u", status, 200, "2024-01-01", "m", page)], "page_id int, url string, fetch_status string, http_status int, fetched_at string, text_method string, text string")
    return quotes.checked(c, p).first()


def test_checked_quotes(spark):
    r = _checked(spark, "**Title**\nA passage  here", "Title and then A PASSAGE here.")
    assert (r.result, r.matched_by, r.pieces, r.pieces_found) == ("found", "pieces", 2, 2)
    r = _checked(spark, "Title\nmissing words", "Title and nothing")
    assert (r.result, r.pieces, r.pieces_found) == ("not_found", 2, 1)
    assert _checked(spark, None, "x").not_comparable_reason == "no_cited_text"
    assert _checked(spark, "x", "x", "gone").not_comparable_reason == "fetch_gone"
    assert _checked(spark, "x", "").not_comparable_reason == "no_page_text"


def test_span_validation(spark):
    bad = [(-1, 2, [0]), (2, 2, [0]), (3, 1, [0]), (0, 99, [0]), (0, 2, []), (0, 2, [7]), (0, 2, [1]), (None, 2, [0]), (0, 2, [0, 9])]
    rows = [(n, "hello", [b]) for n, b in enumerate(bad)] + [(100, "hello", [(2, 4, [0]), (0, 5, [0, 0])]), (101, "hello", None), (102, "hello", [])]
    a = spark.createDataFrame(rows, "answer_id int, answer_text string, spans array<struct<span_start:int,span_end:int,citation_indexes:array<int>>>")
    c = spark.createDataFrame([(r[0], i, i == 0, "u") for r in rows for i in (0, 1)], "answer_id int, citation_index int, is_cited boolean, url string")
    got = {r.answer_id: r for r in spans.validated(a, c).collect()}
    assert all(got[n].n_dropped == 1 and got[n].kept == [] for n in range(len(bad)))
    assert [(s.span_start, s.span_end, s.citation_indexes) for s in got[100].kept] == [(0, 5, [0]), (2, 4, [0])]
    assert got[101].n_dropped is None and got[102].n_dropped == 0


def test_plan_and_cap(spark):
    m = spark.createDataFrame([("r", 2, (1, "h", 2), {"b": 1, "a": 1})], "run_id string, repeats int, prompt_set struct<set_version:int,set_hash:string,n_queries:int>, engines map<string,int>")
    t = planning.tasks(m)
    assert t.count() == 8
    done = spark.createDataFrame([("r", "a", 0, 0)], "run_id string, engine string, query_index int, repeat_no int")
    todo = planning.capped(planning.missing(t, done), 3).orderBy("place").collect()
    assert [(r.engine, r.query_index, r.repeat_no) for r in todo] == [("b", 0, 0), ("a", 1, 0), ("b", 1, 0)]
