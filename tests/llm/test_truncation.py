import pytest
from pyspark.sql import functions as F

from plumbline.llm import truncation as X


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n", "A whole sentence.", "Really?", "“Quoted.”", "« Cité. »", "Er sagt „ja“.", "他说好。", "“好。”", "- item one, Town\n- item two, City", "1. **Name** (Town), 12\n2. **Other** (City), 34", "| a | b |\n|---|---|\n| c | 5 |", "See\n\nhttps://a.example/guide/12", "Fine. 👍", "Done. (✓)", "**A heading: of it 12**", "# Heading", "Name kettle Town: the handle 481", "It was sold with serial\n7799."],
)
def test_whole(text):
    assert X.judge_end(text)[0] in (X.WHOLE, X.FINISHED)


@pytest.mark.parametrize(
    "text",
    ["A sentence that", "A sentence that…", "A whole sentence. …", "It ends [...]", "It ends...", "“It is good enough,”", "First. Then, in the", "1. **Name** (Town), 12\n2. **Oth", "1. **Name** (Town), 12\n2. **Other** (Ci", "1. **Name** (Town), 12\n2", "1. **Name** (Town)\n2.", "Three of them:\n1.", "Whole.\n2.", "- a, b\n- c,", "| a | b |\n|---|---|\n| c | 5", "他们询问了铰链的情", "Ｆｉｒｓｔ． Then the"],
)
def test_cut(text):
    assert X.judge_end(text)[0] in (X.OPEN, X.MARKED)


def sources(spark, rows, extra="x string"):
    return [(spark.createDataFrame([(i, t, "clash") for i, t in rows], "id long, body string, verdict string"), "id", "body", "t")]


def test_unknown_prefix_of_a_known_word_is_cut(spark):
    rows = [(1, "Branbumouth is a town. We saw it."), (2, "- Clonwio, Gaerktown\n- Dearkplio, Branbu"), (3, "- Clonwio, Gaerktown\n- Dearkplio, Branbumouth"), (4, "- Clonwio, Gaerktown\n- Dearkplio, Zuvotan"), (5, "Gaerktown. Clonwio, Dearkplio.")]
    assert {tuple(r) for r in X.found(sources(spark, rows)).collect()} == {("t", 2)}


def test_repeated_ids_and_nulls(spark):
    rows = [(1, "cut in the"), (1, "cut in the"), (2, None), (3, ""), (None, "Whole.")]
    assert [tuple(r) for r in X.found(sources(spark, rows)).collect()] == [("t", 1)]


def test_empty_table(spark):
    assert X.found(sources(spark, [])).count() == 0


def test_very_long_text(spark):
    assert [r.rec_id for r in X.found(sources(spark, [(1, "A sentence here. " * 50_000 + "And then the"), (2, "A sentence here. " * 50_000)])).collect()] == [1]


def test_pile_ups(spark):
    lengths = spark.createDataFrame([("t", 240)] * 30 + [("t", n) for n in range(200, 300)], "table_name string, n_chars int")
    assert [(r.table_name, r.n_chars) for r in X.pile_ups(lengths).collect()] == [("t", 240)]


def test_rates(spark):
    v = X.detect(sources(spark, [(1, "cut in the"), (2, "Whole."), (3, "Whole.")]))
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "rec_id long, label string")
    got = {r.label: (r.texts, r["cut"], r.cut_share) for r in X.rates(v, labels, "label").collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}


def test_trie_nodes(spark):
    words = spark.createDataFrame([("abc",), ("abd",), ("x",), ("字" * 3000,)], "word string")
    asked = spark.createDataFrame([(w,) for w in ("a", "ab", "abc", "x", "b", "字" * 2999, "字" * 7)], "w string")
    assert {r.node for r in X.trie_nodes(words, asked).collect()} == {"a", "ab", "字" * 2999, "字" * 7}
    assert X.trie_nodes(words, asked.limit(0)).count() == 0


def test_evidence(spark):
    rows = [(1, "Branbumouth is a town by the sea."), (2, "We went to the fair Branbumo"), (3, "We went to the town and"), (4, "We went to Branbumouth…"), (4, "We went to Branbumouth…"), (5, "We saw it.")]
    v = X.detect(sources(spark, rows))
    assert {r.rec_id: r.evidence for r in v.collect()} == {1: None, 2: X.HALF_WORD, 3: X.OPEN_SENTENCE, 4: X.MARK_OF_CUT, 5: None}
    assert {(r.evidence, r.texts) for r in X.evidence(v).collect()} == {(X.HALF_WORD, 1), (X.OPEN_SENTENCE, 1), (X.MARK_OF_CUT, 1)}
