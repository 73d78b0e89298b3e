import json

import pytest

from plumbline import config, report
from plumbline.__main__ import main
from plumbline.functions import canonical

DOC = {
    "schema": 1, "brand": {"name": "Ostrevo", "aliases": ["OSTVD"], "owned_domains": ["https://www.Ostrevo.example/x"]}, "competitors": [{"name": "Rival"}],
    "engines": ["openai", "google"], "repeats": 2, "prompt_set": {"version": 1, "queries": [{"text": "Best?", "intent": "recommendation"}, {"text": "How?", "intent": "how_to"}]},
}


def but(**changes):
    return {**DOC, **changes}


def test_config():
    c = config.parse(DOC)
    assert c.owned == ("ostrevo.example",) and c.recommending() == (0,) and c.warnings() == [] and c.brand.name == "Ostrevo"
    assert c.prompt_set_hash() == config.parse(json.loads(json.dumps(dict(reversed(DOC.items()))))).prompt_set_hash()
    other = json.loads(json.dumps(DOC))
    other["prompt_set"]["queries"][0]["intent"] = "trust"
    assert c.prompt_set_hash() != config.parse(other).prompt_set_hash()


@pytest.mark.parametrize(
    "doc",
    [
        but(schema=2), but(extra=1), but(repeats=0), but(repeats=51), but(repeats=True), but(engines=[]), but(engines=["openai", "openai"]), but(engines=["other"]), but(competitors=[{"name": "Ostrevo"}]),
        but(brand={"name": " "}), but(brand={"name": "T", "aliases": [""]}), but(brand={"name": "T", "owned_domains": ["https://"]}), but(prompt_set={"version": 1, "queries": []}),
        but(prompt_set={"version": 0, "queries": DOC["prompt_set"]["queries"]}), but(prompt_set={"version": 1, "queries": DOC["prompt_set"]["queries"][:1] * 2}), [],
    ],
)
def test_bad_configs(doc):
    with pytest.raises(config.ConfigError):
        config.parse(doc)


def test_report(spark, tmp_path):
    a = [
        (1, "r", "openai", 0, 0, "recommendation", "Ostrevo and Rival", True, "f1"), (2, "r", "openai", 1, 0, "how_to", "nothing <b>|here", True, "f2"),
        (3, "r", "openai", 0, 1, "recommendation", "no", False, "f3"), (4, "r", "openai", 9, 0, "how_to", "", True, "f4"),
    ]
    rows = [(i, r, e, q, n, t, x, o, f, (i == 4, True, None), None, None) for i, r, e, q, n, t, x, o, f in a]
    answers = spark.createDataFrame(rows, "answer_id int, run_id string, engine string, query_index int, repeat_no int, intent string, answer_text string, cited_sources_available boolean, source_file string, params struct<no_fixture:boolean,search_ran:boolean,e:boolean>, spans array<struct<a:int>>, searches array<struct<a:int>>")
    citations = spark.createDataFrame([(1, 1, "openai", "u", "www.ostrevo.example", True, "A quote"), (2, 2, "openai", "u", "x.example", True, None)], "citation_id int, answer_id int, engine string, url string, domain string, is_cited boolean, cited_text string")
    pages = spark.createDataFrame([(1, "u", "ok", 200, "2024", "m", "See a  QUOTE here")], "page_id int, url string, fetch_status string, http_status int, fetched_at string, text_method string, text string")
    built, table = report.build(config.parse(DOC), answers, citations, pages)
    openai, google = built["engines"]
    assert [(m["count"], m["n"], m["status"]) for m in openai["metrics"].values()] == [(1, 3, "low_sample"), (1, 2, "low_sample"), (1, 2, "low_sample")]
    assert google["metrics"] is None and openai["competitors"]["Rival"]["count"] == 1 and openai["faithfulness"]["found"] == 1
    assert built["across"] == {"count": 1, "n": 3, "engines": "openai"}
    report.write(built, table, tmp_path)
    first = {f.name: f.read_bytes() for f in tmp_path.glob("report.*")}
    report.write(*report.build(config.parse(DOC), answers, citations, pages), tmp_path)
    assert first == {f.name: f.read_bytes() for f in tmp_path.glob("report.*")} and set(first) == {"report.json", "report.md", "report.html"}
    page = first["report.html"].decode()
    assert "&lt;b&gt;|here" in page and "<b>" not in page and 'id="row-openai-q00-r0"' in page
    assert "\\<b\\>\\|here" in first["report.md"].decode() and "1 of 3 (33%" in first["report.md"].decode()
    assert spark.read.parquet(str(tmp_path / "evidence.parquet")).count() == 3


def test_command_line(tmp_path, capsys):
    assert main(["list"]) == 0 and "mention_rate_by_engine" in capsys.readouterr().out
    bad = tmp_path / "c.json"
    bad.write_text("{}")
    assert main(["report", str(bad), "x", "y"]) == 1 and main(["query", "none", "x"]) == 1


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": [2, 1], "c": "é"}}',), ("{",), (None,)], "p string")
    assert [r[0] for r in df.select(canonical.canonical_json("p")).collect()] == ['{"a":{"c":"é","d":[2,1]},"b":1}', None, None]
