import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import addresses, folding, hosts, html, requests, robots, stats
from plumbline.functions import text as tx


def one(spark, *cols, **values):
    names = list(values)
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(*cols).first() if names else spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("count", "n", "low", "high"), [(4, 9, 0.188775, 0.733353), (0, 6, 0.0, 0.390343), (6, 6, 0.609657, 1.0)])
def test_wilson(spark, count, n, low, high):
    a, b = stats.wilson(F.lit(count), F.lit(n))
    r = spark.range(1).select(F.round(a, 6).alias("a"), F.round(b, 6).alias("b")).first()
    assert (abs(r.a), r.b) == (low, high)


def test_wilson_without_a_denominator_is_null(spark):
    for c, n in ((0, 0), (3, 2), (-1, 4)):
        a, b = stats.wilson(F.lit(c), F.lit(n))
        assert spark.range(1).select(a, b).first()[:] == (None, None)


def test_metric_statuses(spark):
    rows = spark.createDataFrame([(3, 6), (5, 10), (0, 0)], "c int, n int").select(*stats.metric("m", F.col("c"), F.col("n"), "not_observable")).collect()
    assert [r.m_status for r in rows] == ["low_sample", "ok", "not_observable"]
    assert rows[2].m_count is None and rows[2].m_rate is None and rows[2].m_n == 0


def test_metric_text(spark):
    r = spark.range(1).select(stats.metric_text(F.lit(4), F.lit(9), F.lit("low_sample")).alias("t"), stats.metric_text(F.lit(None).cast("int"), F.lit(0), F.lit("not_observable")).alias("u")).first()
    assert r.t == "4 of 9 (44%, 95% CI 19%–73%) · low sample"
    assert r.u == "not observable"


@pytest.mark.parametrize(
    ("domain", "owned", "expected"),
    [("www.ostrevo.example", "ostrevo.example", True), ("shop.ostrevo.example", "ostrevo.example", True), ("notostrevo.example", "ostrevo.example", False), ("ostrevo.example:8443", "ostrevo.example", False), (None, "ostrevo.example", False)],
)
def test_owned(spark, domain, owned, expected):
    assert one(spark, hosts.is_owned(F.col("d"), [owned]).alias("x"), d=("string", domain)).x is expected


def test_hosts(spark):
    url = "https://redirect.grounding.example/r/1"
    r = one(spark, hosts.resolve_domain(F.col("u"), F.col("t")).alias("a"), hosts.resolve_domain(F.col("u"), F.lit("A title")).alias("b"), hosts.citation_host(F.lit(""), F.lit("https://WWW.Site.example:80/x"), F.lit(None).cast("string")).alias("c"), hosts.bare_host(F.lit("https://www.Site.example:8080/x?y")).alias("d"), hosts.slug(F.lit("Démo & Co.")).alias("e"), u=("string", url), t=("string", " Site.example "))
    assert tuple(r) == ("site.example", "redirect.grounding.example", "site.example:80", "site.example", "démo-co")


def test_fetch_status(spark):
    codes = [200, 204, 401, 403, 402, 404, 410, 500, None]
    rows = spark.createDataFrame([(c,) for c in codes], "c int").select(hosts.fetch_status(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["ok", "ok", "auth_required", "auth_required", "paywalled", "gone", "gone", "http_error", None]


@pytest.mark.parametrize(
    ("quote", "plain"),
    [("## Title\ntext", "Title text"), ("- item one", "item one"), ("[label](https://x.example) and **bold**", "label and bold"), ("cut here…", "cut here"), ("`code`  and\n\n__more__ ...", "code and more"), ("*one* star stays", "*one* star stays"), ("", "")],
)
def test_normal_quote(spark, quote, plain):
    assert one(spark, tx.normal_quote(F.col("q")).alias("x"), q=("string", quote)).x == plain


def test_excerpt(spark):
    r = one(spark, tx.excerpt(F.col("a")).alias("a"), tx.excerpt(F.lit("  short ")).alias("b"), a=("string", "x" * 199 + " yyyy"))
    assert r.a == "x" * 199 + "…" and r.b == "short"


def test_bytes_to_code_points_against_python(spark):
    rng = random.Random(3)
    rows = [(("".join(rng.choice("aé你🦷 ") for _ in range(rng.randrange(8)))), rng.randrange(-1, 20)) for _ in range(200)]
    got = spark.createDataFrame(rows, "t string, b int").select("t", "b", tx.byte_to_code_point(F.col("t"), F.col("b")).alias("x")).collect()
    for r in got:
        starts = {len(r.t[:i].encode()): i for i in range(len(r.t) + 1)}
        assert r.x == starts.get(r.b)


def test_tokens(spark):
    r = one(spark, tx.tokens(F.lit("Straße, naïve_x 5!"), F.lit(False)).alias("w"), tx.tokens(F.lit("很 好a，5"), F.lit(True)).alias("c"))
    assert r.w == ["strasse", "naïve_x", "5"] and r.c == ["很", "好", "a", "5"]


def test_folding_keeps_raw_offsets():
    text = "🙂 ＴＲＬ and Café ﬁce"
    found = {n: [text[a:b] for a, b, _ in folding.occurrences(text, [(0, folding.fold(n))])] for n in ("trl", "Café", "f", "fi")}
    assert found == {"trl": ["ＴＲＬ"], "Café": ["Café"], "f": ["f"], "fi": ["ﬁ"]}


def test_folding_origin_is_monotone():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("aßﬁé́Ⅻ你 Ａ") for _ in range(rng.randrange(12)))
        form, begin, finish = folding.fold_with_origin(t)
        assert len(form) == len(begin) == len(finish) and begin == sorted(begin) and all(0 <= a < b <= len(t) for a, b in zip(begin, finish, strict=True))


def test_visible_text():
    assert html.read("<p>Brand <a>A</a> Co.</p><script>if(a<b){'</p>'}</script><li>x&amp;y</li><svg><title>t</title></svg>") == "Brand A Co. x&y"
    assert html.read("<b>in</b>line <em>tags</em> join<br>blocks split") == "inline tags join blocks split"
    assert html.read(None) == "" and html.read("") == "" and html.read("<p>open") == "open"


def test_addresses():
    kinds = {"127.0.0.1": "loopback", "10.1.2.3": "private", "169.254.1.1": "link_local", "224.0.0.1": "multicast", "8.8.8.8": "public", "::ffff:10.0.0.1": "private", "nope": "invalid"}
    assert {a: addresses.kind(a) for a in kinds} == kinds and addresses.kind(None) is None


def test_markdown_cell(spark):
    assert one(spark, tx.markdown_cell(F.lit("a|b\n<c>*d*")).alias("x")).x == "a\\|b \\<c\\>\\*d\\*"


def test_rates_never_divide_by_zero(spark):
    assert math.isfinite(one(spark, stats.metric("m", F.lit(1), F.lit(1))[2].alias("x")).x)


def test_robots(spark):
    rules = "User-agent: *\nDisallow: /private\n\nUser-agent: reader\nAllow: /\n"
    assert robots.allows("https://a.example/private/x", 200, rules, "other") is False and robots.allows("https://a.example/private/x", 200, rules, "reader") is True
    assert robots.allows("https://a.example/", 503, None, "other") is False and robots.allows("https://a.example/", 404, "Disallow", "other") is True
    assert robots.allows("https://a.example/", None, None, "other") is True and robots.allows(None, 200, rules, "other") is None
    urls = spark.createDataFrame([("https://a.example/private/1", 1), ("https://b.example/x", 2), ("https://c.example/", 3), (None, 4)], "url string, _body2 int")
    sites = spark.createDataFrame([("https://a.example", 200, rules), ("https://b.example", 500, None)], "origin string, http_status int, body string")
    assert {r.url: r.may_fetch for r in robots.allowed(urls, sites, "other").collect()} == {"https://a.example/private/1": False, "https://b.example/x": False, "https://c.example/": True, None: None}


def test_request_bodies(spark):
    df = spark.createDataFrame([(p, 'quote " and \\ and 你') for p in ("anthropic", "openai", "google", "xai", "perplexity", "other")], "p string, q string")
    got = {r.p: r.b and json.loads(r.b) for r in df.select("p", requests.request_body(F.col("p"), F.lit("m-1"), F.col("q")).alias("b")).collect()}
    turn = [{"role": "user", "content": 'quote " and \\ and 你'}]
    assert got["other"] is None and got["perplexity"] == {"model": "m-1", "messages": turn}
    assert got["anthropic"]["messages"] == got["openai"]["input"] == got["xai"]["messages"] == turn
    assert got["google"] == {"contents": [{"role": "user", "parts": [{"text": turn[0]["content"]}]}], "tools": [{"google_search": {}}]}
    assert got["anthropic"]["tools"][0]["allowed_callers"] == ["direct"] and got["xai"]["search_parameters"]["return_citations"] is True
    plain = df.select("p", requests.request_body(F.col("p"), F.lit("m-1"), F.col("q"), False).alias("b")).where("p = 'google'").first()
    assert "tools" not in json.loads(plain.b)
