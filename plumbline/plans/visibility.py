"""Queries over answers, citations, pages and runs, each with its SQL where SQL can express it."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import addresses, folding, hosts, requests, robots, stats
from plumbline.functions import text as tx
from plumbline.functions.html import visible_text
from plumbline.operators import evidence, fixtures, lineage, mentions, payloads, planning, quotes, rates, spans
from plumbline.operators.mentions import Entity
from plumbline.plans import mention_sql, payload_sql
from plumbline.sources import records, runs
from plumbline.streaming import answers as streaming

RECOMMENDATION = ("recommendation",)
OWNED = ("tallow-index.example", "niothaix.example")
BRAND = Entity("kettle", "brand", ("Wasserkocher", "bouilloire", "hervidor", "chaleira", "чайник", "电热水壶"))
RIVALS = [
    Entity("water filter", "competitor", ("filter housing", "Luftreiniger")),
    Entity("tool chest", "competitor", ("chest", "Werkzeugkiste", "caisse à outils")),
    Entity("desk lamp", "competitor", ("standing desk", "lampe de bureau", "настольная лампа", "台灯")),
]
ENTITIES = [BRAND, *RIVALS]
CAP = 10

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL pieces ---

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "".join(chr(c) for c in range(0x2000, 0x200B)) + "   　"


def _folded(c: str) -> str:
    """Compatibility folding as far as the test tables need it: width, blanks, ligatures, small letters, ß, composition."""
    out = f"translate({c}, '{_WIDE.replace(chr(39), chr(39) * 2)}{_BLANKS}', '{_NARROW.replace(chr(39), chr(39) * 2)}{' ' * len(_BLANKS)}')"
    for a in "ﬀﬁﬂﬃﬄﬅﬆ":
        out = f"replace({out}, '{a}', '{unicodedata.normalize('NFKC', a)}')"
    return f"replace(lower(nfc_normalize({out})), 'ß', 'ss')"


def _names(c: str, e: Entity) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in e.needles()) + ")"


_A = "SELECT DISTINCT ON (answer_id) * FROM answers"
_C = "SELECT DISTINCT ON (citation_id) * FROM citations"
_P = "SELECT DISTINCT ON (page_id) * FROM fetched_pages"
_WWW = "regexp_replace(lower(domain), '^www\\.', '')"
_OWNED = "coalesce(" + " OR ".join(f"{_WWW} = '{o}' OR ends_with({_WWW}, '.{o}')" for o in OWNED) + ", false)"
_ROWS = f"""
  WITH a AS ({_A}), c AS ({_C}),
  oc AS (SELECT answer_id, count(*) FILTER (is_cited AND {_OWNED}) AS n_owned FROM c GROUP BY 1),
  f AS (SELECT *, {_folded('answer_text')} AS t FROM a WHERE NOT coalesce(params.no_fixture, false)),
  rows AS (SELECT f.answer_id, engine, run_id, query_index, intent, coalesce({_names('t', BRAND)}, false) AS mentioned,
      CASE WHEN intent IN ('recommendation') THEN coalesce({_names('t', BRAND)}, false) END AS named_in_rec,
      CASE WHEN coalesce(cited_sources_available, false) THEN coalesce(n_owned, 0) > 0 END AS owned_cited, t
    FROM f LEFT JOIN oc USING (answer_id))"""


def _metric(prefix: str, c: str, n: str, empty: str = "no_data", digits: int = 6) -> str:
    p, scale = f"({c}::double / {n})", f"(1 + 3.8416 / {n})"
    half = f"(1.96 / {scale} * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})))"
    mid = f"(({p} + 3.8416 / (2.0 * {n})) / {scale})"
    num = lambda x: f"CASE WHEN {n} > 0 THEN round({x}, {digits}) END"
    return f"""CASE WHEN {n} > 0 THEN {c} END::bigint AS {prefix}_count, {n}::bigint AS {prefix}_n, {num(p)} AS {prefix}_rate,
      {num(f'{mid} - {half}')} AS {prefix}_low, {num(f'{mid} + {half}')} AS {prefix}_high,
      CASE WHEN {n} = 0 THEN '{empty}' WHEN {n} >= 10 THEN 'ok' ELSE 'low_sample' END AS {prefix}_status"""


def _analysed(spark: SparkSession, sf: str) -> DataFrame:
    return rates.analysed(_t(spark, sf, "answers"), ENTITIES, RECOMMENDATION, _t(spark, sf, "citations"), OWNED)


# --- rates ---


@query(f"{_ROWS}, g AS (SELECT engine, count(*) FILTER (mentioned) AS c, count(*) AS n FROM rows GROUP BY 1) SELECT engine, {_metric('mention', 'c', 'n')} FROM g")
def mention_rate_by_engine(spark, sf):
    m = rates.engine_metrics(_analysed(spark, sf))
    return m.select("engine", *[c for c in m.columns if c.startswith("mention_")])


@query(f"{_ROWS}, g AS (SELECT engine, count(*) FILTER (named_in_rec) AS c, count(named_in_rec) AS n FROM rows GROUP BY 1) SELECT engine, {_metric('named_in_rec', 'c', 'n')} FROM g")
def named_in_rec_by_engine(spark, sf):
    m = rates.engine_metrics(_analysed(spark, sf))
    return m.select("engine", *[c for c in m.columns if c.startswith("named_in_rec_")])


@query(f"{_ROWS}, g AS (SELECT engine, count(*) FILTER (owned_cited) AS c, count(owned_cited) AS n FROM rows GROUP BY 1) SELECT engine, {_metric('owned_cited', 'c', 'n', 'not_observable')} FROM g")
def citation_rate_observable(spark, sf):
    m = rates.engine_metrics(_analysed(spark, sf))
    return m.select("engine", *[c for c in m.columns if c.startswith("owned_cited_")])


@query(f"{_ROWS}, e AS (" + " UNION ALL ".join(f"SELECT engine, '{e.name}' AS competitor, coalesce({_names('t', e)}, false) AS named FROM rows" for e in RIVALS) + f"), g AS (SELECT engine, competitor, count(*) FILTER (named) AS c, count(*) AS n FROM e GROUP BY 1, 2) SELECT engine, competitor, {_metric('mention', 'c', 'n')} FROM g")
def competitor_mention_matrix(spark, sf):
    return rates.competitor_metrics(_analysed(spark, sf), RIVALS)


@query(f"{_ROWS}, g AS (SELECT engine, count(*) FILTER (mentioned) AS c, count(*) AS n FROM rows GROUP BY 1) SELECT sum(c)::bigint AS count, sum(n)::bigint AS n, string_agg(engine, ',' ORDER BY engine) AS engines FROM g")
def across_engine_count(spark, sf):
    return rates.across(rates.engine_metrics(_analysed(spark, sf)), "mention")


@query(f"{_ROWS}, g AS (SELECT engine, query_index, count(*) FILTER (mentioned) AS c, count(*) AS n FROM rows GROUP BY 1, 2) SELECT engine, query_index, {_metric('mention', 'c', 'n')} FROM g")
def low_sample_status(spark, sf):
    m = rates.engine_metrics(_analysed(spark, sf), ("engine", "query_index"))
    return m.select("engine", "query_index", *[c for c in m.columns if c.startswith("mention_")])


@query(f"SELECT engine, 'not_measured' AS named_in_rec_status, 'not_measured' AS owned_cited_status, 0::bigint AS owned_cited_n FROM ({_A}) WHERE NOT coalesce(params.no_fixture, false) GROUP BY 1")
def not_measured(spark, sf):
    """Without an intent for recommendations and without an owned site these rates have no number."""
    rows = rates.analysed(_t(spark, sf, "answers"), ENTITIES, (), _t(spark, sf, "citations"), ())
    return rates.engine_metrics(rows, recommendation=False, owned=False).select("engine", "named_in_rec_status", "owned_cited_status", "owned_cited_n")


@query(f"WITH g AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS c, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_linestatus, {_metric('returned', 'c', 'n')} FROM g")
def wilson_returnflag(spark, sf):
    g = _t(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("c"), F.count("*").alias("n"))
    return g.select("l_linestatus", *stats.metric("returned", F.col("c"), F.col("n")))


@query(f"""{_ROWS}, g AS (SELECT engine, count(*) FILTER (mentioned) AS c, count(*) AS n FROM rows GROUP BY 1), m AS (SELECT engine, {_metric('m', 'c', 'n', digits=12)} FROM g)
  SELECT engine, m_count || ' of ' || m_n || ' (' || round(100.0 * m_count / m_n)::int || '%, 95% CI ' || round(100 * abs(m_low))::int || '%–' || round(100 * m_high)::int || '%)' || CASE WHEN m_status = 'low_sample' THEN ' · low sample' ELSE '' END AS line FROM m""")
def metric_lines(spark, sf):
    m = rates.engine_metrics(_analysed(spark, sf))
    return m.select("engine", stats.metric_text(F.col("mention_count"), F.col("mention_n"), F.col("mention_status")).alias("line"))


# --- mentions ---


@query(f"WITH f AS (SELECT answer_id, {_folded('answer_text')} AS t FROM ({_A})), n AS (SELECT unnest({[n for e in ENTITIES for n in e.needles()]!r}) AS needle) SELECT needle, count(DISTINCT answer_id) AS n_answers, sum((length(t) - length(replace(t, needle, ''))) // length(needle))::bigint AS n_found FROM f JOIN n ON contains(t, needle) GROUP BY 1")
def alias_occurrences(spark, sf):
    """No needle overlaps itself, so removing all of them counts them."""
    needles = F.array(*[F.lit(n) for e in ENTITIES for n in e.needles()])
    t = _t(spark, sf, "answers").select("answer_id", folding.folded("answer_text").alias("t"))
    # one pass over each text, the list being the configuration's; counts instead of texts are shuffled
    count = lambda n: ((F.length("t") - F.length(F.replace(F.col("t"), n, F.lit("")))) / F.length(n)).cast("long")
    here = F.transform(F.filter(needles, lambda n: F.contains(F.col("t"), n)), lambda n: F.struct(n.alias("needle"), count(n).alias("found")))
    each = rates.latest_of(t, ["answer_id"], here.alias("here")).select("answer_id", F.explode("here").alias("x"))
    return each.groupBy("x.needle").agg(F.count("*").alias("n_answers"), F.sum("x.found").alias("n_found"))


@query(mention_sql.mentions(_A, ENTITIES, _folded))
def entity_mentions(spark, sf):
    return mentions.mentions(_t(spark, sf, "answers"), ["answer_id"], "answer_text", ENTITIES)


@query(f"WITH f AS (SELECT {_folded('answer_text')} AS t FROM ({_A})) SELECT entity, count(*) AS n_answers FROM (" + " UNION ALL ".join(f"SELECT '{e.name}' AS entity FROM f WHERE {_names('t', e)}" for e in ENTITIES) + ") GROUP BY 1")
def entity_answer_counts(spark, sf):
    """No alias of one entity covers another's here, so every entity that is named survives the sweeps."""
    return entity_mentions(spark, sf).groupBy("entity").agg(F.count("*").alias("n_answers"))


@query()
def unknown_entities(spark, sf):
    return mentions.unknown_entities(_t(spark, sf, "answers"), ["answer_id"], "answer_text", ENTITIES).distinct()


@query(mention_sql.sentences(_A, ENTITIES, _folded, "[\\s\\p{Z}\\x{85}]"))
def brand_sentences(spark, sf):
    s = mentions.sentences(_t(spark, sf, "answers"), ["answer_id"], "answer_text", ENTITIES).where("sentence is not null")
    return rates.latest(s, ["answer_id"]).select("answer_id", "sentence", F.size("highlights").alias("n_highlights"), F.size(mentions.segments(F.col("sentence"), F.col("highlights"))).alias("n_segments"))


@query(f"WITH a AS (SELECT answer_id, regexp_replace(answer_text, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g') AS t FROM ({_A})) SELECT answer_id, CASE WHEN length(t) > 200 THEN regexp_replace(left(t, 200), '[\\s\\p{{Z}}\\x{{85}}]+$', '') || '…' ELSE t END AS excerpt FROM a")
def answer_excerpt(spark, sf):
    return rates.latest_of(_t(spark, sf, "answers"), ["answer_id"], tx.excerpt(F.col("answer_text")).alias("excerpt"))


# --- hosts ---

_NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_RED = f"{_NETLOC} IN {hosts.REDIRECTORS!r}"
_HOSTLIKE = "coalesce(regexp_matches(lower(trim(title)), '^[a-z0-9][a-z0-9.-]*\\.[a-z]{2,}$'), false)"


@query(f"SELECT citation_id, {_NETLOC} AS netloc, regexp_replace(coalesce(nullif(domain, ''), CASE WHEN {_RED} AND {_HOSTLIKE} THEN lower(trim(title)) ELSE {_NETLOC} END).lower(), '^www\\.', '') AS host, {_RED} AS is_redirector, {_OWNED} AS owned FROM ({_C})")
def citation_hosts(spark, sf):
    c = rates.latest(_t(spark, sf, "citations"), ["citation_id"])
    return c.select("citation_id", hosts.netloc(F.col("url")).alias("netloc"), hosts.citation_host(F.col("domain"), F.col("url"), F.col("title")).alias("host"), hosts.is_redirector(F.col("url")).alias("is_redirector"), hosts.is_owned(F.col("domain"), OWNED).alias("owned"))


@query(f"SELECT regexp_replace(lower(domain), '^www\\.', '') AS host, engine, count(*) AS n_sources, count(*) FILTER (is_cited) AS n_cited, count(*) FILTER (is_cited AND cite_position = 0) AS n_first FROM ({_C}) GROUP BY 1, 2")
def cited_hosts_by_engine(spark, sf):
    c = rates.latest(_t(spark, sf, "citations"), ["citation_id"])
    return c.groupBy(hosts.strip_www(F.col("domain")).alias("host"), "engine").agg(F.count("*").alias("n_sources"), F.count_if("is_cited").alias("n_cited"), F.count_if(F.col("is_cited") & (F.col("cite_position") == 0)).alias("n_first"))


@query("WITH p AS (SELECT DISTINCT ON (page_id) * FROM fetched_pages) SELECT coalesce(http_status, -1) AS http_status, fetch_status, CASE WHEN http_status IN (401, 403) THEN 'auth_required' WHEN http_status = 402 THEN 'paywalled' WHEN http_status IN (404, 410) THEN 'gone' WHEN http_status BETWEEN 200 AND 299 THEN 'ok' WHEN http_status IS NOT NULL THEN 'http_error' END AS by_code, count(*) AS n FROM p GROUP BY 1, 2, 3")
def fetch_status_map(spark, sf):
    p = rates.latest(_t(spark, sf, "fetched_pages"), ["page_id"])
    return p.groupBy(F.coalesce("http_status", F.lit(-1)).alias("http_status"), "fetch_status", hosts.fetch_status(F.col("http_status")).alias("by_code")).agg(F.count("*").alias("n"))


_SOCIAL = f"regexp_replace({_NETLOC}, '^www\\.', '') IN {hosts.SOCIAL!r}"


@query(f"SELECT CASE WHEN {_SOCIAL} THEN 'x' ELSE 'web' END AS corpus, CASE WHEN {_SOCIAL} THEN 'social_post' ELSE 'web' END AS source_type, count(*) AS n FROM (SELECT DISTINCT url FROM citations WHERE url IS NOT NULL UNION ALL SELECT 'https://www.x.com/a/' || n FROM range(3) r(n)) GROUP BY 1, 2")
def source_types(spark, sf):
    """Urls by the corpus they belong to; three posts are added, as the tables may have none."""
    urls = _t(spark, sf, "citations").select("url").where("url is not null").distinct()
    posts = spark.range(3).select(F.concat(F.lit("https://www.x.com/a/"), F.col("id").cast("string")).alias("url"))
    host = hosts.netloc(F.col("url"))
    return urls.union(posts).groupBy(hosts.corpus(host).alias("corpus"), hosts.source_type(host).alias("source_type")).agg(F.count("*").alias("n"))


_SITE = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


@query(f"WITH u AS (SELECT DISTINCT url, {_SITE} AS site FROM citations WHERE url IS NOT NULL) SELECT url, CASE length(site) % 4 WHEN 0 THEN NOT starts_with(substr(url, length(site) + 1), '/p/') WHEN 1 THEN false ELSE true END AS may_fetch FROM u")
def robots_rules(spark, sf):
    """Which cited urls may be read, if sites forbid a folder (every fourth length of a name), fail, have no rules, or can't be reached."""
    urls = _t(spark, sf, "citations").select("url").where("url is not null").distinct()
    sites = urls.select(robots.origin(F.col("url")).alias("origin")).distinct()
    kind = F.length("origin") % 4
    sites = sites.where(kind < 3).select("origin", F.when(kind == 0, 200).when(kind == 1, 503).otherwise(404).alias("http_status"), F.when(kind == 0, F.lit("User-agent: *\nDisallow: /p/\n")).alias("body"))
    return robots.allowed(urls, sites, "reader")


_ADDRESSES = (
    ("93.184.216.34", "public"), ("2606:2800:220:1:248:1893:25c8:1946", "public"), ("0.0.0.0", "unspecified"), ("127.0.0.1", "loopback"), ("::1", "loopback"), ("169.254.169.254", "link_local"), ("fe80::1", "link_local"), ("224.0.0.1", "multicast"),
    ("240.0.0.1", "reserved"), ("10.1.2.3", "private"), ("172.16.0.1", "private"), ("192.168.1.1", "private"), ("fd00::1", "private"), ("100.64.0.1", "not_global"), ("::ffff:127.0.0.1", "loopback"), ("::ffff:93.184.216.34", "public"), ("256.1.1.1", "invalid"), ("host.example", "invalid"),
)


@query(f"SELECT * FROM (VALUES {', '.join(map(repr, _ADDRESSES))}) t(address, kind)")
def address_kinds(spark, sf):
    """Known addresses and whether a fetch may reach them."""
    return spark.createDataFrame([(a,) for a, _ in _ADDRESSES], "address string").select("address", addresses.address_kind("address").alias("kind"))


# --- citations: order and sets ---


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY answer_id, url ORDER BY citation_index, citation_id) AS r FROM ({_C})), f AS (SELECT * FROM c WHERE r = 1)
  SELECT answer_id, url, citation_index, CASE WHEN is_cited THEN count(*) FILTER (is_cited) OVER (PARTITION BY answer_id ORDER BY citation_index, citation_id) - 1 END AS cited_ordinal FROM f""")
def cited_position_dedupe(spark, sf):
    """The first citation of each url of an answer, and its ordinal among the cited ones. Lists are an answer's own."""
    c = rates.latest(_t(spark, sf, "citations"), ["citation_id"])
    first = c.groupBy("answer_id", "url").agg(F.min(F.struct("citation_index", "citation_id", F.coalesce("is_cited", F.lit(False)).alias("is_cited"))).alias("f"))
    per = first.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("f", "url"))).alias("l"))
    # the cited ones among them in order: a citation's ordinal is its place there
    rows = per.withColumn("cited", F.transform(F.filter("l", lambda x: x["f"]["is_cited"]), lambda x: x["f"])).select("answer_id", "cited", F.explode("l").alias("x"))
    return rows.select("answer_id", "x.url", "x.f.citation_index", F.when(F.col("x.f.is_cited"), F.array_position("cited", F.col("x.f")) - 1).alias("cited_ordinal"))


@query(f"WITH c AS ({_C}) SELECT DISTINCT answer_id, url FROM c r WHERE NOT coalesce(is_cited, false) AND NOT EXISTS (SELECT 1 FROM c x WHERE x.answer_id = r.answer_id AND x.url = r.url AND x.is_cited)")
def retrieved_only_sources(spark, sf):
    c = rates.latest(_t(spark, sf, "citations"), ["citation_id"])
    return c.groupBy("answer_id", "url").agg(F.bool_or(F.coalesce("is_cited", F.lit(False))).alias("any")).where("not any").select("answer_id", "url")


# --- spans ---

_VALID = f"""WITH a AS ({_A}), ci AS (SELECT answer_id, list(DISTINCT citation_index) AS cited FROM ({_C}) WHERE is_cited GROUP BY 1),
  v AS (SELECT a.answer_id, answer_text, spans, list_filter(spans, lambda s: coalesce(s.span_start >= 0 AND s.span_start < s.span_end AND s.span_end <= length(answer_text) AND len(s.citation_indexes) > 0 AND len(list_filter(s.citation_indexes, lambda i: NOT list_contains(coalesce(cited, []), i))) = 0, false)) AS kept FROM a LEFT JOIN ci USING (answer_id))"""


@query(f"{_VALID} SELECT answer_id, len(spans)::int AS n_spans, (len(spans) - len(kept))::int AS n_dropped, list_sum(list_transform(kept, lambda s: s.span_end - s.span_start))::bigint AS kept_chars FROM v")
def span_validation(spark, sf):
    v = spans.validated(rates.latest(_t(spark, sf, "answers"), ["answer_id"]), rates.latest(_t(spark, sf, "citations"), ["citation_id"]))
    chars = F.aggregate("kept", F.lit(0), lambda a, s: a + s["span_end"] - s["span_start"])
    return v.select("answer_id", "n_spans", "n_dropped", F.when(F.size("kept") > 0, chars).cast("long").alias("kept_chars"))


@query(f"""{_VALID}, s AS (SELECT answer_id, unnest(kept) AS s FROM v), e AS (SELECT answer_id, unnest(list_distinct(s.citation_indexes)) AS citation_index FROM s), n AS (SELECT answer_id, citation_index, count(*) AS n FROM e GROUP BY 1, 2)
  SELECT c.answer_id, c.citation_index, c.url, coalesce(n, 0) AS n_spans FROM ({_C}) c LEFT JOIN n USING (answer_id, citation_index) WHERE is_cited""")
def supported_sources(spark, sf):
    a, c = rates.latest(_t(spark, sf, "answers"), ["answer_id"]), rates.latest(_t(spark, sf, "citations"), ["citation_id"])
    return spans.supported(spans.validated(a, c), c).select("answer_id", "citation_index", "url", "n_spans")


@query(f"""{_VALID}, s AS (SELECT answer_id, answer_text, list_sort(list_transform(kept, lambda s: {{'a': s.span_start, 'b': s.span_end, 'ix': list_sort(list_distinct(s.citation_indexes))}})) AS l FROM v),
  e AS (SELECT answer_id, answer_text, unnest(l) AS x, generate_subscripts(l, 1) AS no FROM s), f AS (SELECT answer_id, no, regexp_replace(substr(answer_text, x.a + 1, x.b - x.a), '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g') AS t, unnest(x.ix) AS citation_index FROM e),
  one AS (SELECT answer_id, citation_index, arg_min(t, no) AS t FROM f GROUP BY 1, 2)
  SELECT c.answer_id, c.citation_index, CASE WHEN length(t) > 160 THEN regexp_replace(left(t, 160), '[\\s\\p{{Z}}\\x{{85}}]+$', '') || '…' ELSE t END AS first_excerpt FROM ({_C}) c JOIN one USING (answer_id, citation_index) WHERE is_cited""")
def span_excerpts(spark, sf):
    a, c = rates.latest(_t(spark, sf, "answers"), ["answer_id"]), rates.latest(_t(spark, sf, "citations"), ["citation_id"])
    return spans.supported(spans.validated(a, c), c).where("n_spans > 0").select("answer_id", "citation_index", "first_excerpt")


@query(f"SELECT engine, CASE WHEN spans IS NULL THEN 'not_recorded' WHEN len(spans) = 0 THEN 'none' ELSE 'recorded' END AS spans_status, CASE WHEN searches IS NULL THEN 'not_recorded' WHEN len(searches) = 0 AND NOT coalesce(params.search_ran, true) THEN 'not_searched' WHEN len(searches) = 0 THEN 'no_query_recorded' ELSE 'recorded' END AS searches_status, count(*) AS n FROM ({_A}) GROUP BY 1, 2, 3")
def recorded_statuses(spark, sf):
    a = rates.latest(_t(spark, sf, "answers"), ["answer_id"])
    return a.groupBy("engine", spans.spans_status(F.col("spans")).alias("spans_status"), spans.searches_status(F.col("searches"), F.col("params.search_ran")).alias("searches_status")).agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT answer_id, answer_text AS t, octet_length(encode(answer_text)) AS n FROM ({_A}) WHERE answer_text IS NOT NULL), b AS (SELECT answer_id, n, list_transform(range(0, length(t) + 1), lambda i: octet_length(encode(left(t, i)))) AS starts FROM t)
  SELECT DISTINCT answer_id, (n * r.k // 16)::bigint AS byte_at, (list_position(starts, n * r.k // 16) - 1)::bigint AS point_at FROM b, unnest(range(17)) AS r(k)""")
def byte_to_code_point(spark, sf):
    """Seventeen byte offsets of each answer as code points; null inside a character."""
    n = F.octet_length("answer_text").cast("long")
    at = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.floor(n * k / 16))
    points = F.transform(F.array_distinct(at), lambda b: F.struct(b.alias("byte_at"), tx.byte_to_code_point(F.col("answer_text"), b.cast("int")).cast("long").alias("point_at")))
    a = rates.latest_of(_t(spark, sf, "answers").where("answer_text is not null"), ["answer_id"], points.alias("p"))
    return a.select("answer_id", F.explode("p").alias("p")).select("answer_id", "p.byte_at", "p.point_at")


# --- quotes ---

_PAGE = f"SELECT DISTINCT ON (url) url, fetch_status, fetched_at, text AS page FROM ({_P}) ORDER BY url, (fetch_status = 'ok') DESC, fetched_at DESC, page_id DESC"
_ONE = lambda c: f"regexp_replace(regexp_replace({c}, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'), '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"
_CMP = lambda c: f"replace(lower({_ONE(c)}), 'ß', 'ss')"


def _normal(c: str) -> str:
    c = f"regexp_replace({c}, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    c = f"regexp_replace({c}, '(?m)^\\s{{0,3}}#{{1,6}}\\s+', '', 'g')"
    c = f"regexp_replace({c}, '(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+', '', 'g')"
    c = f"regexp_replace({c}, '\\*\\*|__|`', '', 'g')"
    return _ONE(f"regexp_replace(regexp_replace({c}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g'), '(?:\\.\\.\\.|…)\\s*$', '')")


_CHECKED = f"""WITH c AS ({_C}), p AS ({_PAGE}),
  r AS (SELECT citation_id, engine, cited_text, CASE WHEN coalesce(cited_text, '') = '' THEN 'no_cited_text' WHEN p.url IS NULL THEN 'not_fetched' WHEN fetch_status <> 'ok' THEN 'fetch_' || fetch_status WHEN coalesce(page, '') = '' THEN 'no_page_text' END AS why, {_normal('cited_text')} AS q, page
    FROM c LEFT JOIN p ON c.url = p.url WHERE is_cited),
  m AS (SELECT *, why IS NULL AND contains(page, q) AS ex, why IS NULL AND contains({_CMP('page')}, {_CMP('q')}) AS whole, list_filter(list_transform(regexp_split_to_array(cited_text, '\\n+'), lambda x: {_normal('x')}), lambda x: x <> '') AS ps FROM r),
  n AS (SELECT *, len(list_filter(ps, lambda x: contains({_CMP('page')}, {_CMP('x')}))) AS hits FROM m),
  o AS (SELECT citation_id, engine, cited_text, why, CASE WHEN why IS NULL THEN ex END AS exact_match, CASE WHEN why IS NULL THEN whole OR (len(ps) > 1 AND hits = len(ps)) END AS normalized_match, CASE WHEN why IS NULL THEN CASE WHEN whole THEN 1 ELSE len(ps) END END::int AS pieces, CASE WHEN why IS NULL THEN CASE WHEN whole THEN 1 ELSE hits END END::int AS pieces_found FROM n),
  d AS (SELECT *, CASE WHEN why IS NOT NULL THEN 'not_checkable' WHEN normalized_match THEN 'found' ELSE 'not_found' END AS result FROM o)"""


def _checked(spark, sf):
    return quotes.checked(_t(spark, sf, "citations"), _t(spark, sf, "fetched_pages"))


@query(f"{_CHECKED} SELECT citation_id, why AS not_comparable_reason, exact_match, normalized_match, pieces, pieces_found, result FROM d")
def faithfulness_rows(spark, sf):
    return _checked(spark, sf).select("citation_id", "not_comparable_reason", "exact_match", "normalized_match", "pieces", "pieces_found", "result")


@query(f"""{_CHECKED} SELECT engine, count(*) AS cited, count(*) FILTER (coalesce(cited_text, '') <> '') AS with_quote, count(*) FILTER (result = 'found') AS found, count(*) FILTER (result = 'not_found') AS not_found, count(*) FILTER (coalesce(cited_text, '') <> '' AND result = 'not_checkable') AS not_checkable, count(*) FILTER (result <> 'not_checkable') AS checked,
  CASE WHEN count(*) FILTER (coalesce(cited_text, '') <> '') = 0 THEN 'not_observable' WHEN count(*) FILTER (result <> 'not_checkable') > 0 THEN 'ok' ELSE 'not_checkable' END AS status FROM d GROUP BY 1""")
def faithfulness_summary(spark, sf):
    return quotes.summary(_checked(spark, sf))


_SPACELESS = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}]"
_words = lambda c: f"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), CASE WHEN by_char THEN '[\\p{{L}}\\p{{N}}]' ELSE '[\\p{{L}}\\p{{N}}_]+' END)"


@query(f"""WITH c AS ({_C}), p AS ({_PAGE}), q AS (SELECT citation_id, url, {_normal('cited_text')} AS q FROM c WHERE is_cited AND cited_text <> ''),
  x AS (SELECT citation_id, q, page, regexp_matches(page, '{_SPACELESS}') OR regexp_matches(q, '{_SPACELESS}') AS by_char FROM q JOIN p USING (url) WHERE fetch_status = 'ok' AND page <> ''), tok AS (SELECT citation_id, {_words('q')} AS tq, {_words('page')} AS tp FROM x),
  need AS (SELECT citation_id, t, count(*) AS k FROM (SELECT citation_id, unnest(tq) AS t FROM tok) GROUP BY 1, 2), pos AS (SELECT citation_id, unnest(tp) AS t, generate_subscripts(tp, 1) AS i FROM tok),
  useful AS (SELECT citation_id, t, i, k, len(tq) AS n FROM pos JOIN need USING (citation_id, t) JOIN tok USING (citation_id)),
  win AS (SELECT a.citation_id, a.i AS s, b.t, least(count(*), any_value(b.k)) AS hit, any_value(a.n) AS n FROM (SELECT DISTINCT citation_id, i, n FROM useful) a JOIN useful b ON a.citation_id = b.citation_id AND b.i >= a.i AND b.i < a.i + a.n GROUP BY 1, 2, 3),
  best AS (SELECT citation_id, max(h) / any_value(n) AS score FROM (SELECT citation_id, s, sum(hit) AS h, any_value(n) AS n FROM win GROUP BY 1, 2) GROUP BY 1)
  SELECT citation_id, round(coalesce(score, 0), 4) AS score FROM tok LEFT JOIN best USING (citation_id)""")
def quote_best_window(spark, sf):
    """Of quotes that can be compared: the best share of words in any window of the page. The SQL counts every window."""
    c = _t(spark, sf, "citations").where(F.col("is_cited") & quotes.quoted())
    q = rates.latest_of(c, ["citation_id"], "url", tx.normal_quote(F.col("cited_text")).alias("quote"))
    p = quotes.page_for_url(_t(spark, sf, "fetched_pages")).where("fetch_status = 'ok' and text <> ''")
    return quotes.window_scores(q, p, "citation_id", "quote", "url", "text")


@query(f"""WITH a AS ({_A}), c AS ({_C}), p AS ({_PAGE}) SELECT citation_id, a.engine AS platform, fetch_status, CASE WHEN coalesce(cited_text, '') = '' THEN 'no_cited_text' WHEN coalesce(fetch_status, '') <> 'ok' THEN 'fetch_' || coalesce(fetch_status, 'none') WHEN coalesce(page, '') = '' THEN 'no_fetched_text' END AS not_comparable_reason, length(coalesce(cited_text, ''))::int AS cited_text_len, length(coalesce(page, ''))::int AS fetched_text_len, round((epoch_us(fetched_at) - epoch_us(observed_at)) / 1e6, 3) AS fetch_delay_seconds FROM c JOIN a USING (answer_id) LEFT JOIN p ON p.url = c.url WHERE is_cited""")
def gap_rows(spark, sf):
    g = quotes.gap_rows(_t(spark, sf, "answers"), _t(spark, sf, "citations"), _t(spark, sf, "fetched_pages"))
    return g.select("citation_id", "platform", "fetch_status", "not_comparable_reason", "cited_text_len", "fetched_text_len", "fetch_delay_seconds")


@query(f"""WITH p AS (SELECT DISTINCT url FROM ({_P}) WHERE text_method = 'html-text-2' AND fetch_status IN {quotes.DEFINITIVE!r}) SELECT DISTINCT url FROM ({_C}) c WHERE is_cited AND coalesce(cited_text, '') <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE p.url = c.url)""")
def urls_to_fetch(spark, sf):
    return quotes.to_fetch(rates.latest(_t(spark, sf, "citations"), ["citation_id"]), _t(spark, sf, "fetched_pages"), "html-text-2")


@query(f"SELECT page_id, length({_ONE('text')})::int AS n_chars FROM ({_P}) WHERE text IS NOT NULL")
def visible_text_len(spark, sf):
    """Page text wrapped in markup and read back: tags, scripts and entities must leave no trace."""
    p = _t(spark, sf, "fetched_pages").where("text is not null")
    t = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    markup = F.concat(F.lit("<html><style>p{}</style><script>if(a<b){'</p>'}</script><nav><p>"), t, F.lit("</p></nav><svg><title>x</title></svg>"))
    return rates.latest_of(p, ["page_id"], F.length(tx.one_blank(visible_text(markup))).alias("n_chars"))


@query(f"SELECT citation_id, replace(regexp_replace(title, '([<>\\[\\]*`|])', '\\\\\\1', 'g'), chr(10), ' ') AS cell FROM ({_C}) WHERE title IS NOT NULL")
def markdown_cells(spark, sf):
    return rates.latest_of(_t(spark, sf, "citations").where("title is not null"), ["citation_id"], tx.markdown_cell(F.col("title")).alias("cell"))


@query(f"""{_CHECKED}, a AS ({_A}), s AS (SELECT answer_id, count(*) AS n_sources, count(*) FILTER (is_cited) AS n_cited FROM c GROUP BY 1), f AS (SELECT answer_id, count(*) FILTER (result = 'found') AS n_found, count(*) FILTER (result = 'not_found') AS n_not_found FROM d JOIN c USING (citation_id) GROUP BY 1)
  SELECT answer_id, 'row-' || engine || '-q' || lpad(query_index::varchar, 2, '0') || '-r' || repeat_no AS row_id, source_file, coalesce(n_sources, 0) AS n_sources, coalesce(n_cited, 0) AS n_cited, coalesce(n_found, 0) AS n_found, coalesce(n_not_found, 0) AS n_not_found FROM a LEFT JOIN s USING (answer_id) LEFT JOIN f USING (answer_id) WHERE NOT coalesce(params.no_fixture, false)""")
def evidence_rows(spark, sf):
    e = evidence.evidence_rows(_t(spark, sf, "answers"), _t(spark, sf, "citations"), _checked(spark, sf))
    return e.select("answer_id", "row_id", "source_file", "n_sources", "n_cited", "n_found", "n_not_found")


# --- runs ---

_TASKS = "WITH m AS (SELECT DISTINCT ON (run_id) * FROM run_manifests), e AS (SELECT run_id, unnest(list_sort(map_keys(engines))) AS engine, generate_subscripts(list_sort(map_keys(engines)), 1) - 1 AS engine_pos, prompt_set.n_queries AS q, repeats FROM m), t AS (SELECT run_id, engine, engine_pos, qi.query_index, rn.repeat_no FROM e, unnest(range(q)) AS qi(query_index), unnest(range(repeats)) AS rn(repeat_no))"


@query(f"{_TASKS} SELECT run_id, engine, engine_pos::int AS engine_pos, query_index::int AS query_index, repeat_no::int AS repeat_no FROM t")
def plan_tasks(spark, sf):
    return planning.tasks(_t(spark, sf, "run_manifests"))


@query(f"{_TASKS} SELECT run_id, engine, query_index::int AS query_index, repeat_no::int AS repeat_no FROM t WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.run_id = t.run_id AND a.engine = t.engine AND a.query_index = t.query_index AND a.repeat_no = t.repeat_no)")
def resume_missing(spark, sf):
    return planning.missing(planning.tasks(_t(spark, sf, "run_manifests")), _t(spark, sf, "answers")).select("run_id", "engine", "query_index", "repeat_no")


@query(f"{_TASKS}, u AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY repeat_no, query_index, engine_pos) - 1 AS place FROM t WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.run_id = t.run_id AND a.engine = t.engine AND a.query_index = t.query_index AND a.repeat_no = t.repeat_no)) SELECT run_id, place::int AS place, engine, query_index::int AS query_index, repeat_no::int AS repeat_no FROM u WHERE place < {CAP}")
def plan_capped(spark, sf):
    todo = planning.missing(planning.tasks(_t(spark, sf, "run_manifests")), _t(spark, sf, "answers"))
    return planning.capped(todo, CAP).select("run_id", "place", "engine", "query_index", "repeat_no")


@query(f"""{_TASKS}, p AS (SELECT run_id, engine, count(*) AS planned FROM t GROUP BY 1, 2), d AS (SELECT run_id, engine, count(*) AS done, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM ({_A}) GROUP BY 1, 2),
  f AS (SELECT run_id, engine, count(*) AS failed FROM (SELECT DISTINCT run_id, engine, query_index, repeat_no FROM call_errors c WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.run_id = c.run_id AND a.engine = c.engine AND a.query_index = c.query_index AND a.repeat_no = c.repeat_no)) GROUP BY 1, 2)
  SELECT run_id, engine, coalesce(planned, 0) AS planned, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, coalesce(models, '') AS models FROM p FULL JOIN d USING (run_id, engine) FULL JOIN f USING (run_id, engine)""")
def run_settle(spark, sf):
    return planning.on_disk(_t(spark, sf, "answers"), _t(spark, sf, "call_errors"), _t(spark, sf, "run_manifests"))


@query(f"SELECT run_id, CASE WHEN count(DISTINCT raw_status) = 1 THEN min(raw_status) WHEN count(DISTINCT raw_status) > 1 THEN 'mixed' END AS raw_status, string_agg(DISTINCT record_schema, ',' ORDER BY record_schema) AS schemas, count(*) FILTER (record_schema = 'answer-1') AS n_legacy FROM ({_A}) GROUP BY 1")
def raw_status_and_schemas(spark, sf):
    return planning.stored_kinds(_t(spark, sf, "answers"))


@query(f"SELECT engine, count(*) AS answers, count(token_usage) AS with_usage, sum(token_usage.input_tokens)::bigint AS input_tokens, sum(token_usage.output_tokens)::bigint AS output_tokens, sum(token_usage.reasoning_tokens)::bigint AS reasoning_tokens, sum(token_usage.total_tokens)::bigint AS total_tokens, sum(search_count)::bigint AS searches, count(search_count) AS with_search_count FROM ({_A}) WHERE NOT coalesce(params.no_fixture, false) GROUP BY 1")
def usage_totals(spark, sf):
    return planning.token_totals(_t(spark, sf, "answers"))


def _changed(same: str) -> str:
    return f"WITH m AS (SELECT DISTINCT ON (run_id) run_id, brand, started_at, prompt_set.set_version AS v, prompt_set.set_hash AS h FROM run_manifests WHERE run_mode = 'live') SELECT m.run_id, count(*) AS n_earlier, arg_min(e.run_id, e.started_at) AS earlier FROM m JOIN m e ON {same} m.v = e.v AND e.started_at < m.started_at AND e.h <> m.h GROUP BY 1"


@query(_changed("m.brand = e.brand AND"))
def freeze_guard(spark, sf):
    return planning.changed_prompts(_t(spark, sf, "run_manifests"))


@query(_changed(""))
def version_hashes(spark, sf):
    """The guard across brands: the brands of the test tables differ, so their versions have other hashes."""
    return planning.changed_prompts(_t(spark, sf, "run_manifests"), ("v",))


@query(f"SELECT engine, round(sum(cost_estimate_usd), 4) AS usd, count(cost_estimate_usd) AS answers_priced, count(*) - count(cost_estimate_usd) AS answers_unpriced FROM ({_A}) WHERE NOT coalesce(params.no_fixture, false) GROUP BY 1")
def cost_totals(spark, sf):
    return planning.cost_totals(_t(spark, sf, "answers"))


@query(f"""{_CHECKED}, runs AS (SELECT DISTINCT ON (run_id) run_id, run_mode FROM run_manifests), dx AS (SELECT d.*, run_mode FROM d JOIN c USING (citation_id) JOIN ({_A}) a USING (answer_id) JOIN runs USING (run_id)), g AS (
  SELECT run_mode, count(*) FILTER (coalesce(cited_text, '') <> '') AS with_quote, count(*) FILTER (coalesce(cited_text, '') <> '' AND why IS DISTINCT FROM 'not_fetched') AS looked_up, count(*) FILTER (result <> 'not_checkable') AS checked FROM dx GROUP BY 1)
  SELECT *, CASE WHEN with_quote = 0 THEN 'not_observable' WHEN looked_up = 0 THEN 'not_checked' WHEN checked = 0 THEN 'not_checkable' ELSE 'ok' END AS status FROM g""")
def instrument_check(spark, sf):
    """Whether the quote check is at work, by the mode of the runs."""
    runs = _t(spark, sf, "run_manifests").select("run_id", "run_mode").dropDuplicates(["run_id"])
    a = rates.latest_of(_t(spark, sf, "answers"), ["answer_id"], "run_id").join(runs, "run_id").select("answer_id", "run_mode")
    return quotes.instrument(_checked(spark, sf).join(a, "answer_id"))


@query(f"""WITH a AS ({_A}) SELECT engine, count(*) AS answers, count(*) FILTER (NOT coalesce(cited_sources_available, false)) AS without_citations, count(*) FILTER (params.empty_citation_channel) AS empty_channel, count(*) FILTER (retrieved_set_available) AS with_retrieved_set, coalesce(sum(spans_dropped), 0)::bigint AS spans_dropped, count(*) FILTER (NOT coalesce(params.search_ran, true)) AS not_searched, count(*) FILTER (model <> model_requested) AS other_model FROM a WHERE NOT coalesce(params.no_fixture, false) GROUP BY 1""")
def observability(spark, sf):
    """What could be observed, by engine: the counts that a report's notices are made of."""
    return planning.observability(_t(spark, sf, "answers"))


@query(f"""{_TASKS}, p AS (SELECT run_id, engine, count(*) AS planned FROM t GROUP BY 1, 2), d AS (SELECT run_id, engine, count(*) AS done FROM ({_A}) GROUP BY 1, 2)
  SELECT run_id, count(*) AS engines, count(*) FILTER (coalesce(done, 0) = planned) AS engines_whole, sum(planned)::bigint AS planned, coalesce(sum(done), 0)::bigint AS done, bool_and(coalesce(done, 0) = planned) AS whole FROM p LEFT JOIN d USING (run_id, engine) GROUP BY 1""")
def run_completeness(spark, sf):
    """Which runs have every planned answer, from the rows that are there."""
    return planning.completeness(planning.on_disk(_t(spark, sf, "answers"), _t(spark, sf, "call_errors"), _t(spark, sf, "run_manifests")))


@query(f"SELECT 'answer' AS kind, answer_id::varchar AS id, 'q' || lpad(query_index::varchar, 2, '0') || '_r' || repeat_no || '.json' AS name FROM ({_A}) UNION ALL SELECT DISTINCT 'page', url, left(sha256(url), 24) || '.json' FROM fetched_pages WHERE url IS NOT NULL UNION ALL SELECT DISTINCT 'run', run_id, strftime(started_at, '%Y%m%dT%H%M%SZ') FROM run_manifests")
def stored_names(spark, sf):
    """The names under which answers, pages and runs are stored."""
    a = rates.latest_of(_t(spark, sf, "answers"), ["answer_id"], runs.answer_file("query_index", "repeat_no").alias("name"))
    p = _t(spark, sf, "fetched_pages").where("url is not null").select(F.lit("page").alias("kind"), F.col("url").alias("id"), runs.page_file("url").alias("name")).distinct()
    r = _t(spark, sf, "run_manifests").select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), records.run_id("started_at").alias("name")).distinct()
    return a.select(F.lit("answer").alias("kind"), F.col("answer_id").cast("string").alias("id"), "name").union(p).union(r)


@query("WITH e AS (SELECT DISTINCT * FROM call_errors) SELECT engine, error_type, count(*) AS n, count(error_message) AS with_message, count(DISTINCT run_id) AS n_runs FROM e GROUP BY 1, 2")
def error_summary(spark, sf):
    e = _t(spark, sf, "call_errors").distinct()
    return e.groupBy("engine", "error_type").agg(F.count("*").alias("n"), F.count("error_message").alias("with_message"), F.countDistinct("run_id").alias("n_runs"))


@query("SELECT run_id, left(sha256(to_json({'brand': brand, 'repeats': repeats})), 24) AS digest, CASE WHEN trim(regexp_replace(lower(brand), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-') = '' THEN 'brand' ELSE trim(regexp_replace(lower(brand), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-') END AS slug FROM (SELECT DISTINCT ON (run_id) * FROM run_manifests) WHERE brand IS NOT NULL AND repeats IS NOT NULL")
def run_digests(spark, sf):
    m = rates.latest(_t(spark, sf, "run_manifests"), ["run_id"]).where("brand is not null and repeats is not null")
    return m.select("run_id", F.left(F.sha2(F.to_json(F.struct("brand", "repeats")), 256), F.lit(24)).alias("digest"), hosts.slug(F.col("brand")).alias("slug"))


@query(f"""WITH a AS (SELECT DISTINCT ON (query_text, engine, repeat_no) query_text, engine, repeat_no, length(answer_text) AS n FROM ({_A}) WHERE NOT coalesce(params.no_fixture, false) ORDER BY query_text, engine, repeat_no, answer_id), v AS (SELECT query_text, engine, list(n ORDER BY repeat_no) AS variants FROM a GROUP BY 1, 2)
  SELECT query_text, engine, r.repeat_no::int AS repeat_no, variants[r.repeat_no % len(variants) + 1]::int AS n_chars FROM v, unnest(range(8)) AS r(repeat_no)""")
def fixture_answers(spark, sf):
    """A question's recorded answers replayed in turn: the variant of a repeat is its number modulo how many there are."""
    a = rates.latest(_t(spark, sf, "answers"), ["answer_id"]).where(~rates.is_placeholder())
    one = a.groupBy("query_text", "engine", "repeat_no").agg(F.min_by(F.length("answer_text"), "answer_id").alias("n"))
    v = one.groupBy("query_text", "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat_no", "n"))), lambda s: s["n"]).alias("variants"))
    r = v.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return r.select("query_text", "engine", "repeat_no", F.get("variants", F.pmod("repeat_no", F.size("variants"))).alias("n_chars"))


_ENGINES = ("anthropic", "google", "openai")


@query(f"""WITH a AS (SELECT DISTINCT ON (query_text, engine, repeat_no) query_text, engine, repeat_no, answer_id, length(answer_text) AS n, token_usage.input_tokens AS tok FROM ({_A}) WHERE NOT coalesce(params.no_fixture, false) ORDER BY query_text, engine, repeat_no, answer_id), v AS (SELECT query_text, engine, list({{'id': answer_id, 'n': n, 'tok': tok}} ORDER BY repeat_no) AS variants FROM a GROUP BY 1, 2),
  asked AS (SELECT query_text, engine, r.repeat_no::int AS repeat_no FROM (SELECT DISTINCT query_text FROM answers), unnest({list(_ENGINES)!r}) AS e(engine), unnest(range(4)) AS r(repeat_no)),
  c AS (SELECT *, coalesce(is_cited, false) AS cited, row_number() OVER (PARTITION BY answer_id ORDER BY citation_index, citation_id) AS no, sum(coalesce(is_cited, false)::int) OVER (PARTITION BY answer_id ORDER BY citation_index, citation_id) - 1 AS ordinal FROM ({_C})), o AS (SELECT answer_id, string_agg(CASE WHEN cited THEN ordinal::varchar ELSE '-' END, ',' ORDER BY no) AS cited_order FROM c GROUP BY 1),
  x AS (SELECT query_text, engine, repeat_no, variants IS NULL AS no_fixture, variants[repeat_no % len(variants) + 1] AS v FROM asked LEFT JOIN v USING (query_text, engine))
  SELECT query_text, engine, repeat_no, no_fixture, v.id AS answer_id, v.n::int AS n_chars, v.tok AS input_tokens, cited_order FROM x LEFT JOIN o ON o.answer_id = v.id""")
def fixture_replay(spark, sf):
    """Every question put to every engine four times, answered from what is recorded; placeholders where nothing is."""
    a = _t(spark, sf, "answers")
    recorded = rates.latest_of(a.where(~rates.is_placeholder()), ["answer_id"], "query_text", "engine", "repeat_no", F.length("answer_text").alias("n_chars"), F.col("token_usage.input_tokens").alias("input_tokens"))
    asked = a.select("query_text").distinct().withColumn("engine", F.explode(F.array(*map(F.lit, _ENGINES)))).withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.lit(3))))
    orders = fixtures.cited_order(rates.latest_of(_t(spark, sf, "citations"), ["citation_id"], "answer_id", "citation_index", "is_cited"))
    return fixtures.replay(asked, recorded, "answer_id", "n_chars", "input_tokens").join(orders, "answer_id", "left")


_TURN = "[{'role': 'user', 'content': query_text}]"


@query(f"""SELECT DISTINCT engine, CASE engine WHEN 'anthropic' THEN '{{"model":' || to_json(model_requested) || ',"max_tokens":{requests.MOST_TOKENS},"tools":{requests.ANTHROPIC_SEARCH},"messages":' || to_json({_TURN}) || '}}'
  WHEN 'openai' THEN '{{"model":' || to_json(model_requested) || ',"tools":{requests.OPENAI_SEARCH},"input":' || to_json({_TURN}) || '}}'
  WHEN 'google' THEN '{{"contents":' || to_json([{{'role': 'user', 'parts': [{{'text': query_text}}]}}]) || ',"tools":{requests.GOOGLE_SEARCH}}}' END AS body FROM answers WHERE model_requested IS NOT NULL AND query_text IS NOT NULL""")
def request_bodies(spark, sf):
    a = _t(spark, sf, "answers").where("model_requested is not null and query_text is not null").select("engine", "model_requested", "query_text").distinct()
    return a.select("engine", requests.request_body(F.col("engine"), F.col("model_requested"), F.col("query_text")).alias("body")).distinct()


@query("SELECT * FROM (VALUES ('zh', true, 1.0), ('en', true, 1.0)) t(label, exact_match, score)")
def instrument_controls(spark, sf):
    """Known good pairs of quote and page."""
    return quotes.controls(spark)


@query("WITH m AS (SELECT DISTINCT ON (run_id) run_id, engines FROM run_manifests), e AS (SELECT run_id, unnest(map_entries(engines)) AS x FROM m) SELECT run_id, sum(x.value.planned)::bigint AS planned, sum(x.value.done)::bigint AS done, coalesce(string_agg(DISTINCT x.key, ',' ORDER BY x.key) FILTER (x.value.ask_status LIKE 'skipped%'), '') AS not_asked FROM e GROUP BY 1")
def run_notices(spark, sf):
    return planning.notices(_t(spark, sf, "run_manifests"))


@query(f"WITH m AS (SELECT DISTINCT ON (run_id) run_id, engines FROM run_manifests), e AS (SELECT run_id, unnest(map_keys(engines)) AS engine FROM m), n AS (SELECT run_id, engine, count(*) AS answers, count(*) FILTER (intent = 'recommendation') AS recommendations FROM ({_A}) WHERE NOT coalesce(params.no_fixture, false) GROUP BY 1, 2) SELECT run_id, engine, answers, recommendations FROM e LEFT JOIN n USING (run_id, engine)")
def configured_engines(spark, sf):
    """Every engine of every run with what it gave: null, and not 0, for one that gave nothing."""
    a = rates.latest_of(_t(spark, sf, "answers").where(~rates.is_placeholder()), ["answer_id"], "run_id", "engine", "intent")
    return planning.with_metrics(_t(spark, sf, "run_manifests"), a.groupBy("run_id", "engine").agg(F.count("*").alias("answers"), F.count_if(F.col("intent") == "recommendation").alias("recommendations")))


@query(f"SELECT engine, count(*) FILTER (contains(lower(answer_text), 'kettle')) AS c, count(*) AS n FROM ({_A}) WHERE NOT coalesce(params.no_fixture, false) GROUP BY 1")
def arriving_answer_counts(spark, sf):
    """The engines' counts after a stream of answer files has been read to its end; re-deliveries count once."""
    files = f"{sf}/answers.parque[t]"  # a stream reads a folder or a pattern
    source = spark.readStream.schema(_t(spark, sf, "answers").schema).parquet(files)
    name = f"arriving_{uuid.uuid4().hex}"
    writer = streaming.mention_counts(source, "kettle", "30 days").writeStream.outputMode("complete").format("memory").queryName(name)
    run = writer.option("checkpointLocation", f"{lineage.folder(spark)}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)  # a row for each engine


# --- payloads ---


def _parsed(spark, sf):
    return payloads.parse(_t(spark, sf, "raw_payloads"))


@query(payload_sql.ANSWERS)
def payload_answers(spark, sf):
    """What each payload says of its answer, and how many sources, spans and searches it has."""
    p = _parsed(spark, sf)
    n = lambda t, c: p[t].groupBy("payload_id").agg(F.count("*").alias(c))
    facts = [c for c in payloads.FACTS if c not in ("empty_citation_channel", "output_includes_reasoning")]
    out = p["answers"].select("payload_id", "platform", F.length("answer_text").alias("n_chars"), *facts)
    for t, c in (("citations", "n_sources"), ("spans", "n_spans"), ("searches", "n_searches")):
        out = out.join(n(t, c), "payload_id", "left").withColumn(c, F.coalesce(c, F.lit(0)))
    return out


@query(payload_sql.CITATIONS)
def payload_citations(spark, sf):
    return _parsed(spark, sf)["citations"]


@query(payload_sql.SPANS)
def payload_spans(spark, sf):
    s = _parsed(spark, sf)["spans"]
    return s.select("payload_id", "platform", "span_start", "span_end", F.array_join(F.transform("citation_indexes", lambda i: i.cast("string")), ",").alias("citation_indexes"))


@query(payload_sql.SEARCHES)
def payload_searches(spark, sf):
    return _parsed(spark, sf)["searches"]


def _records(spark, sf):
    p = rates.latest(_t(spark, sf, "raw_payloads"), ["payload_id"])
    calls = rates.latest_of(_t(spark, sf, "answers"), ["answer_id"], "run_id", "engine", "query_index", "repeat_no", "model_requested", "query_text", "intent", "requested_at", "observed_at", "prompt_set_version", "prompt_set_hash")
    return records.answer_records(p.select("payload_id", "answer_id", "payload").join(calls, "answer_id"), payloads.parse(p))


@query(payload_sql.RECORDS.replace("{_A}", _A))
def answer_records(spark, sf):
    """The stored record of each payload that was read, for the call that its answer belongs to."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(f"n_{c}")
    return _records(spark, sf).select("payload_id", "schema", "run_id", "engine", "query_index", "repeat_no", "model", "model_reported_by_platform", "stop_reason", "prompt_set_version", size("citations"), size("spans"), F.col("usage.output_tokens").alias("output_tokens"), "raw_status", "raw_sha256", "raw_bytes")


@query(payload_sql.STORED.replace("{_A}", _A))
def record_store(spark, sf):
    """The records written to a store and read back from it: what each run and engine has there."""
    r = _records(spark, sf)
    path = f"{lineage.folder(spark)}/records_{uuid.uuid4().hex}"
    records.write_records(r, path)
    back = records.read_records(spark, path, r.schema)
    return back.groupBy("run_id", "engine").agg(F.count("*").alias("records"), F.sum(F.length("answer_text")).alias("n_chars"), F.sum(F.size("citations")).cast("long").alias("citations"), F.count("spans").alias("with_spans"), F.sum("raw_bytes").alias("raw_bytes"), F.min("query_text").alias("first_question"))


@query(payload_sql.VERIFIED)
def verified_platforms(spark, sf):
    return payloads.verified(_parsed(spark, sf))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
