"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import lookalike, mixing, mojibake, overlap, packing, quality, tokens, truncation
from plumbline.llm.ranking import cut
from plumbline.operators.lineage import collect_bounded


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    docs, pages = _t(spark, sf, "documents"), _t(spark, sf, "fetched_pages")
    model = mojibake.fit(docs)
    a = mojibake.judge(docs, model, "text", "lang", "doc_id").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("rec_id"), "chain", "restored_text")
    b = mojibake.judge(pages, model, "text", None, "page_id").select(F.lit("fetched_pages").alias("table_name"), F.col("page_id").alias("rec_id"), "chain", "restored_text")
    return a.unionByName(b)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("table_name", "rec_id").distinct()


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("chain <> ''").dropDuplicates(["table_name", "rec_id"])


def _cut_sources(spark: SparkSession, sf: str) -> list:
    return [(_t(spark, sf, "answers"), "answer_id", "answer_text", "answers"), (_t(spark, sf, "citations"), "citation_id", "cited_text", "citations")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.found(_cut_sources(spark, sf))


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    a, c = _t(spark, sf, "answers"), _t(spark, sf, "citations")
    verdicts = truncation.detect(_cut_sources(spark, sf))
    engines = a.groupBy(F.col("answer_id").alias("rec_id")).agg(F.min("engine").alias("label"))
    domains = c.groupBy(F.col("citation_id").alias("rec_id")).agg(F.min("domain").alias("label"))
    one = truncation.rates(verdicts.where("table_name = 'answers'"), engines, "label").withColumn("label_kind", F.lit("engine"))
    two = truncation.rates(verdicts.where("table_name = 'citations'"), domains, "label").withColumn("label_kind", F.lit("domain"))
    return one.unionByName(two)


def p2_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.evidence(truncation.detect(_cut_sources(spark, sf)))


def _reading_sources(spark: SparkSession, sf: str) -> list:
    return [(_t(spark, sf, t), k, x, t) for t, k, x in (("citations", "citation_id", "cited_text"), ("answers", "answer_id", "answer_text"), ("documents", "doc_id", "text"))]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.pairs(cut(lookalike.forms(_reading_sources(spark, sf))))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.classes(cut(lookalike.forms(_reading_sources(spark, sf))))


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every text, changed or not."""
    texts = [df.select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("rec_id"), F.col(text).alias("text")) for df, key, text, name in _reading_sources(spark, sf)]
    every = functools.reduce(DataFrame.unionByName, texts).where("rec_id is not null and text is not null")
    return lookalike.normalise(every.dropDuplicates(["table_name", "rec_id"]), "text").select("table_name", "rec_id", "normal_text")


def _both(spark: SparkSession, sf: str, operator: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    docs = operator(_t(spark, sf, "documents"), "doc_id", "text").withColumn("table_name", F.lit("documents"))
    cites = operator(_t(spark, sf, "citations"), "citation_id", "cited_text").withColumn("table_name", F.lit("citations"))
    return docs.unionByName(cites)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, overlap.pairs).select("table_name", "rec_a", "rec_b")


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, overlap.classes)


def p5_class_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, overlap.class_pairs)


def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, overlap.shares)


def p5_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return _both(spark, sf, overlap.cleaned)


def _capacities(spark: SparkSession, sf: str) -> dict[str, int]:
    return {r["pack_name"]: r["capacity_tokens"] for r in collect_bounded(_t(spark, sf, "pack_sizes"), 1000, "capacities")}


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    sized = tokens.sizes(_t(spark, sf, "documents"), "doc_id", "text")
    return packing.pack(sized, "doc_id", "n_tokens", _capacities(spark, sf))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fills(p7_pack(spark, sf), _capacities(spark, sf))


def p7_summary(spark: SparkSession, sf: str) -> DataFrame:
    return packing.summary(p7_fill(spark, sf))


def p7_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What a packing must keep to: every document placed with all its tokens, no container over its capacity, no place taken twice, nothing split that fits."""
    capacities = _capacities(spark, sf)
    sized = cut(tokens.sizes(_t(spark, sf, "documents"), "doc_id", "text"))
    packed = cut(packing.pack(sized, "doc_id", "n_tokens", capacities))
    fill = packing.fills(packed, capacities).groupBy("pack_name").agg(F.count_if(F.col("room") < 0).alias("overfull"))
    places = packed.where("container is not null").groupBy("pack_name", "container", "place").agg(F.count("*").alias("n")).groupBy("pack_name").agg(F.count_if(F.col("n") > 1).alias("places_taken_twice"))
    limit = F.create_map(*[x for n, c in sorted(capacities.items()) for x in (F.lit(n), F.lit(c))])[F.col("pack_name")]
    per = packed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("placed")).join(sized, "doc_id")
    docs = per.groupBy("pack_name").agg(F.count("*").alias("documents"), F.count_if(F.col("placed") != F.col("n_tokens")).alias("tokens_lost"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= limit)).alias("split_needlessly"))
    return docs.join(fill, "pack_name").join(places, "pack_name")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return cut(tokens.sizes(_t(spark, sf, "documents"), "doc_id", "text", "source"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """As large as all documents with a target; scarce sources are repeated up to their cap and fall short beyond it."""
    return mixing.mix(_sized(spark, sf), "doc_id", "source", "n_tokens", _t(spark, sf, "mix_targets"))


def p8_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The largest mix in which every source has its target share."""
    return mixing.mix(_sized(spark, sf), "doc_id", "source", "n_tokens", _t(spark, sf, "mix_targets"), mixing.EXACT)


def _shares(spark: SparkSession, sf: str, total: str | None) -> DataFrame:
    sized, targets = _sized(spark, sf), _t(spark, sf, "mix_targets")
    mixed = mixing.mix(sized, "doc_id", "source", "n_tokens", targets, total)
    return mixing.shares(mixed, targets, mixing.planned(sized, "source", "n_tokens", targets, total))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf, None)


def p8_exact_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf, mixing.EXACT)


def p8_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What a mix must keep to: no document over the cap, none of another source, and no source off its wanted size by more than its longest document where the cap leaves room."""
    sized, targets = _sized(spark, sf), _t(spark, sf, "mix_targets")
    mixed = cut(mixing.mix(sized, "doc_id", "source", "n_tokens", targets))
    plan = mixing.planned(sized, "source", "n_tokens", targets)
    own = sized.select("doc_id", F.col("source").alias("own"))
    bad = mixed.join(targets, "source").join(own, "doc_id").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("own") != F.col("source")).alias("foreign"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("longest"))
    off = mixing.shares(mixed, targets, plan).join(have, "source", "left").select("source", ((F.col("wanted_tokens") <= F.col("have") * F.col("max_repeats")) & (F.abs(F.col("tokens") - F.col("wanted_tokens")) > F.col("longest"))).alias("off"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return off.join(bad, "source", "left").select("source", zero("over_cap"), zero("foreign"), F.coalesce("off", F.lit(False)).alias("off_target"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    return quality.found(docs, _t(spark, sf, "common_words"), mojibake.fit(docs))


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    return quality.statistics(docs, _t(spark, sf, "common_words"), mojibake.fit(docs))


def p9_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The length of each text and its lines that aren't blank."""
    return quality.statistics(_t(spark, sf, "documents"), _t(spark, sf, "common_words")).select("doc_id", "n_chars", "n_lines")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_rates, p2_evidence, p3_found, p3_forms, p3_classes, p5_found, p5_classes, p5_class_pairs, p5_shares, p5_cleaned, p7_pack, p7_fill, p7_summary, p7_rules, p8_mix, p8_shares, p8_exact, p8_exact_shares, p8_rules, p9_found, p9_statistics, p9_counts)}


# --- SQL ---

_TABLES = (("documents", "doc_id", "text"), ("citations", "citation_id", "cited_text"))


def _p5(select: str) -> str:
    """Over every 200-gram of every distinct text. ``select`` is for each table: x_ its records and texts, t_ its distinct texts, g_ their grams, l_ the links of texts."""
    ctes = ", ".join(
        f"""x_{n} AS (SELECT DISTINCT {k} AS rec, {t} AS c FROM {n} WHERE {k} IS NOT NULL AND {t} IS NOT NULL), t_{n} AS (SELECT c, min(rec) AS class_id, count(*) AS n_copies FROM x_{n} WHERE length(c) >= 200 GROUP BY 1),
    g_{n} AS (SELECT class_id, i, hash(substr(c, i, 200)) AS g FROM t_{n}, unnest(range(1, length(c) - 198)) AS r(i)), d_{n} AS (SELECT DISTINCT class_id, g FROM g_{n}), l_{n} AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM d_{n} a JOIN d_{n} b USING (g) WHERE a.class_id <> b.class_id)"""
        for n, k, t in _TABLES
    )
    return f"WITH {ctes} " + " UNION ALL ".join(select.replace("{n}", n) for n, _, _ in _TABLES)


def oracle_sql() -> dict[str, str]:
    return {
        "p7_rules": "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS tokens_lost, 0 AS split_needlessly, 0 AS overfull, 0 AS places_taken_twice FROM pack_sizes",
        "p8_rules": "SELECT source, 0 AS over_cap, 0 AS foreign, false AS off_target FROM mix_targets",
        "p9_counts": "SELECT doc_id, length(text) AS n_chars, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]*'))) AS n_lines FROM documents",
        "p5_found": _p5("SELECT DISTINCT '{n}' AS table_name, least(a.rec, b.rec) AS rec_a, greatest(a.rec, b.rec) AS rec_b FROM (SELECT a, b FROM l_{n} UNION ALL SELECT class_id, class_id FROM t_{n} WHERE n_copies > 1) l JOIN t_{n} ta ON ta.class_id = l.a JOIN t_{n} tb ON tb.class_id = l.b JOIN x_{n} a ON a.c = ta.c JOIN x_{n} b ON b.c = tb.c WHERE a.rec <> b.rec"),
        "p5_class_pairs": _p5("SELECT '{n}' AS table_name, a AS class_a, b AS class_b FROM l_{n} WHERE a < b"),
        "p5_classes": _p5("SELECT '{n}' AS table_name, rec, class_id, n_copies, (SELECT count(*) FROM l_{n} WHERE a = class_id) AS n_links FROM x_{n} JOIN t_{n} USING (c)"),
        "p5_cleaned": _p5(
            """SELECT '{n}' AS table_name, rec, CASE WHEN class_id < rec THEN '' ELSE coalesce(kept, '') || coalesce(substr(c, reach + 1), c) END AS text FROM x_{n} LEFT JOIN t_{n} USING (c)
      LEFT JOIN (SELECT class_id, string_agg(substr(c, before + 1, i - 1 - before), '' ORDER BY i) FILTER (i > before) AS kept, max(i + 199) AS reach FROM (SELECT class_id, i, coalesce(lag(i + 199) OVER (PARTITION BY class_id ORDER BY i), 0) AS before FROM g_{n} JOIN (SELECT g, min(class_id) AS first FROM d_{n} GROUP BY 1) f USING (g) WHERE first < class_id) JOIN t_{n} USING (class_id) GROUP BY 1) USING (class_id)"""
        ),
        "p5_shares": _p5(
            """SELECT '{n}' AS table_name, rec, length(c) AS n_chars, CASE WHEN n_copies > 1 THEN length(c) ELSE coalesce(cover, 0) END::bigint AS shared_chars, round(CASE WHEN n_copies > 1 THEN length(c) ELSE coalesce(cover, 0) END / length(c), 6) AS shared_share FROM x_{n} LEFT JOIN t_{n} USING (c)
      LEFT JOIN (SELECT class_id, sum(least(200, coalesce(i - before, 200))) AS cover FROM (SELECT class_id, i, lag(i) OVER (PARTITION BY class_id ORDER BY i) AS before FROM g_{n} WHERE g IN (SELECT g FROM d_{n} GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1) USING (class_id) WHERE length(c) > 0"""
        ),
    }
