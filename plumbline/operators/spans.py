"""Answer spans: ranges of an answer and the citations that stand behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx


def span_fits(s: Column, n_chars: Column, cited: Column) -> Column:
    """0 <= start < end <= length, at least one index, and every index that of a cited citation."""
    inside = (s["span_start"] >= 0) & (s["span_start"] < s["span_end"]) & (s["span_end"] <= n_chars)
    known = F.forall(s["citation_indexes"], lambda i: F.array_contains(cited, i))
    return F.coalesce(inside & (F.size(s["citation_indexes"]) > 0) & known, F.lit(False))


def cited_indexes(citations: DataFrame) -> DataFrame:
    """answer_id, cited: the array indexes of an answer's cited citations."""
    return citations.where("is_cited").groupBy("answer_id").agg(F.sort_array(F.collect_set("citation_index")).alias("cited"))


def validated(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, kept (spans in order, indexes sorted), n_spans, n_dropped. A null array stays null: not recorded isn't none."""
    a = answers.select("answer_id", F.length("answer_text").alias("n_chars"), "spans", "answer_text")
    rows = a.join(cited_indexes(citations), "answer_id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<int>")))
    kept = F.filter("spans", lambda s: span_fits(s, F.col("n_chars"), F.col("cited")))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), F.array_sort(F.array_distinct(s["citation_indexes"])).alias("citation_indexes"))))
    return rows.withColumn("kept", ordered).select("answer_id", "answer_text", "kept", F.when(F.col("spans").isNotNull(), F.size("spans")).alias("n_spans"), F.when(F.col("spans").isNotNull(), F.size("spans") - F.size("kept")).alias("n_dropped"))


def spans_status(spans: Column) -> Column:
    return F.when(spans.isNull(), "not_recorded").when(F.size(spans) == 0, "none").otherwise("recorded")


def searches_status(searches: Column, search_ran: Column) -> Column:
    return F.when(searches.isNull(), "not_recorded").when((F.size(searches) == 0) & ~F.coalesce(search_ran, F.lit(True)), "not_searched").when(F.size(searches) == 0, "no_query_recorded").otherwise("recorded")


def excerpt(text: Column, s: Column) -> Column:
    return tx.clip(tx.strip_blanks(text.substr(s["span_start"] + 1, s["span_end"] - s["span_start"])), tx.SPAN_EXCERPT)


def supported(valid: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, citation_index, url, n_spans, first_excerpt: what each cited citation stands behind. A span is exploded by its indexes, so the join is one of equal keys."""
    s = valid.select("answer_id", F.posexplode(F.transform("kept", lambda s: F.struct(excerpt(F.col("answer_text"), s).alias("excerpt"), s["citation_indexes"].alias("ix")))).alias("no", "s"))
    each = s.select("answer_id", "no", "s.excerpt", F.explode("s.ix").alias("citation_index"))
    by = each.groupBy("answer_id", "citation_index").agg(F.count("*").alias("n_spans"), F.min_by("excerpt", "no").alias("first_excerpt"))
    return citations.where("is_cited").select("answer_id", "citation_index", "url").join(by, ["answer_id", "citation_index"], "left").withColumn("n_spans", F.coalesce("n_spans", F.lit(0)))
