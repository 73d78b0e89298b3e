"""Evidence rows: each answer with what stands behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import spans
from plumbline.operators.rates import is_placeholder, latest


def row_id(engine: str = "engine", query_index: str = "query_index", repeat_no: str = "repeat_no"):
    return F.format_string("row-%s-q%02d-r%d", F.col(engine), F.col(query_index), F.col(repeat_no))


def evidence_rows(answers: DataFrame, citations: DataFrame, checked: DataFrame) -> DataFrame:
    """answer_id, row_id, source_file, excerpt, statuses, numbers of citations and of verdicts."""
    a = latest(answers, ["answer_id"]).where(~is_placeholder())
    c = latest(citations, ["citation_id"]).groupBy("answer_id").agg(F.count("*").alias("n_sources"), F.count_if("is_cited").alias("n_cited"), F.count_if(F.col("is_cited") & F.col("cited_text").isNotNull()).alias("n_quoted"))
    f = checked.groupBy("answer_id").agg(F.count_if(F.col("result") == "found").alias("n_found"), F.count_if(F.col("result") == "not_found").alias("n_not_found"), F.count_if(F.col("result") == "not_checkable").alias("n_not_checkable"))
    rows = a.join(c, "answer_id", "left").join(f, "answer_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return rows.select("answer_id", row_id().alias("row_id"), "source_file", tx.excerpt(F.col("answer_text")).alias("excerpt"), spans.spans_status(F.col("spans")).alias("spans_status"), spans.searches_status(F.col("searches"), F.col("params.search_ran")).alias("searches_status"), *[zero(x) for x in ("n_sources", "n_cited", "n_quoted", "n_found", "n_not_found", "n_not_checkable")])
