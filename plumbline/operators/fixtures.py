"""Recorded answers replayed in place of live ones: no network, and the same for every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "(no recorded answer for this question)"


def variants(recorded: DataFrame, *fields: str) -> DataFrame:
    """query_text, engine, variants: the recorded answers of a question in order of repeat_no; of one repeat the first answer_id. A list is as long as the repeats of a question."""
    one = recorded.groupBy("query_text", "engine", "repeat_no").agg(F.min_by(F.struct(*fields), "answer_id").alias("v"))
    return one.groupBy("query_text", "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("repeat_no", "v"))), lambda s: s["v"]).alias("variants"))


def replay(asked: DataFrame, recorded: DataFrame, *fields: str) -> DataFrame:
    """asked (query_text, engine, repeat_no) with no_fixture and ``fields`` of its answer: the variant of a repeat is its number modulo how many there are. A question without any is a placeholder with null fields, which no rate counts."""
    rows = asked.join(variants(recorded, *fields), ["query_text", "engine"], "left")
    v = F.get("variants", F.pmod("repeat_no", F.size("variants")))
    return rows.withColumn("_v", F.when(F.size("variants") > 0, v)).select("query_text", "engine", "repeat_no", F.col("variants").isNull().alias("no_fixture"), *[F.col(f"_v.{f}").alias(f) for f in fields])


def cited_order(citations: DataFrame) -> DataFrame:
    """answer_id, cited_order: for each citation in order its ordinal among the cited ones, '-' for one that was only retrieved."""
    per = citations.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("citation_index", "citation_id", F.coalesce("is_cited", F.lit(False)).alias("c")))).alias("l"))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        one = F.when(x["c"], s["n"].cast("string")).otherwise("-")
        return F.struct((s["n"] + x["c"].cast("int")).alias("n"), F.concat(s["out"], F.when(s["out"] == "", "").otherwise(","), one).alias("out"))

    return per.select("answer_id", F.aggregate("l", start, step, lambda s: s["out"]).alias("cited_order"))
