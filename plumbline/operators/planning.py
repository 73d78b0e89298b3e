"""What a run still has to ask, and what it has on disk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id", "engine", "query_index", "repeat_no"]


def tasks(manifests: DataFrame) -> DataFrame:
    """run_id, engine, engine_pos, query_index, repeat_no: every call that the manifests plan. Generated in place from counts, no join."""
    m = manifests.dropDuplicates(["run_id"]).where("prompt_set.n_queries > 0 and repeats > 0")
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    e = m.select("run_id", F.posexplode(F.array_sort(F.map_keys("engines"))).alias("engine_pos", "engine"), F.col("prompt_set.n_queries").alias("q"), "repeats")
    return e.withColumn("repeat_no", F.explode(span("repeats"))).withColumn("query_index", F.explode(span("q"))).select("run_id", "engine", "engine_pos", "query_index", "repeat_no")


def missing(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """Planned calls without an answer; failed ones are to be asked again."""
    return planned.join(answers.select(*KEY).distinct(), KEY, "left_anti")


def capped(todo: DataFrame, cap: int) -> DataFrame:
    """The first calls of each run, repeat by repeat: the cap counts what is missing only, so it comes after the anti-join."""
    order = F.struct("repeat_no", "query_index", "engine_pos", "engine")
    # a run's plan is at most queries x repeats x engines, all set by its config
    one = todo.groupBy("run_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, cap).alias("t"))
    return one.select("run_id", F.posexplode("t").alias("place", "t")).select("run_id", "place", "t.*")


def on_disk(answers: DataFrame, errors: DataFrame, manifests: DataFrame) -> DataFrame:
    """run_id, engine, planned, done, failed, models: counts come from what is there, not from what was noted."""
    done = answers.dropDuplicates(["answer_id"]).groupBy("run_id", "engine").agg(F.count("*").alias("done"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    answered = answers.select(*KEY).distinct()
    failed = errors.select(*KEY).distinct().join(answered, KEY, "left_anti").groupBy("run_id", "engine").agg(F.count("*").alias("failed"))
    planned = tasks(manifests).groupBy("run_id", "engine").agg(F.count("*").alias("planned"))
    out = planned.join(done, ["run_id", "engine"], "full").join(failed, ["run_id", "engine"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("run_id", "engine", zero("planned"), zero("done"), zero("failed"), F.coalesce("models", F.lit("")).alias("models"))


def one_or_mixed(values: Column) -> Column:
    """Null for no value, the value for one, 'mixed' for several."""
    return F.when(F.size(values) == 1, values[0]).when(F.size(values) > 1, "mixed")


def stored_kinds(answers: DataFrame) -> DataFrame:
    """run_id, raw_status, schemas, n_legacy."""
    a = answers.dropDuplicates(["answer_id"])
    s = a.groupBy("run_id").agg(F.collect_set("raw_status").alias("r"), F.array_join(F.array_sort(F.collect_set("record_schema")), ",").alias("schemas"), F.count_if(F.col("record_schema") == "answer-1").alias("n_legacy"))
    return s.select("run_id", one_or_mixed(F.col("r")).alias("raw_status"), "schemas", "n_legacy")


def token_totals(answers: DataFrame) -> DataFrame:
    """By engine: sums of what was reported; a sum of nothing is null, not 0."""
    from plumbline.operators.rates import is_placeholder

    a = answers.dropDuplicates(["answer_id"]).where(~is_placeholder())
    sums = [F.sum(f"token_usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")]
    return a.groupBy("engine").agg(F.count("*").alias("answers"), F.count("token_usage").alias("with_usage"), *sums, F.sum("search_count").alias("searches"), F.count("search_count").alias("with_search_count"))


def cost_totals(answers: DataFrame) -> DataFrame:
    """By engine: the sum of the recorded estimates and how many answers have one; never across engines. A sum of nothing is null."""
    from plumbline.operators.rates import is_placeholder

    a = answers.where(~is_placeholder()).select("answer_id", "engine", "cost_estimate_usd").dropDuplicates(["answer_id"])
    return a.groupBy("engine").agg(F.round(F.sum("cost_estimate_usd"), 4).alias("usd"), F.count("cost_estimate_usd").alias("answers_priced"), (F.count("*") - F.count("cost_estimate_usd")).alias("answers_unpriced"))


def observability(answers: DataFrame) -> DataFrame:
    """By engine: answers whose citations could not be seen, whose channel for them was empty, that come with all that was retrieved, that ran no search, or come from another model than asked; and the spans that were dropped."""
    from plumbline.operators.rates import is_placeholder

    some = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    a = answers.where(~is_placeholder()).select("answer_id", "engine", "cited_sources_available", "retrieved_set_available", "spans_dropped", "model", "model_requested", "params.search_ran", "params.empty_citation_channel").dropDuplicates(["answer_id"])
    return a.groupBy("engine").agg(
        F.count("*").alias("answers"), F.count_if(~F.coalesce("cited_sources_available", F.lit(False))).alias("without_citations"), some(F.col("empty_citation_channel")).alias("empty_channel"), some(F.col("retrieved_set_available")).alias("with_retrieved_set"),
        F.coalesce(F.sum("spans_dropped"), F.lit(0)).cast("long").alias("spans_dropped"), F.count_if(~F.coalesce("search_ran", F.lit(True))).alias("not_searched"), some(F.col("model") != F.col("model_requested")).alias("other_model"),
    )


def completeness(settled: DataFrame) -> DataFrame:
    """By run: engines that were planned, those of them with every planned answer, and whether all are. ``settled``: see ``on_disk``."""
    full = F.col("done") == F.col("planned")
    return settled.where("planned > 0").groupBy("run_id").agg(F.count("*").alias("engines"), F.count_if(full).alias("engines_whole"), F.sum("planned").alias("planned"), F.sum("done").alias("done"), F.bool_and(full).alias("whole"))


def asked_engines(manifests: DataFrame) -> DataFrame:
    """run_id, engine, ask_status, planned, done, failed as the manifests note them, a row for each engine of a run."""
    m = manifests.dropDuplicates(["run_id"]).where("engines is not null")
    return m.select("run_id", F.explode("engines").alias("engine", "e")).select("run_id", "engine", "e.ask_status", "e.planned", "e.done", "e.failed")


def notices(manifests: DataFrame) -> DataFrame:
    """By run: how many calls are planned and done, and which engines were not asked, as noted."""
    skipped = F.coalesce(F.col("ask_status").startswith("skipped"), F.lit(False))
    return asked_engines(manifests).groupBy("run_id").agg(F.sum("planned").alias("planned"), F.sum("done").alias("done"), F.array_join(F.array_sort(F.collect_set(F.when(skipped, F.col("engine")))), ",").alias("not_asked"))


def with_metrics(manifests: DataFrame, counted: DataFrame) -> DataFrame:
    """Every engine of every run with its counts (run_id, engine, ...): one that gave no answer has null and not 0."""
    return asked_engines(manifests).select("run_id", "engine").join(counted, ["run_id", "engine"], "left")


def changed_prompts(manifests: DataFrame, same: Iterable[str] = ("brand", "v")) -> DataFrame:
    """run_id, n_earlier, earlier: live runs whose prompt set has the version (v) of earlier live runs of the brand, but another hash than theirs; how many, and the first.

    By running counts instead of a join of runs with runs: those before it, less those before it that have its hash.
    """
    m = manifests.where("run_mode = 'live'").select("run_id", "brand", "started_at", F.col("prompt_set.set_version").alias("v"), F.col("prompt_set.set_hash").alias("h")).dropDuplicates(["run_id"])
    m = m.where(F.expr(" and ".join(f"{c} is not null" for c in (*same, "started_at", "h"))))
    at = F.unix_micros("started_at")
    group = Window.partitionBy(*same)
    before, alike = (w.orderBy(at).rangeBetween(Window.unboundedPreceding, -1) for w in (group, Window.partitionBy(*same, "h")))
    m = m.withColumn("n_earlier", F.count("*").over(before) - F.count("*").over(alike))
    order = F.struct("started_at", "run_id")
    m = m.withColumn("_first", F.min_by("h", order).over(group))
    m = m.withColumn("earlier", F.when(F.col("h") == F.col("_first"), F.min_by(F.when(F.col("h") != F.col("_first"), F.col("run_id")), F.when(F.col("h") != F.col("_first"), order)).over(group)).otherwise(F.min_by("run_id", order).over(group)))
    return m.where("n_earlier > 0").select("run_id", "n_earlier", "earlier")
