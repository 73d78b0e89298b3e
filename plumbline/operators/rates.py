"""Visibility rates of each engine: how often named, how often cited. Engines are never pooled.

One aggregation by engine over one row for each answer; partial counts are combined before the shuffle, so the number
of engines doesn't matter and a hot engine is no hot task. Only counts, no rate, are summed across engines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hosts, stats
from plumbline.functions.folding import folded
from plumbline.operators.mentions import Entity


def latest(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Re-deliveries keep id and content: one row for each key."""
    return df.dropDuplicates(list(key))


def latest_of(df: DataFrame, key: Iterable[str], *columns: Column | str) -> DataFrame:
    """One row for each key, of the key and what is asked for, which is computed before rows are shuffled."""
    key = list(key)
    return df.select(*key, *columns).dropDuplicates(key)


def latest_by(df: DataFrame, key: Iterable[str], time: str, tie: str) -> DataFrame:
    """The last version of each key, by an aggregation instead of a window, so that it combines before the shuffle."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_r")).select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def is_placeholder(params: str = "params") -> Column:
    return F.coalesce(F.col(f"{params}.no_fixture"), F.lit(False))


def names(text: Column, entity: Entity) -> Column:
    """Whether folded text names the entity."""
    out = F.lit(False)
    for n in entity.needles():
        out = out | F.contains(text, F.lit(n))
    return out


def cited_by_answer(citations: DataFrame, owned: Iterable[str]) -> DataFrame:
    """answer_id, n_cited, n_owned_cited: retrieved-only sources never count."""
    own = hosts.is_owned(F.col("domain"), owned)
    return latest(citations, ["citation_id"]).groupBy("answer_id").agg(F.count_if(F.coalesce("is_cited", F.lit(False))).alias("n_cited"), F.count_if(F.coalesce("is_cited", F.lit(False)) & own).alias("n_owned_cited"))


def analysed(answers: DataFrame, entities: list[Entity], recommendation: Iterable[str], citations: DataFrame | None = None, owned: Iterable[str] = ()) -> DataFrame:
    """One row for each answer that is no placeholder. Three-valued: what doesn't apply or can't be seen is null."""
    owned = list(owned)
    text = folded(F.col("answer_text"))
    brand = next(e for e in entities if e.role == "brand")
    rivals = [e for e in entities if e.role == "competitor"]
    # flags first: what is shuffled to find re-deliveries is narrow, whatever the length of the texts
    rows = answers.where(~is_placeholder()).withColumn("_text", text)
    observable = F.coalesce("cited_sources_available", F.lit(False))
    rows = rows.withColumn("mentioned", F.coalesce(names(F.col("_text"), brand), F.lit(False))).withColumn("competitors_named", F.filter(F.array(*[F.when(names(F.col("_text"), e), e.name) for e in rivals]).cast("array<string>"), lambda c: c.isNotNull()))
    rows = rows.select("answer_id", "run_id", "engine", "query_index", "repeat_no", "intent", "mentioned", "competitors_named", observable.alias("observable"), F.when(F.col("intent").isin(list(recommendation)), F.col("mentioned")).alias("named_in_rec"))
    rows = latest(rows, ["answer_id"])
    if citations is None:
        return rows.withColumn("owned_cited", F.lit(None).cast("boolean"))
    seen = rows.join(cited_by_answer(citations, owned), "answer_id", "left")
    return seen.withColumn("owned_cited", F.when(F.col("observable") & F.lit(bool(owned)), F.coalesce("n_owned_cited", F.lit(0)) > 0)).drop("n_cited", "n_owned_cited")


def engine_metrics(rows: DataFrame, by: Iterable[str] = ("engine",), recommendation: bool = True, owned: bool = True) -> DataFrame:
    by = list(by)
    counts = rows.groupBy(*by).agg(*[f(c).alias(f"{p}_{c}") for c in ("mentioned", "named_in_rec", "owned_cited") for p, f in (("c", F.count_if), ("n", F.count))])
    m = stats.metric("mention", F.col("c_mentioned"), F.col("n_mentioned"))
    r = stats.metric("named_in_rec", F.col("c_named_in_rec"), F.col("n_named_in_rec"), "no_data" if recommendation else "not_measured")
    o = stats.metric("owned_cited", F.col("c_owned_cited"), F.col("n_owned_cited"), "not_observable" if owned else "not_measured")
    return counts.select(*by, *m, *r, *o)


def competitor_metrics(rows: DataFrame, rivals: list[Entity]) -> DataFrame:
    """engine, competitor and its rate over all answers of the engine."""
    counts = rows.groupBy("engine").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("competitors_named", e.name)).alias(f"c{i}") for i, e in enumerate(rivals)])
    long = counts.select("engine", "n", F.explode(F.array(*[F.struct(F.lit(e.name).alias("competitor"), F.col(f"c{i}").alias("c")) for i, e in enumerate(rivals)])).alias("x"))
    return long.select("engine", "x.competitor", *stats.metric("mention", F.col("x.c"), F.col("n")))


def across(per_engine: DataFrame, prefix: str) -> DataFrame:
    """Counts over all engines, with the list of those that have any; no rate."""
    return per_engine.agg(F.coalesce(F.sum(f"{prefix}_count"), F.lit(0)).alias("count"), F.coalesce(F.sum(f"{prefix}_n"), F.lit(0)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col(f"{prefix}_n") > 0, F.col("engine")))), ",").alias("engines"))
