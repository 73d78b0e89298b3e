"""Combine records of several sources so that each has its target share of the total size.

Method: systematic sampling. A source's documents all have the same expected number of copies, its target size over
its size, at most its capped repeats; they are put in order of size, their expected copies are summed up, one random
offset is added, and a document is emitted once for each integer that the sum crosses at it. In order of size the
copies are spread evenly over short and long documents, so the drawn size stays within about one document of the target.

The total is a parameter: by default the size of all documents that have a target, so that the whole corpus is used
and scarce sources fall short where their cap binds, which ``shares`` reports; ``EXACT`` takes the largest total for
which no cap binds, so that every source has its share of what is drawn; a number is taken as it is. Target shares are
taken over the sources that are there; an absent one is reported with nothing. Defined results: sources without a
target are left out; documents of no size or a null source are never drawn; targets of 0 draw nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.ranking import rank_within
from plumbline.operators.lineage import collect_bounded


EXACT = "exact"
MOST_TARGETS = 100_000


def budget(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | str | None = None) -> dict[str, tuple[float, float]]:
    """(expected copies of each document, size wanted), by source. sizes: tokens of a source; targets: (share, most repeats)."""
    there = {s: (share, cap) for s, (share, cap) in targets.items() if sizes.get(s) and share and share > 0 and cap and cap > 0}
    weight = sum(share for share, _ in there.values())
    if not weight:
        return {}
    if total is None:
        total = sum(sizes[s] for s in there)
    elif total == EXACT:
        total = min(sizes[s] * cap / (share / weight) for s, (share, cap) in there.items())
    wanted = {s: total * (share / weight) for s, (share, _) in there.items()}
    return {s: (min(float(cap), wanted[s] / sizes[s]), wanted[s]) for s, (_, cap) in there.items()}


def planned(docs: DataFrame, source: str, size: str, targets: DataFrame, total: float | str | None = None) -> dict[str, tuple[float, float]]:
    """The budget of these documents: one row for each target is all that the driver sees."""
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in collect_bounded(targets, MOST_TARGETS, "targets")}
    sizes = docs.where(F.col(size) > 0).join(targets.select(F.col("source").alias(source)).distinct(), source, "left_semi").groupBy(source).agg(F.sum(size))
    return budget({r[0]: r[1] for r in collect_bounded(sizes, MOST_TARGETS, "targets")}, goal, total)


def mix(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: float | str | None = None, seed: int = 17) -> DataFrame:
    """key, source, n_tokens, copies: the chosen documents. ``targets``: source, target_share, max_repeats, a row for each source."""
    copies = planned(docs, source, size, targets, total)
    rate = docs.sparkSession.createDataFrame([(s, float(c)) for s, (c, _) in copies.items()], f"`{source}` string, _rate double")
    ranked = rank_within(docs.where(F.col(size) > 0).join(rate, source), [source], key, order=F.col(size).cast("long"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col(source)), F.lit(1_000_000)) / 1_000_000
    e = F.col("_rate")
    tiny = 1e-9  # so that whole numbers of copies stay whole
    emitted = F.floor((F.col("rank") + 1) * e + offset + tiny) - F.floor(F.col("rank") * e + offset + tiny)
    return ranked.withColumn("copies", emitted).where("copies > 0").select(key, source, F.col(size).alias("n_tokens"), "copies")


def shares(mixed: DataFrame, targets: DataFrame, plan: dict[str, tuple[float, float]], source: str = "source") -> DataFrame:
    """source, target_share, max_repeats, documents, tokens, wanted_tokens, shortfall (what the cap on repeats left open), actual_share (of all that is drawn), most_copies, for every target."""
    got = mixed.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    wanted = mixed.sparkSession.createDataFrame([(s, round(w)) for s, (_, w) in plan.items()], "source string, wanted_tokens long")
    everything = Window.partitionBy(F.lit(0))  # a row for each target
    zero = F.lit(0).cast("long")
    out = targets.join(got, "source", "left").join(wanted, "source", "left").withColumn("_all", F.sum("tokens").over(everything))
    tokens, want = F.coalesce("tokens", zero), F.coalesce("wanted_tokens", zero)
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), tokens.alias("tokens"), want.alias("wanted_tokens"), F.greatest(zero, want - tokens).alias("shortfall"),
        F.round(F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("most_copies", zero).alias("most_copies"),
    )
