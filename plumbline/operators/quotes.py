"""Is quoted text really on the cited page?

Quotes meet pages in an equi-join on the url; AQE chooses how. What can't be checked is told apart from what wasn't
found, by an ordered list of reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators.lineage import cut
from plumbline.operators.rates import latest

METHOD = "html-text-2+md-quote-2+gap-1"
# Outcomes of a fetch that another try won't change.
DEFINITIVE = ("ok", "gone", "auth_required", "paywalled", "robots_blocked", "blocked_unsafe", "invalid_url", "not_in_dry_run")


def page_for_url(pages: DataFrame, method: str | None = None, definitive_only: bool = False) -> DataFrame:
    """One page for each url: the last visit, an ok one before others. ``method``: text of that extraction only."""
    p = latest(pages, ["page_id"])
    if method is not None:
        p = p.where(F.col("text_method") == method)
    if definitive_only:
        p = p.where(F.col("fetch_status").isin(*DEFINITIVE))
    rank = F.struct(F.col("fetch_status") == "ok", F.col("fetched_at"), F.col("page_id"))
    return p.groupBy("url").agg(F.max_by(F.struct("page_id", "fetch_status", "http_status", "fetched_at", "text_method", "text"), rank).alias("p")).select("url", "p.*")


def to_fetch(citations: DataFrame, cache: DataFrame, method: str) -> DataFrame:
    """Urls with a quote that is cited and no valid cached page: an anti-join on distinct urls."""
    wanted = citations.where("is_cited and cited_text is not null and cited_text <> ''").select("url").distinct()
    return wanted.join(page_for_url(cache, method, definitive_only=True).select("url"), "url", "left_anti")


def reason(quote: Column, has_page: Column, status: Column, page: Column) -> Column:
    none = lambda c: c.isNull() | (c == "")
    return F.when(none(quote), "no_cited_text").when(~has_page, "not_fetched").when(status != "ok", F.concat(F.lit("fetch_"), status)).when(none(page), "no_page_text")


def quoted() -> Column:
    return F.col("cited_text").isNotNull() & (F.col("cited_text") != "")


def checked(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each cited citation: reason or match, and the verdict. The quote is compared without its Markdown.

    Each page is put in its comparable form once, before the join. A url that a large part of all citations has is
    split by AQE on the citations' side, each part meeting the url's one page.
    """
    cited = latest(citations.where("is_cited").select("citation_id", "answer_id", "engine", "url", "domain", "cited_text"), ["citation_id"])
    got = page_for_url(pages).select("url", "fetch_status", F.col("text").alias("page"), F.when(F.col("fetch_status") == "ok", tx.comparable(F.col("text"))).alias("_page"), F.lit(True).alias("has_page"))
    # urls of rows without a quote would only carry pages through the shuffle
    rows = cited.where(quoted()).join(got, "url", "left").unionByName(cited.where(~F.coalesce(quoted(), F.lit(False))), allowMissingColumns=True)
    why = reason(F.col("cited_text"), F.coalesce("has_page", F.lit(False)), F.col("fetch_status"), F.col("page"))
    rows = rows.withColumn("not_comparable_reason", why)
    can = F.col("not_comparable_reason").isNull()
    rows = rows.withColumn("_q", F.when(can, tx.normal_quote(F.col("cited_text"))))
    rows = rows.withColumn("exact_match", F.when(can, F.contains("page", "_q"))).withColumn("_whole", F.when(can, F.contains(F.col("_page"), tx.comparable(F.col("_q")))))
    rows = rows.withColumn("_pieces", F.when(can & ~F.col("_whole"), tx.quote_pieces(F.col("cited_text"))))
    rows = rows.withColumn("_hits", F.size(F.filter("_pieces", lambda p: F.contains(F.col("_page"), tx.comparable(p))))).drop("page", "_page")
    n = F.size("_pieces")
    by_pieces = F.coalesce((n > 1) & (F.col("_hits") == n), F.lit(False))
    rows = rows.withColumn("normalized_match", F.when(can, F.col("_whole") | by_pieces)).withColumn("pieces", F.when(F.col("_whole"), 1).when(can, n)).withColumn("pieces_found", F.when(F.col("_whole"), 1).when(can, F.col("_hits")))
    rows = rows.withColumn("matched_by", F.when(F.col("_whole"), "whole").when(can & by_pieces, "pieces"))
    verdict = F.when(~can, "not_checkable").when(F.col("normalized_match"), "found").otherwise("not_found")
    return rows.withColumn("result", verdict).select("citation_id", "answer_id", "engine", "url", "domain", "cited_text", "fetch_status", "not_comparable_reason", "exact_match", "normalized_match", "pieces", "pieces_found", "matched_by", "result")


def instrument(rows: DataFrame, run_mode: str = "run_mode") -> DataFrame:
    """By run_mode: cited citations with a quote, those that could be checked, and whether the check is at work: 'not_checked' where no quote was ever looked up, 'not_checkable' where none of those looked up could be compared."""
    looked = quoted() & (F.col("not_comparable_reason").isNull() | (F.col("not_comparable_reason") != "not_fetched"))
    s = rows.groupBy(run_mode).agg(F.count_if(quoted()).alias("with_quote"), F.count_if(looked).alias("looked_up"), F.count_if(F.col("result") != "not_checkable").alias("checked"))
    return s.withColumn("status", F.when(F.col("with_quote") == 0, "not_observable").when(F.col("looked_up") == 0, "not_checked").when(F.col("checked") == 0, "not_checkable").otherwise("ok"))


def summary(rows: DataFrame) -> DataFrame:
    """By engine: cited, with_quote, checked, found, not_found, not_checkable (of those with a quote) and a status."""
    s = rows.groupBy("engine").agg(F.count("*").alias("cited"), F.count_if(quoted()).alias("with_quote"), F.count_if(F.col("result") == "found").alias("found"), F.count_if(F.col("result") == "not_found").alias("not_found"), F.count_if(quoted() & (F.col("result") == "not_checkable")).alias("not_checkable"))
    s = s.withColumn("checked", F.col("found") + F.col("not_found"))
    return s.withColumn("status", F.when(F.col("cited") == 0, "no_citations").when(F.col("with_quote") == 0, "not_observable").when(F.col("checked") > 0, "ok").otherwise("not_checkable"))


def gap_rows(answers: DataFrame, citations: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each cited citation of an answer: comparability, lengths and how long after the answer the page was read."""
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    a = latest(answers.select("answer_id", F.col("engine").alias("platform"), "observed_at"), ["answer_id"])
    # lengths instead of texts go through the joins
    c = latest(citations.where("is_cited").select("citation_id", "answer_id", "url", "domain", "corpus", length("cited_text").alias("cited_text_len")), ["citation_id"])
    p = page_for_url(pages.withColumn("text", length("text"))).select("url", "fetch_status", "fetched_at", F.col("text").alias("page_len"))
    rows = c.join(a, "answer_id").join(p, "url", "left").withColumn("fetched_text_len", F.coalesce("page_len", F.lit(0)))
    why = F.when(F.col("cited_text_len") == 0, "no_cited_text").when(F.coalesce("fetch_status", F.lit("")) != "ok", F.concat(F.lit("fetch_"), F.coalesce("fetch_status", F.lit("none")))).when(F.col("fetched_text_len") == 0, "no_fetched_text")
    delay = (F.unix_micros("fetched_at") - F.unix_micros("observed_at")) / 1e6
    return rows.select("citation_id", "answer_id", "platform", "domain", "corpus", "fetch_status", why.isNull().alias("comparable"), why.alias("not_comparable_reason"), "cited_text_len", "fetched_text_len", F.round(delay, 3).alias("fetch_delay_seconds"))


#: quotes that stand on their pages: if these don't match, no 'not found' can be believed
CONTROLS = (("zh", "水壶非常耐用", "测评：这款水壶非常耐用，值得推荐。"), ("en", "a three year warranty", "Every kettle comes with a three year warranty."))


def controls(spark: SparkSession) -> DataFrame:
    """label, exact_match, score of the known good pairs."""
    rows = spark.createDataFrame(CONTROLS, "label string, quote string, page string")
    scores = window_scores(rows.select("label", "quote", F.col("label").alias("at")), rows.select(F.col("label").alias("at"), "page"), "label", "quote", "at", "page")
    return rows.select("label", F.contains("page", "quote").alias("exact_match")).join(scores, "label")


def window_scores(quotes: DataFrame, pages: DataFrame, key: str, quote: str, at: str, page: str) -> DataFrame:
    """key, score: the largest share of a quote's words found, as a multiset, in any window of its page (the one with the same ``at``) as long as the quote.

    As relational algebra, without a loop over windows: the p-th word t of a page counts in the windows that end at e
    as long as p <= e < p + w and fewer than k_t later ones of its kind have come, k_t being how often the quote has t.
    Each useful word thus adds one at p and takes it away at least(p + w, position of the k_t-th next t, page's end);
    the overlap at e is the running sum, and the score is its maximum over the quote's length. Only words that the
    quote has are exploded, so a page costs as much as it shares. A page is cut into words once, or once more letter
    by letter where a quote in a spaceless script asks for that. Quotes without a page score nothing and are left out.
    """
    q = quotes.select(key, at, F.col(quote).alias("_quote"), tx.spaceless(F.col(quote)).alias("_by_char"))
    p = pages.select(at, F.col(page).alias("_page"), tx.spaceless(F.col(page)).alias("_spaceless"))
    # how each page is asked for: its own way, and letter by letter for quotes that need it
    asked = q.where("_by_char").select(at, F.lit(True).alias("_by_char")).distinct()
    ways = p.withColumn("_by_char", F.col("_spaceless")).unionByName(p.where("not _spaceless").join(asked, at))
    words = ways.select(at, "_by_char", "_spaceless", tx.tokens(F.col("_page"), F.col("_by_char")).alias("p"))
    own = p.select(at, "_spaceless")
    q = q.join(own, at).withColumn("_by_char", F.col("_by_char") | F.col("_spaceless")).drop("_spaceless")
    t = q.join(words.drop("_spaceless"), [at, "_by_char"]).select(key, tx.tokens(F.col("_quote"), F.col("_by_char")).alias("q"), "p")
    t = t.withColumn("n", F.size("q")).withColumn("m", F.size("p"))
    # a quote that stands on the page word for word fills its window; only the others are exploded
    mark = F.lit("\x1f")
    around = lambda c: F.concat(mark, F.array_join(c, "\x1f"), mark)
    t = t.withColumn("whole", (F.col("n") > 0) & F.contains(around("p"), around("q"))).withColumn("need", F.array_distinct("q"))
    wanted = F.when(~F.col("whole"), F.filter(F.transform("p", lambda x, i: F.struct(i.alias("pos"), x.alias("t"))), lambda s: F.array_contains("need", s["t"])))
    kept = cut(t.select(key, "whole", "n", "m", "q", wanted.alias("wanted")))  # read twice below: the words of pages go no further
    useful = kept.where("n > 0 and m > 0 and not whole").select(key, "n", "m", "q", F.explode("wanted").alias("s")).select(key, "n", "m", F.col("s.pos").alias("pos"), F.col("s.t").alias("t"), F.size(F.filter("q", lambda x: x == F.col("s.t"))).alias("k"))
    # where each word of a page stands, in order; the k-th next is k places on
    lists = useful.groupBy(key, "t").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("k").alias("k"), F.array_sort(F.collect_list("pos")).alias("at"))
    until = F.transform("at", lambda p, i: F.struct(p.alias("pos"), F.least(p + F.least("n", "m"), F.get("at", i + F.col("k")), F.col("m")).alias("until")))
    useful = lists.select(key, "n", F.explode(until).alias("o")).select(key, "n", "o.pos", "o.until")
    events = useful.select(key, "n", F.explode(F.array(F.struct(F.col("pos").alias("e"), F.lit(1).alias("d")), F.struct(F.col("until").alias("e"), F.lit(-1).alias("d")))).alias("x"))
    steps = events.groupBy(key, "n", F.col("x.e").alias("e")).agg(F.sum("x.d").alias("d"))
    running = steps.withColumn("on", F.sum("d").over(Window.partitionBy(key).orderBy("e").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = running.groupBy(key).agg((F.max("on") / F.max("n")).alias("score"))
    return kept.select(key, "whole").join(best, key, "left").select(key, F.when(F.col("whole"), 1.0).otherwise(F.round(F.coalesce("score", F.lit(0.0)), 4)).alias("score"))
