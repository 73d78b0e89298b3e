"""Answer payloads of several platforms to one model of answers, citations, spans and searches.

A payload is read once into path-value-ordinal triples (see ``nested``); each platform's parser is one aggregation over
them for what a payload has once, and a few joins of the tables of its repeated ancestors. All joins are on the
payload's id, so one partitioning serves them all, and every window or list is within one payload.

A parser gives four tables by name:
answers (payload_id, answer_text, and ``FACTS``), citations (payload_id, citation_index, url, title, cited_text,
is_cited, cite_position, domain), spans (payload_id, span_start, span_end, citation_indexes; code points), searches
(payload_id, search_no, search_query, results_count).

Spans that can't be placed are left out and counted: a range outside the answer's text, a source without a url or that
wasn't cited, an offset inside a character, a segment that doesn't give back the words that came with it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import hosts
from plumbline.functions import text as tx
from plumbline.operators import nested
from plumbline.operators.lineage import stored

ID = "payload_id"
Tables = dict[str, DataFrame]
PARSERS: dict[str, Callable[[DataFrame], Tables]] = {}
#: arrays of the platforms, and keys by which a payload is known inside its envelopes
REPEATED = nested.REPEATED | {"choices", "citations", "search_results"}
ANCHORS = (*nested.ITEMS.values(), "choices")
TOKENS = ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")
#: what an answer says of itself; null where the platform doesn't tell
FACTS = (
    "model", "stop_reason", "search_ran", "cited_sources_available", "retrieved_set_available", "empty_citation_channel",
    *TOKENS, "output_includes_reasoning", "search_count", "callers", "spans_recorded", "spans_dropped",
)


def parser(platform: str):
    """Registers a parser for a platform's triples."""

    def register(f: Callable[[DataFrame], Tables]) -> Callable[[DataFrame], Tables]:
        PARSERS[platform] = f
        return f

    return register


def triples(payloads: DataFrame) -> DataFrame:
    """Triples of one row for each payload; re-deliveries keep id and content."""
    return nested.explode_triples(payloads.dropDuplicates([ID]), ID, "payload", REPEATED, ANCHORS, "platform", empties=True)


def _group(t: DataFrame, group: str, **fields: str) -> DataFrame:
    return nested.group_table(t.where("kind not in ('array', 'object')"), ID, group, fields)


def _nth(i: int) -> Column:
    return F.get("ordinals", F.lit(i))


# --- what a payload has once: aggregates over its triples ---


def _is(path: str) -> Column:
    return F.col("path") == path


def _said(path: str, where: Column | None = None) -> Column:
    """A string."""
    c = _is(path) & (F.col("kind") == "string")
    return F.max(F.when(c if where is None else c & where, F.col("value")))


def _whole(path: str) -> Column:
    """A number that counts something: whole and not negative; null for anything else."""
    return F.max(F.when(_is(path) & (F.col("kind") == "number") & F.col("value").rlike(r"^\d{1,18}$"), F.col("value").cast("long")))


def _some(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def _has(path: str) -> Column:
    """The key is there, whatever it holds."""
    return _is(path) | F.col("path").startswith(path + "[]") | F.col("path").startswith(path + ".")


def _list(path: str) -> Column:
    """An array is there, if only an empty one."""
    return F.col("path").startswith(path + "[]") | _is(path) & (F.col("kind") == "array")


def _at(c: Column) -> Column:
    """The first ordinals of what a condition holds for."""
    return F.collect_set(F.when(c, _nth(0)))


def _facts(t: DataFrame, includes_reasoning: bool, tokens: dict[str, str], **facts: Column) -> DataFrame:
    """One row for each payload. Two steps: ``facts`` that begin with _ are there for those that follow."""
    first = {n: c for n, c in facts.items() if n.startswith("_") or n in ("model", "stop_reason", "search_count")}
    rows = t.groupBy(ID).agg(*[c.alias(n) for n, c in first.items()], *[_whole(tokens[n]).alias(n) if n in tokens else F.lit(None).cast("long").alias(n) for n in TOKENS])
    rows = rows.withColumn("output_includes_reasoning", F.when(F.coalesce(*TOKENS).isNotNull(), F.lit(includes_reasoning)))
    for n, c in facts.items():
        if n not in first:
            rows = rows.withColumn(n, c)
    kinds = {"search_count": "long", "callers": "string", "model": "string", "stop_reason": "string"}
    for n in FACTS[:-2]:
        if n not in rows.columns:
            rows = rows.withColumn(n, F.lit(None).cast(kinds.get(n, "boolean")))
    return rows


def _answers(facts: DataFrame, texts: DataFrame, dropped: DataFrame | None, recorded: Column) -> DataFrame:
    """facts with the text and the number of dropped spans, where the platform could have given any."""
    rows = facts.join(texts, ID, "left")
    rows = rows.withColumn("spans_dropped", F.lit(0).cast("long")) if dropped is None else rows.join(dropped, ID, "left").withColumn("spans_dropped", F.when(recorded, F.coalesce("spans_dropped", F.lit(0))).otherwise(0).cast("long"))
    return rows.withColumn("spans_recorded", recorded).select(ID, F.coalesce("answer_text", F.lit("")).alias("answer_text"), *FACTS)


# --- texts, sources, spans ---


def _with_base(chunks: DataFrame, order: str) -> DataFrame:
    """Adds the code points of all chunks before one."""
    w = Window.partitionBy(ID).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("base", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("int"))


def _joined(chunks: DataFrame, order: str) -> DataFrame:
    return chunks.groupBy(ID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "").alias("answer_text"))


def numbered_sources(sources: DataFrame) -> DataFrame:
    """sources: payload_id, is_cited, place (sorts), url, title, cited_text. One row for each url, the first one's; cited ones come first. Adds citation_index, the ordinal among cited ones, and the site that a url leads to."""
    later = (~F.col("is_cited")).alias("later")
    first = sources.where("url is not null and url <> ''").groupBy(ID, "url").agg(F.max("is_cited").alias("is_cited"), F.min(F.struct(later, "place")).alias("at"), F.min_by(F.struct("title", "cited_text"), F.struct(later, "place")).alias("x"))
    per = first.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("at", "url", "is_cited", "x"))).alias("all"))
    # cited ones sort first, so a cited one's index is its ordinal among them
    rows = per.select(ID, F.posexplode("all").alias("citation_index", "c"))
    rows = rows.select(ID, "citation_index", "c.url", "c.x.title", "c.x.cited_text", "c.is_cited", F.when(F.col("c.is_cited"), F.col("citation_index")).alias("cite_position"))
    return rows.withColumn("domain", hosts.resolve_domain(F.col("url"), F.col("title")))


def _cite(rows: DataFrame, is_cited: bool, *place: Column) -> DataFrame:
    text = F.col("cited_text") if "cited_text" in rows.columns else F.lit(None).cast("string")
    return rows.select(ID, F.lit(is_cited).alias("is_cited"), F.array(*place).alias("place"), "url", "title", text.alias("cited_text"))


def _placed(ranges: DataFrame, texts: DataFrame, unplaced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """ranges: payload_id, a, b, ix (indexes of cited sources; null ones for others). (spans that land in the text, payload_id and spans_dropped of those that don't)"""
    rows = ranges.join(texts.select(ID, F.length("answer_text").alias("_n")), ID, "left")
    fits = F.coalesce((F.col("a") >= 0) & (F.col("a") < F.col("b")) & (F.col("b") <= F.col("_n")) & (F.size("ix") > 0) & ~F.exists("ix", lambda i: i.isNull()), F.lit(False))
    rows = rows.withColumn("_fits", fits)
    spans = rows.where("_fits").select(ID, F.col("a").alias("span_start"), F.col("b").alias("span_end"), F.array_sort(F.array_distinct("ix")).alias("citation_indexes"))
    lost = rows.where("not _fits").select(ID)
    if unplaced is not None:
        lost = lost.union(unplaced.select(ID))
    return spans, lost.groupBy(ID).agg(F.count("*").alias("spans_dropped"))


def _numbered(searches: DataFrame, *order: str) -> DataFrame:
    """payload_id, search_no (from 0), search_query, results_count"""
    w = Window.partitionBy(ID).orderBy(*order)
    return searches.select(ID, (F.row_number().over(w) - 1).alias("search_no"), "search_query", F.col("results_count").cast("long").alias("results_count"))


_none = lambda: F.lit(None).cast("long")


@parser("anthropic")
def anthropic(t: DataFrame) -> Tables:
    kind = lambda v: _is("content[].type") & (F.col("value") == v)
    result, caller = kind("web_search_tool_result"), F.struct(_nth(0).alias("i"), F.col("value").alias("v"))
    named = lambda i: F.coalesce(F.get(F.filter("_callers", lambda c: c["i"] == i), 0)["v"], F.lit("unknown"))
    ran = F.size("_results") > 0
    facts = _facts(
        t, True, {"input_tokens": "usage.input_tokens", "output_tokens": "usage.output_tokens", "reasoning_tokens": "usage.output_tokens_details.thinking_tokens"},
        model=_said("model"), stop_reason=_said("stop_reason"), search_count=_whole("usage.server_tool_use.web_search_requests"), _results=_at(result), _texts=_at(kind("text")), _channel=_at(_list("content[].citations")),
        _callers=F.collect_set(F.when(_is("content[].caller.type") & (F.col("kind") == "string"), caller)), search_ran=ran, retrieved_set_available=ran,
        spans_possible=F.arrays_overlap("_texts", "_channel"), cited_sources_available=ran & F.arrays_overlap("_texts", "_channel"), callers=F.array_join(F.array_sort(F.array_distinct(F.transform("_results", named))), ","),
    )
    blocks = _group(t, "content[]", type="type", text="text", tool="id", name="name", query="input.query", answers="tool_use_id").withColumn("i", _nth(0))
    texts = _with_base(blocks.where("type = 'text'").select(ID, "i", F.coalesce("text", F.lit("")).alias("text")), "i")
    quotes = _group(t, "content[].citations[]", url="url", title="title", cited_text="cited_text", plain="").where("plain is null").withColumn("i", _nth(0)).join(texts.select(ID, "i"), [ID, "i"], "left_semi")
    results = _group(t, "content[].content[]", url="url", title="title").withColumn("i", _nth(0)).join(blocks.where("type = 'web_search_tool_result'").select(ID, "i"), [ID, "i"], "left_semi")
    sources = numbered_sources(_cite(quotes, True, F.col("i"), _nth(1)).unionByName(_cite(results, False, F.col("i"), _nth(1))))
    behind = quotes.join(sources.select(ID, "url", "citation_index"), [ID, "url"], "left").groupBy(ID, "i").agg(F.collect_set("citation_index").alias("ix"), F.count_if(F.col("citation_index").isNull()).alias("lost"))
    ranges = texts.join(behind, [ID, "i"]).select(ID, F.col("base").alias("a"), (F.col("base") + F.length("text")).alias("b"), F.when(F.col("lost") == 0, F.col("ix")).alias("ix"))
    joined = _joined(texts, "i")
    spans, dropped = _placed(ranges, joined)
    counts = t.where(_list("content[].content")).groupBy(ID, _nth(0).alias("i")).agg(F.count_if(F.col("kind") == "element").alias("results_count"))
    counted = blocks.where("type = 'web_search_tool_result' and answers is not null").select(ID, F.col("answers").alias("tool"), "i").join(counts, [ID, "i"], "left").groupBy(ID, "tool").agg(F.max_by("results_count", "i").alias("results_count"))
    asked = blocks.where("type = 'server_tool_use' and name = 'web_search' and query is not null").select(ID, "i", F.col("query").alias("search_query"), "tool").join(counted, [ID, "tool"], "left")
    return {"answers": _answers(facts, joined, dropped, F.col("spans_possible")), "citations": sources, "spans": spans, "searches": _numbered(asked, "i")}


@parser("openai")
def openai(t: DataFrame) -> Tables:
    kind = lambda v: _is("output[].type") & (F.col("value") == v)
    channel = F.arrays_overlap("_messages", "_channel")
    facts = _facts(
        t, True, {"input_tokens": "usage.input_tokens", "output_tokens": "usage.output_tokens", "reasoning_tokens": "usage.output_tokens_details.reasoning_tokens", "total_tokens": "usage.total_tokens"},
        model=_said("model"), stop_reason=F.coalesce(_said("incomplete_details.reason"), _said("status")), search_count=_whole("tool_usage.web_search.num_requests"), _messages=_at(kind("message")), _channel=_at(_has("output[].content[].annotations")),
        _ran=_some(kind("web_search_call")), search_ran=F.col("_ran"), spans_possible=channel, cited_sources_available=F.col("_ran") & channel, retrieved_set_available=F.lit(False),
    )
    items = _group(t, "output[]", type="type", action="action.type", query="action.query").withColumn("i", _nth(0))
    said = items.where("type = 'message'").select(ID, "i")
    chunks = _group(t, "output[].content[]", type="type", text="text").where("type = 'output_text'").select(ID, _nth(0).alias("i"), F.struct(_nth(0), _nth(1)).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = _with_base(chunks.join(said, [ID, "i"], "left_semi"), "at")
    # offsets are whole numbers; a number in a string is none
    numbers = t.where((F.col("kind") != "string") | ~F.col("path").isin("output[].content[].annotations[].start_index", "output[].content[].annotations[].end_index"))
    notes = _group(numbers, "output[].content[].annotations[]", type="type", url="url", title="title", a="start_index", b="end_index").where("type = 'url_citation' and url <> ''").withColumn("at", F.struct(_nth(0), _nth(1)))
    notes = notes.join(chunks, [ID, "at"])
    sources = numbered_sources(_cite(notes, True, _nth(0), _nth(1), _nth(2)))
    offset = lambda c: F.when(F.col(c).rlike(r"^-?\d{1,9}$"), F.col(c)).cast("int")
    notes = notes.join(sources.select(ID, "url", "citation_index"), [ID, "url"]).select(ID, (F.col("base") + offset("a")).alias("a"), (F.col("base") + offset("b")).alias("b"), "citation_index")
    ranges = notes.where("a is not null and b is not null").groupBy(ID, "a", "b").agg(F.collect_set("citation_index").alias("ix"))
    joined = _joined(chunks, "at")
    spans, dropped = _placed(ranges, joined, notes.where("a is null or b is null"))
    many = t.where(_list("output[].action.queries")).select(ID, _nth(0).alias("i"), _nth(1).alias("j"), F.when(F.col("kind") == "string", F.col("value")).alias("one"))
    calls = items.where("type = 'web_search_call' and coalesce(action, 'search') = 'search'").select(ID, "i", "query")
    asked = calls.join(many, [ID, "i"], "left").withColumn("many", F.count("j").over(Window.partitionBy(ID, "i")) > 0)
    asked = asked.select(ID, "i", F.coalesce("j", F.lit(0)).alias("j"), F.when(F.col("many"), F.col("one")).otherwise(F.col("query")).alias("search_query"), _none().alias("results_count")).where("search_query is not null")
    return {"answers": _answers(facts, joined, dropped, F.col("spans_possible")), "citations": sources, "spans": spans, "searches": _numbered(asked, "i", "j")}


@parser("google")
def google(t: DataFrame) -> Tables:
    g = "candidates[].groundingMetadata."
    t = t.where(~F.col("path").startswith("candidates[]") | (_nth(0) == 0))  # the first candidate is the answer
    ran = _some(_is(g + "groundingChunks[]"))
    facts = _facts(
        t, False, {"input_tokens": "usageMetadata.promptTokenCount", "output_tokens": "usageMetadata.candidatesTokenCount", "reasoning_tokens": "usageMetadata.thoughtsTokenCount", "total_tokens": "usageMetadata.totalTokenCount"},
        model=_said("modelVersion"), stop_reason=_said("candidates[].finishReason"), _ran=ran, _channel=_some(_has(g + "groundingSupports")), search_ran=F.col("_ran"), retrieved_set_available=F.col("_ran"), spans_possible=F.col("_channel"), cited_sources_available=F.col("_channel"),
    )
    parts = _group(t, "candidates[].content.parts[]", text="text").where("text is not null").select(ID, _nth(1).alias("i"), "text")
    answers = _joined(parts, "i")
    chunks = _group(t, g + "groundingChunks[]", uri="web.uri", title="web.title").select(ID, _nth(1).alias("chunk"), F.col("uri").alias("url"), "title")
    links = t.where((F.col("path") == g + "groundingSupports[].groundingChunkIndices[]") & (F.col("kind") != "element")).select(ID, _nth(1).alias("support"), F.when((F.col("kind") == "number") & F.col("value").rlike(r"^\d{1,9}$"), F.col("value")).cast("int").alias("chunk")).join(chunks.select(ID, "chunk", "url"), [ID, "chunk"], "left")
    behind = links.where("url is not null").select(ID, "url").distinct().withColumn("cited", F.lit(True))
    seen = chunks.join(behind, [ID, "url"], "left").withColumn("is_cited", F.coalesce("cited", F.lit(False)))
    sources = numbered_sources(_cite(seen.where("is_cited"), True, F.col("chunk")).unionByName(_cite(seen.where("not is_cited"), False, F.col("chunk"))))
    start = g + "groundingSupports[].segment.startIndex"
    starts = t.where(F.col("path") == start).select(ID, _nth(1).alias("support"), F.lit(True).alias("begins"))  # null isn't the start of the text, absent is
    supports = _group(t, g + "groundingSupports[]", a="segment.startIndex", b="segment.endIndex", said="segment.text").select(ID, _nth(1).alias("support"), "a", "b", "said").join(starts, [ID, "support"], "left")
    whole = lambda c: F.when(F.col(c).rlike(r"^\d{1,9}$"), F.col(c)).cast("int")
    text = F.coalesce("answer_text", F.lit(""))
    s = supports.join(answers, ID, "left").withColumn("x", tx.byte_to_code_point(text, F.when(F.col("begins"), whole("a")).otherwise(0))).withColumn("y", tx.byte_to_code_point(text, whole("b")))
    # a range is believed only if it gives back the words that came with it
    same = F.col("said").isNull() | (tx.strip_blanks(text.substr(F.col("x") + 1, F.col("y") - F.col("x"))) == tx.strip_blanks(F.col("said")))
    s = s.withColumn("ok", F.coalesce(F.col("x").isNotNull() & F.col("y").isNotNull() & same, F.lit(False)))
    ix = links.join(sources.select(ID, "url", "citation_index"), [ID, "url"], "left").groupBy(ID, "support").agg(F.collect_set("citation_index").alias("ix"), F.count_if(F.col("citation_index").isNull()).alias("lost"))
    ranges = s.where("ok").join(ix, [ID, "support"], "left").select(ID, F.col("x").alias("a"), F.col("y").alias("b"), F.when(F.col("lost") == 0, F.col("ix")).alias("ix"))
    spans, dropped = _placed(ranges, answers, s.where("not ok"))
    searches = t.where((F.col("path") == g + "webSearchQueries[]") & (F.col("kind") == "string")).select(ID, _nth(1).alias("i"), F.col("value").alias("search_query"), _none().alias("results_count"))
    return {"answers": _answers(facts, answers, dropped, F.col("spans_possible")), "citations": sources, "spans": spans, "searches": _numbered(searches, "i")}


def _choices(t: DataFrame) -> DataFrame:
    return _group(t, "choices[]", text="message.content").where((_nth(0) == 0) & F.col("text").isNotNull()).select(ID, F.col("text").alias("answer_text"))


def _neither(t: DataFrame) -> Tables:
    e = t.limit(0)
    i = F.lit(0)
    return {"spans": e.select(ID, i.alias("span_start"), i.alias("span_end"), F.array(i).alias("citation_indexes")), "searches": e.select(ID, i.alias("search_no"), F.lit("").alias("search_query"), _none().alias("results_count"))}


def _plain(t: DataFrame, group: str, rank: int, key: str = "url") -> DataFrame:
    """Sources that are strings or objects with a url."""
    objects = _group(t, group, url=key, title="title").where("url is not null").select(ID, _nth(0).alias("i"), "url", "title")
    strings = t.where((F.col("path") == group) & (F.col("kind") == "string")).select(ID, _nth(0).alias("i"), F.col("value").alias("url"), F.lit(None).cast("string").alias("title"))
    return _cite(objects.unionByName(strings), True, F.lit(rank), F.col("i"))


def _stopped() -> Column:
    return _said("choices[].finish_reason", _nth(0) == 0)


@parser("xai")
def xai(t: DataFrame) -> Tables:
    facts = _facts(t, True, {}, model=_said("model"), stop_reason=_stopped(), _channel=_some(_has("citations")), search_ran=F.col("_channel"), cited_sources_available=F.col("_channel"), retrieved_set_available=F.lit(False))
    return {"answers": _answers(facts, _choices(t), None, F.lit(False)), "citations": numbered_sources(_plain(t, "citations[]", 0)), **_neither(t)}


@parser("perplexity")
def perplexity(t: DataFrame) -> Tables:
    sources = numbered_sources(_plain(t, "search_results[]", 0).unionByName(_plain(t, "citations[]", 1)))
    facts = _facts(t, True, {}, model=_said("model"), stop_reason=_stopped(), _channel=_some(_has("citations") | _has("search_results")), cited_sources_available=F.col("_channel"), retrieved_set_available=F.lit(False))
    some = sources.select(ID).distinct().withColumn("_some", F.lit(True))
    facts = facts.join(some, ID, "left").withColumn("empty_citation_channel", F.col("_channel") & F.col("_some").isNull()).drop("_some")
    return {"answers": _answers(facts, _choices(t), None, F.lit(False)), "citations": sources, **_neither(t)}


TABLES = ("answers", "citations", "spans", "searches")


def parse(payloads: DataFrame) -> Tables:
    """All platforms' tables, each with its platform. Payloads are read once, whatever number of tables is asked for."""
    t = stored(triples(payloads))
    parsed = [(platform, f(t.where(F.col("platform") == platform))) for platform, f in PARSERS.items()]
    return {name: functools.reduce(DataFrame.unionByName, [tables[name].withColumn("platform", F.lit(platform)) for platform, tables in parsed]) for name in TABLES}


def verified(tables: Tables) -> DataFrame:
    """platform, is_verified: some payload gives a text and a cited source. Retrieved-only sources verify nothing."""
    cited = tables["citations"].where("is_cited").select(ID, "platform").distinct().withColumn("cited", F.lit(True))
    a = tables["answers"].join(cited, [ID, "platform"], "left")
    return a.groupBy("platform").agg(F.max((F.length("answer_text") > 0) & F.coalesce("cited", F.lit(False))).alias("is_verified"))
