import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import jsonstream
from plumbline.operators import drift, nested, payloads

A = {"id": "m", "content": [{"type": "text", "text": "Hi ", "citations": [{"url": "u1", "title": "t", "cited_text": "q"}]}, {"type": "text", "text": "你🙂", "citations": None}, {"type": "server_tool_use", "id": "s", "name": "web_search", "input": {"query": "find"}}, {"type": "web_search_tool_result", "tool_use_id": "s", "content": [{"url": "u1"}, {"url": "u2", "title": "two"}]}]}
O = {"output": [{"type": "web_search_call", "action": {"queries": ["q1", "q2"]}}, {"type": "message", "content": [{"type": "output_text", "text": "ab"}, {"type": "output_text", "text": "cdef", "annotations": [{"type": "url_citation", "url": "x", "start_index": 1, "end_index": 3}, {"type": "url_citation", "url": "y", "start_index": 1, "end_index": 3}, {"type": "url_citation", "url": "z", "start_index": 1, "end_index": 30}]}]}]}
G = {"candidates": [{"finishReason": None, "content": {"parts": {"text": "你好 ok"}}, "groundingMetadata": {"groundingChunks": [{"web": {"uri": "g1"}}, {"web": {"uri": "g2"}}], "groundingSupports": [{"segment": {"endIndex": 6, "text": "你好"}, "groundingChunkIndices": [0]}, {"segment": {"endIndex": 5, "text": "你好"}, "groundingChunkIndices": [1]}], "webSearchQueries": ["w"]}}]}


def frame(spark, rows):
    return spark.createDataFrame(rows, "payload_id long, platform string, payload string")


def levels(spark, rows):
    return {tuple(r) for r in nested.payload_levels(frame(spark, rows)).collect()}


def test_levels(spark):
    got = levels(spark, [(1, "anthropic", json.dumps(A)), (2, "openai", json.dumps(O)), (3, "google", json.dumps(G))])
    assert {r for r in got if r[0] == 1} == {
        (1, 0, "text", "", -1, -1), (1, 1, "text", "", -1, -1), (1, 2, "server_tool_use", "", -1, -1), (1, 3, "web_search_tool_result", "", -1, -1),
        (1, 0, "text", "citations", 0, -1), (1, 3, "web_search_tool_result", "content", 0, -1), (1, 3, "web_search_tool_result", "content", 1, -1),
    }
    assert (2, 1, "message", "content", 1, 2) in got and (2, 0, "web_search_call", "queries", 1, -1) in got
    assert (3, 0, "", "parts", 0, -1) in got and (3, 0, "", "groundingSupports", 1, 0) in got and (3, 0, "", "webSearchQueries", 0, -1) in got


@pytest.mark.parametrize("wrap", [json.dumps, lambda o: json.dumps(json.dumps(o)), lambda o: json.dumps({"platform": "x", "payload": o}), lambda o: json.dumps({"a": {"payload": json.dumps(o)}})])
def test_envelopes_make_no_difference(spark, wrap):
    assert levels(spark, [(1, "anthropic", wrap(A))]) == levels(spark, [(1, "anthropic", json.dumps(A))])


def test_levels_of_nothing(spark):
    rows = [(1, "openai", None), (2, "openai", '{"output": [{"type"'), (3, "openai", '{"output": null}'), (4, "openai", '{"output": []}'), (5, "google", "{}"), (6, "anthropic", "3"), (7, "openai", "")]
    assert levels(spark, rows) == set()
    assert levels(spark, []) == set()


def test_levels_repeated_rows_and_other_columns(spark):
    row = (1, "openai", json.dumps(O))
    once = levels(spark, [row])
    wide = frame(spark, [row, row]).withColumn("path", F.lit("clash")).withColumn("value", F.lit(1)).withColumn("ordinals", F.lit(2))
    got = [tuple(r) for r in nested.payload_levels(wide).collect()]
    assert len(got) == len(set(got)) and set(got) == once


def test_depth_has_no_limit():
    deep = '{"content": ' + "[" * 50_000 + "]" * 50_000 + "}"
    status, found = nested.read(deep, frozenset({"content"}), frozenset())
    assert status == nested.READ and len(found) == nested.MOST_DEPTH
    assert found[-1][2:] == ("array", "[" * (50_001 - nested.MOST_DEPTH) + "]" * (50_001 - nested.MOST_DEPTH))
    wanted = frozenset({"content[]"})
    assert nested.read(deep, wanted | {"content"}, frozenset({"content"}), wanted) == (nested.READ, [("content[]", (0,), "element", None)])
    assert nested.read("{" + '"a":{' * 50_000 + '"content":[1]' + "}" * 50_001, frozenset({"content"}), frozenset())[1] == [("content[]", (0,), "element", None), ("content[]", (0,), "number", "1")]


def test_records_under_many_layers():
    body = {"content": [{"type": "text"}]}
    want = [("content[]", (0,), "element", None), ("content[].type", (0,), "string", "text")]
    for text in (json.dumps({"a": " " * 70 + json.dumps(body)}), json.dumps([{"meta": 1}, {"payload": body}]), json.dumps(json.dumps(json.dumps(body)))):
        assert nested.read(text, frozenset({"content"}), frozenset()) == (nested.READ, want)
    for _ in range(40):
        body = {"envelope": body}
    assert nested.read(json.dumps(body), frozenset({"content"}), frozenset())[1] == want
    # the nearest one counts
    assert nested.read('{"a": {"b": {"content": [1]}}, "c": {"content": [2]}}', frozenset({"content"}), frozenset())[1][-1][3] == "2"


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", '"a', "{1:2}", "tru", "[1]]", '{"a":"\n"}', "01", "nul"])
def test_what_is_no_json(text):
    with pytest.raises(ValueError):
        list(jsonstream.events(text))
    assert nested.read(text, frozenset(), frozenset())[0] == nested.BROKEN


def test_events_and_values_agree_with_the_plain_parser():
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(7 if depth < 5 else 5)
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 6:
            return {rng.choice("abcé\"\\"): value(depth + 1) for _ in range(rng.randrange(4))}
        return rng.choice([None, True, False, 0, -1.5, 2e30, "", "x\n\u2028", '{"in": [1]}', "😀"])

    for _ in range(300):
        v = value(0)
        text = json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        real = json.loads
        jsonstream.json.loads = lambda t: (_ for _ in ()).throw(RecursionError)
        try:
            assert jsonstream.loads(text) == v
        finally:
            jsonstream.json.loads = real
    deep = jsonstream.loads("[" * 30_000 + "]" * 30_000)
    assert jsonstream.dumps(deep) == "[" * 30_000 + "]" * 30_000
    assert nested.read('{"a": [], "b": {}, "c": [ ], "d": [1]}', frozenset(), frozenset(), None, True)[1] == [("a", (), "array", "[]"), ("b", (), "object", "{}"), ("c", (), "array", "[ ]"), ("d[]", (0,), "element", None), ("d[]", (0,), "number", "1")]
    assert nested.read('{"a": [1, 2], "a": {"b": 3}, "c": null}', frozenset(), frozenset())[1] == [("a.b", (), "number", "3"), ("c", (), "null", None)]


def test_round_trip_of_tables(spark):
    t = nested.explode_triples(frame(spark, [(1, "x", json.dumps({"a": [{"b": 1, "c": [True, None]}, {"b": "two"}], "d": {"e": "f"}}))]), "payload_id", "payload")
    tables = nested.tables(t, "payload_id")
    assert set(tables) == {"", "a[]", "a[].c[]"}
    assert [(r.ordinals, r.b) for r in tables["a[]"].orderBy("ordinals").collect()] == [([0], "1"), ([1], "two")]
    assert [(r.ordinals, r.value) for r in tables["a[].c[]"].orderBy("ordinals").collect()] == [([0, 0], "true"), ([0, 1], None)]
    assert tables[""].first().d_e == "f"
    assert nested.infer_repeated(t) == {"a", "a[].c"}


def parsed(spark, platform, payload):
    return {k: v.where(F.col("platform") == platform) for k, v in payloads.parse(frame(spark, [(1, platform, json.dumps(payload))])).items()}


def test_anthropic(spark):
    p = parsed(spark, "anthropic", A)
    assert p["answers"].first().answer_text == "Hi 你🙂"
    assert [(r.url, r.is_cited, r.cite_position) for r in p["citations"].orderBy("citation_index").collect()] == [("u1", True, 0), ("u2", False, None)]
    assert [(r.span_start, r.span_end, r.citation_indexes) for r in p["spans"].collect()] == [(0, 3, [0])]
    assert [(r.search_query, r.results_count) for r in p["searches"].collect()] == [("find", 2)]


def test_openai(spark):
    p = parsed(spark, "openai", O)
    assert p["answers"].first().answer_text == "abcdef"
    assert [(r.span_start, r.span_end, r.citation_indexes) for r in p["spans"].collect()] == [(3, 5, [0, 1])]
    assert [r.search_query for r in p["searches"].orderBy("search_no").collect()] == ["q1", "q2"]


def test_google_counts_bytes_and_believes_only_matching_text(spark):
    p = parsed(spark, "google", G)
    assert [(r.span_start, r.span_end, r.citation_indexes) for r in p["spans"].collect()] == [(0, 2, [0])]
    assert {(r.url, r.is_cited) for r in p["citations"].collect()} == {("g1", True), ("g2", True)}


def test_other_platforms(spark):
    x = {"choices": [{"message": {"content": "t"}}], "citations": ["u1", {"url": "u2"}, "u1"]}
    assert [r.url for r in parsed(spark, "xai", x)["citations"].orderBy("citation_index").collect()] == ["u1", "u2"]
    y = {"choices": [{"message": {"content": "t"}}], "search_results": [{"url": "s", "title": "S"}], "citations": ["c", "s"]}
    assert [r.url for r in parsed(spark, "perplexity", y)["citations"].orderBy("citation_index").collect()] == ["s", "c"]


def test_what_answers_say_of_themselves(spark):
    a = A | {"model": "m-1", "stop_reason": "end_turn", "usage": {"input_tokens": 7, "output_tokens": True, "server_tool_use": {"web_search_requests": 1}}}
    r = parsed(spark, "anthropic", a)["answers"].first()
    assert (r.model, r.stop_reason, r.input_tokens, r.output_tokens, r.search_count, r.output_includes_reasoning) == ("m-1", "end_turn", 7, None, 1, True)
    assert (r.search_ran, r.cited_sources_available, r.retrieved_set_available, r.callers, r.spans_recorded, r.spans_dropped) == (True, True, True, "unknown", True, 0)
    r = parsed(spark, "openai", O | {"status": "incomplete", "incomplete_details": {"reason": "max_tokens"}})["answers"].first()
    assert (r.stop_reason, r.search_ran, r.cited_sources_available, r.retrieved_set_available, r.spans_dropped, r.model) == ("max_tokens", True, True, False, 1, None)
    r = parsed(spark, "google", G | {"usageMetadata": {"promptTokenCount": 3, "thoughtsTokenCount": -1}})["answers"].first()
    assert (r.input_tokens, r.reasoning_tokens, r.output_includes_reasoning, r.search_count, r.cited_sources_available, r.spans_dropped) == (3, None, False, None, True, 1)
    r = parsed(spark, "perplexity", {"choices": [{"message": {"content": "t"}, "finish_reason": "stop"}], "citations": []})["answers"].first()
    assert (r.stop_reason, r.cited_sources_available, r.empty_citation_channel, r.output_includes_reasoning) == ("stop", True, True, None)
    r = parsed(spark, "xai", {"choices": [{"message": {"content": "t"}}]})["answers"].first()
    assert (r.cited_sources_available, r.search_ran, r.answer_text) == (False, False, "t")


def test_an_answer_without_the_channel_for_citations(spark):
    a = {"content": [{"type": "text", "text": "hi", "citations": None}, {"type": "server_tool_use", "id": "s", "name": "code", "input": {"query": "x"}}, {"type": "web_search_tool_result", "tool_use_id": "t", "content": [], "caller": {"type": "direct"}}, {"type": "server_tool_use", "id": "t", "name": "web_search", "input": {"query": "y"}}]}
    p = parsed(spark, "anthropic", a)
    r = p["answers"].first()
    assert (r.search_ran, r.cited_sources_available, r.spans_recorded, r.callers) == (True, False, False, "direct")
    assert [(x.search_no, x.search_query, x.results_count) for x in p["searches"].collect()] == [(0, "y", 0)]


def test_more_searches_than_a_thousand(spark):
    o = {"output": [{"type": "web_search_call", "action": {"queries": [f"q{i}" for i in range(1100)]}}, {"type": "web_search_call", "action": {"query": "last"}}]}
    got = parsed(spark, "openai", o)["searches"].orderBy("search_no").collect()
    assert [r.search_no for r in got] == list(range(1101)) and got[-1].search_query == "last"


def test_verification_needs_a_cited_source(spark):
    only = {"content": [{"type": "text", "text": "hi"}, {"type": "web_search_tool_result", "content": [{"url": "u"}]}]}
    v = lambda o: [r.is_verified for r in payloads.verified(payloads.parse(frame(spark, [(1, "anthropic", json.dumps(o))]))).collect()]
    assert v(A) == [True] and v(only) == [False]


# --- drift ---


def lines(spark, files):
    rows = [(i, feed, n, json.dumps(r) if not isinstance(r, (str, type(None))) else r) for i, (feed, n, r) in enumerate((f, n, r) for (f, n), rs in files.items() for r in rs)]
    return spark.createDataFrame(rows, "record_id long, feed_id long, file_no int, body string")


def newest(df):
    p = drift.profiles(df, "feed_id", "file_no", "body")
    return drift.newest_names(drift.report(p), p)


def found(spark, files):
    return {tuple(r) for r in drift.report(drift.profiles(lines(spark, files), "feed_id", "file_no", "body")).collect()}


def test_changes(spark):
    old = [{"url": f"https://a{i}.example/p/{i}", "score": i / 7, "ok": True, "n": i} for i in range(8)]
    new = [{"link": f"https://b{i}.example/p/{i}", "score": str(i / 7), "extra": None, "n": i + 3} for i in range(8)]
    assert found(spark, {(1, 1): old, (1, 4): new}) == {(1, 4, "url", "renamed", "link"), (1, 4, "score", "retyped", ""), (1, 4, "ok", "removed", ""), (1, 4, "extra", "added", "")}


def test_nested_changes_and_other_content_is_no_rename(spark):
    old = [{"payload": {"output": [{"type": "message", "text": "a b"}], "usage": {"input": 5000 + i}}, "state": "done"} for i in range(6)]
    new = [{"payload": {"output": [{"kind": "message", "text": "a b"}], "usage": {"prompt": 5100 + i}}, "trace": f"tr-{i}f3a"} for i in range(6)]
    assert found(spark, {(1, 1): old, (1, 2): new}) == {(1, 2, "payload.output.type", "renamed", "payload.output.kind"), (1, 2, "payload.usage.input", "renamed", "payload.usage.prompt"), (1, 2, "state", "removed", ""), (1, 2, "trace", "added", "")}


def test_nulls_broken_lines_and_repeats_change_nothing(spark):
    a = [{"x": 1, "y": "a"}, {"x": None, "y": "b"}]
    assert found(spark, {(1, 1): a, (1, 2): [*a, *a, "{broken", None, "[1]"], (2, 1): a}) == set()
    assert found(spark, {(1, 1): [{"x": 1}], (1, 2): [{"x": None}], (1, 3): [{"x": "s"}]}) == set()
    assert found(spark, {(1, 1): [{"x": 1}], (1, 2): [{"x": 1.5}]}) == set()


def test_profiles_merge_like_one(spark):
    values = [1, 2.5, None, "text", ["a", {"b": "c"}], True, 7]
    whole = drift.profile(values)
    for k in range(len(values) + 1):
        assert drift.merge(drift.profile(values[:k]), drift.profile(values[k:])) == pytest.approx(whole) if False else drift.merge(drift.profile(values[:k]), drift.profile(values[k:]))["values"] == whole["values"]


def test_consistent_follows_renames(spark):
    files = {(1, 1): [{"a": "x-1"}, {"a": "x-2"}], (1, 2): [{"b": "x-3"}, {"b": "x-1"}], (1, 3): [{"c": "x-4"}, {"c": "x-1"}]}
    df = lines(spark, files)
    changed = newest(df)
    long = drift.consistent(df, changed, "feed_id", "file_no", "body", ["record_id"])
    assert {r.field for r in long.collect()} == {"c"}
    assert {r.value for r in long.where("field = 'c'").collect()} == {"x-1", "x-2", "x-3", "x-4"}


def test_empty_tables(spark):
    df = lines(spark, {(1, 1): [{"a": 1}]}).limit(0)
    assert drift.report(drift.profiles(df, "feed_id", "file_no", "body")).count() == 0


def test_consistent_keeps_every_element_and_value(spark):
    twins = [{"type": "a", "id": "1"}, {"type": "a", "id": "1"}, {"type": "b"}, "text", {}]
    df = lines(spark, {(1, 1): [{"payload": {"output": twins, "usage": 7}}, {"payload": None}, {"payload": ["x", {"output": [{"id": "2"}]}]}]})
    changed = newest(df)
    rows = [tuple(r) for r in drift.consistent(df, changed, "feed_id", "file_no", "body", ["record_id"]).collect()]
    assert sorted(rows, key=str) == sorted([
        (0, "0", "payload.output.type", "string", "a"), (0, "0", "payload.output.id", "string", "1"), (0, "1", "payload.output.type", "string", "a"), (0, "1", "payload.output.id", "string", "1"),
        (0, "2", "payload.output.type", "string", "b"), (0, "3", "payload.output", "string", "text"), (0, "4", "payload.output", "object", "{}"), (0, "", "payload.usage", "number", "7"),
        (1, "", "payload", "null", None), (2, "0", "payload", "string", "x"), (2, "1.0", "payload.output.id", "string", "2"),
    ], key=str)


def test_a_rename_onto_a_name_of_the_line_loses_nothing(spark):
    df = lines(spark, {(1, 1): [{"a": "x-1", "b": "old"}], (1, 3): [{"b": "x-2"}]})
    changed = spark.createDataFrame([(1, 3, "a", "renamed", "b")], "feed_id long, file_no int, field_path string, change_kind string, new_path string")
    rows = drift.consistent(df, drift.newest_names(changed, df.select("feed_id", "file_no").distinct()), "feed_id", "file_no", "body", ["record_id"]).collect()
    assert {(r.record_id, r.field, r.value) for r in rows} == {(0, "a", "x-1"), (0, "b", "old"), (1, "b", "x-2")}


def test_table_casts_what_it_can_without_loss(spark):
    rows = [{"n": 1, "x": 0.5, "ok": True, "code": "007", "big": 12345678901234567890, "mix": 1, "A": "u", "a": "l"}, {"n": "2", "x": 3, "ok": "false", "code": "8", "big": 1.5, "mix": ["z"], "payload": {"output": [{"k": 1}, {"k": 2}]}}]
    df = lines(spark, {(1, 1): rows})
    changed = newest(df)
    wide = drift.table(drift.consistent(df, changed, "feed_id", "file_no", "body", ["record_id"]), ["record_id"])
    assert dict(wide.dtypes) == {"record_id": "bigint", "place": "string", "A": "string", "a_": "string", "big": "string", "code": "string", "mix": "string", "n": "bigint", "ok": "boolean", "payload_output_k": "bigint", "x": "double"}
    got = {(r.record_id, r.place): r for r in wide.collect()}
    assert (got[0, ""].n, got[0, ""].ok, got[0, ""].big, got[0, ""]["a_"], got[1, ""].n, got[1, ""].x, got[1, ""].ok, got[1, ""].mix) == (1, True, "12345678901234567890", "l", 2, 3.0, False, '["z"]')
    assert [got[1, p].payload_output_k for p in ("0", "1")] == [1, 2] and len(got) == 4


def test_children_of_a_renamed_object_follow_it():
    old = {"meta": drift.profile([{"url": "https://a.example/1"}] * 3), "meta.url": drift.profile(["https://a.example/1", "https://b.example/2"]), "n": drift.profile([1])}
    new = {"info": drift.profile([{"link": "https://a.example/1"}] * 3), "info.link": drift.profile(["https://a.example/1", "https://b.example/2"]), "n": drift.profile([2])}
    assert {(a, b) for a, b, _ in drift.flood(old, new)} == {("meta", "info"), ("meta.url", "info.link")}


def test_many_fields_that_went_and_came():
    side = lambda k: {f"{k}{i}": drift.profile([f"value {i} of {j}" for j in range(4)]) for i in range(40)}
    got = drift.flood(side("old"), side("new"))
    assert {(a[3:], b[3:]) for a, b, _ in got} == {(str(i), str(i)) for i in range(40)}


def test_long_values_with_one_opening_differ():
    a, b = (drift.profile(["x" * 300 + c + str(i) for i in range(3)]) for c in "ab")
    assert not set(a["values"]) & set(b["values"])


def test_deep_and_unreadable_lines(spark):
    deep = '{"a": ' + "[" * 20_000 + "]" * 20_000 + "}"
    df = lines(spark, {(1, 1): [deep, None, "[1]", "{"], (1, 2): ['{"a": [1], "b": 1}']})
    assert {tuple(r) for r in drift.report(drift.profiles(df, "feed_id", "file_no", "body")).collect()} == {(1, 2, "b", "added", "")}
    got = drift.consistent(df, newest(df), "feed_id", "file_no", "body", ["record_id"]).where("field = 'a'").collect()
    assert sorted(len(r.value) for r in got) == [3, 40_000]


def test_names_are_swapped_at_once(spark):
    changed = spark.createDataFrame([(1, 2, "a", "renamed", "b"), (1, 2, "b", "renamed", "a"), (1, 4, "a", "renamed", "c")], "feed_id long, file_no int, field_path string, change_kind string, new_path string")
    files = spark.createDataFrame([(1, n) for n in range(1, 6)], "feed_id long, file_no int")
    assert {r.file_no: r.names for r in drift.newest_names(changed, files).collect()} == {3: {"a": "c"}, 2: {"a": "c"}, 1: {"a": "b", "b": "c"}}
