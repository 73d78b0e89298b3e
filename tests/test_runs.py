import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import fixtures, payloads, rates
from plumbline.sources import records, runs
from plumbline.streaming import answers as stream


def write(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(doc, indent=2))


def test_answers_of_a_run(spark, tmp_path):
    base = tmp_path / "answers" / "openai"
    cite = [{"url": "https://a.example/x", "title": None, "domain": "a.example", "is_cited": True, "position": 0, "cited_text": None}]
    write(base / "q00_r0.json", {"schema": "answer-2", "run_id": "r", "engine": "openai", "query_index": 0, "repeat": 0, "answer_text": " 你好 ", "citations": cite, "searches": []})
    write(base / "q100_r1.json", {"schema": "answer-1", "run_id": "r", "engine": "openai", "query_index": 100, "repeat": 1, "answer_text": "old"})
    for name in ("q00_r0.raw.json", "q00_r0.json.tmp", "notes.json", "q1_r0.json"):
        write(base / name, {"schema": "stray"})
    write(base / "q02_r0.error.json", {"schema": "error-1", "engine": "openai", "query_index": 2, "repeat": 0, "error_type": "Timeout"})
    write(tmp_path / "manifest.json", {"run_id": "r", "mode": "live", "engines": {"openai": {"status": "ok", "planned": 3}}})
    got = {r.query_index: r for r in runs.answers(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 100} and got[0].answer_text == " 你好 " and got[0].searches == [] and got[100].searches is None
    assert got[0].source_file.endswith("q00_r0.json")
    assert [r.error_type for r in runs.errors(spark, str(tmp_path)).collect()] == ["Timeout"]
    assert runs.live_manifests(spark, str(tmp_path)).first().engines["openai"].planned == 3
    assert [(r.citation_index, r.url) for r in runs.citations(runs.answers(spark, str(tmp_path))).collect()] == [(0, "https://a.example/x")]


def test_ingest_replaces_partitions(spark, tmp_path):
    out = str(tmp_path / "facts")
    first = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "run_id string, engine string, n int")
    runs.ingest(first, out)
    runs.ingest(spark.createDataFrame([("r", "a", 9)], "run_id string, engine string, n int"), out)
    assert {(r.engine, r.n) for r in spark.read.parquet(out).collect()} == {("a", 9), ("b", 2)}


def test_file_names_and_hashes(spark):
    df = spark.createDataFrame([(3, 12, "{}")], "query_index int, repeat int, p string")
    r = runs.with_payload_hash(df, "p").select("*", runs.answer_file().alias("f")).first()
    assert r.f == "q03_r12.json" and r.raw_bytes == 2 and len(r.raw_sha256) == 64


def test_latest_by(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in rates.latest_by(df, ["k"], "t", "v").collect()} == {(1, "b"), (2, "c")}


def test_stream_counts_each_answer_once(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/answers.parquet")
    src = spark.readStream.schema(table.schema).parquet(f"{sf}/answers.parque[t]")
    q = stream.mention_counts(src, "kettle").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    got = {r.engine: r.n for r in spark.table("counts").collect()}
    want = {r.engine: r["count"] for r in table.dropDuplicates(["answer_id"]).where("not coalesce(params.no_fixture, false)").groupBy("engine").count().collect()}
    assert got == want
    assert {r.mention_n for r in stream.rates(spark.table("counts")).collect()} == set(want.values())


def test_manifests_and_run_ids(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.read_manifest(tmp_path)
    records.write_manifest(tmp_path, {"run_id": "r", "brand": "é"})
    assert records.read_manifest(tmp_path) == {"schema": "manifest-1", "run_id": "r", "brand": "é"} and [f.name for f in tmp_path.iterdir()] == ["manifest.json"]
    assert spark.sql("select timestamp'2026-03-04 05:06:07' as started_at").select(records.run_id().alias("x")).first().x == "20260304T050607Z"


def test_records_are_written_and_read_back(spark, tmp_path):
    payload = json.dumps({"model": "m", "content": [{"type": "text", "text": "Hi 你", "citations": [{"url": "https://a.example/x"}]}, {"type": "web_search_tool_result", "content": []}], "usage": {"input_tokens": 3}})
    calls = spark.createDataFrame([(1, "r", "anthropic", 0, 2, "m-0", "q?", "i", "2026-01-01", "2026-01-02", 1, "h", payload)], "payload_id long, run_id string, engine string, query_index int, repeat_no int, model_requested string, query_text string, intent string, requested_at string, observed_at string, prompt_set_version int, prompt_set_hash string, payload string")
    parsed = payloads.parse(calls.select("payload_id", F.col("engine").alias("platform"), "payload"))
    rows = records.answer_records(calls, parsed)
    r = rows.first()
    assert (r.answer_text, r.model, r.citations[0].url, r.citations[0].position, r.spans[0].end, r.searches, r.usage.input_tokens, r.raw_status) == ("Hi 你", "m", "https://a.example/x", 0, 4, None, 3, "kept")
    for _ in range(2):
        records.write_records(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    failed = spark.createDataFrame([("r", "anthropic", 0, 2, "t", "Timeout", None), ("r", "anthropic", 1, 0, "t", "Timeout", "m"), ("r", "anthropic", 1, 0, "t", "Timeout", "m")], "run_id string, engine string, query_index int, repeat_no int, requested_at string, error_type string, error_message string")
    assert [(e.query_index, e.schema, e.message) for e in records.still_failed(records.error_records(failed), rows).collect()] == [(1, "error-1", "m")]


def test_replay_of_recorded_answers(spark):
    recorded = spark.createDataFrame([("q", "e", 0, 5, 10), ("q", "e", 0, 6, 11), ("q", "e", 3, 7, 12)], "query_text string, engine string, repeat_no int, answer_id long, n int")
    asked = spark.createDataFrame([("q", "e", i) for i in range(3)] + [("other", "e", 0)], "query_text string, engine string, repeat_no int")
    got = {(r.query_text, r.repeat_no): (r.no_fixture, r.answer_id, r.n) for r in fixtures.replay(asked, recorded, "answer_id", "n").collect()}
    assert got == {("q", 0): (False, 5, 10), ("q", 1): (False, 7, 12), ("q", 2): (False, 5, 10), ("other", 0): (True, None, None)}
