"""Stored records made of parsed payloads: answers and errors as the store keeps them, and the documents of a run.

Nothing is normalised: texts stay as they came, since offsets point into them. A table of records is written with the
commit protocol of the writer, so it is there whole or not at all; the small documents are written beside and moved.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.payloads import ID, Tables
from plumbline.operators.planning import KEY

ANSWER_SCHEMA, ERROR_SCHEMA, MANIFEST_SCHEMA = "answer-2", "error-1", "manifest-1"
KEPT, NOT_KEPT, NOT_PROVIDED = "kept", "not_kept", "not_provided"


def run_id(at: Column | str = "started_at") -> Column:
    """The id of a run that begins at a time: UTC to the second."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def _listed(df: DataFrame, order: str, to: str, **fields: str) -> DataFrame:
    """The rows of a payload as an array of structs in order."""
    s = F.struct(order, *[F.col(c).alias(n) for n, c in fields.items()])
    items = F.transform(F.array_sort(F.collect_list(s)), lambda x: F.struct(*[x[n].alias(n) for n in fields]))
    return df.groupBy(ID).agg(items.alias(to))


def answer_records(calls: DataFrame, parsed: Tables, payload: str = "payload", keep_raw: bool = True) -> DataFrame:
    """One record for each call whose payload was read. calls: payload_id, ``KEY``, model_requested, query_text, intent, requested_at, observed_at, prompt_set_version, prompt_set_hash and the payload.

    ``spans`` and ``searches`` are null where the platform doesn't tell, and empty where it tells of none.
    """
    a = parsed["answers"]
    cites = _listed(parsed["citations"], "citation_index", "citations", url="url", title="title", domain="domain", is_cited="is_cited", position="cite_position", cited_text="cited_text")
    found = _listed(parsed["searches"], "search_no", "searches", query="search_query", results_count="results_count")
    spans = _listed(parsed["spans"], "span_start", "spans", start="span_start", end="span_end", citation_indexes="citation_indexes")
    raw = F.col(payload)
    rows = calls.join(a, ID).join(cites, ID, "left").join(found, ID, "left").join(spans, ID, "left")
    none = lambda c, kind: F.coalesce(c, F.from_json(F.lit("[]"), kind))
    kind = {c: parsed_kind(df, c) for df, c in ((cites, "citations"), (spans, "spans"))}
    usage = F.struct("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "output_includes_reasoning")
    params = F.struct(F.col("model_requested"), F.col("model").isNotNull().alias("model_reported_by_platform"), "search_ran", "empty_citation_channel", F.when(F.col("callers") != "", F.split("callers", ",")).alias("search_callers"))
    return rows.select(
        F.lit(ANSWER_SCHEMA).alias("schema"), *KEY, F.coalesce("model", "model_requested").alias("model"), "model_requested", F.col("model").isNotNull().alias("model_reported_by_platform"), params.alias("params"),
        "query_text", "intent", "requested_at", "observed_at", "answer_text", none(F.col("citations"), kind["citations"]).alias("citations"), "cited_sources_available", "retrieved_set_available", "stop_reason", "prompt_set_version", "prompt_set_hash",
        "searches", "search_count", F.when(F.col("spans_recorded"), none(F.col("spans"), kind["spans"])).alias("spans"), "spans_dropped", F.when(F.coalesce("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens").isNotNull(), usage).alias("usage"),
        F.when(raw.isNull(), NOT_PROVIDED).when(F.lit(keep_raw), KEPT).otherwise(NOT_KEPT).alias("raw_status"), F.sha2(raw, 256).alias("raw_sha256"), F.octet_length(raw).cast("long").alias("raw_bytes"), ID,
    )


def parsed_kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def error_records(failures: DataFrame) -> DataFrame:
    """What went wrong with a call: its kind and message only. failures: ``KEY``, requested_at, error_type, error_message."""
    return failures.select(F.lit(ERROR_SCHEMA).alias("schema"), *KEY, "requested_at", "error_type", F.col("error_message").alias("message"))


def still_failed(errors: DataFrame, answers: DataFrame) -> DataFrame:
    """Errors of calls that no answer has come for since, each once."""
    return errors.dropDuplicates().join(answers.select(*KEY).distinct(), KEY, "left_anti")


def write_records(df: DataFrame, path: str) -> None:
    """As JSON, a folder for each run and engine; what these had is replaced whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "engine").json(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What a store holds; a run or an engine that is asked for is read alone."""
    return spark.read.schema(schema).json(path)


def write_json(path: str | Path, document: dict) -> None:
    """A small document of the driver, there whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{path.name}.tmp")
    draft.write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    draft.replace(path)


def write_manifest(run_dir: str | Path, manifest: dict) -> None:
    write_json(Path(run_dir) / "manifest.json", {"schema": MANIFEST_SCHEMA, **manifest})


def read_manifest(run_dir: str | Path) -> dict:
    path = Path(run_dir) / "manifest.json"
    if not path.is_file():
        raise FileNotFoundError(f"{run_dir} holds no run: there is no manifest.json")
    return json.loads(path.read_text(encoding="utf-8"))
