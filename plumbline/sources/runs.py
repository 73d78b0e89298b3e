"""Runs on disk: one JSON file for each answer, error and manifest, read into tables and written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER_FILE = r"^q\d{2,}_r\d+\.json$"
CITATION = "struct<url:string,title:string,domain:string,is_cited:boolean,position:int,cited_text:string>"
#: Records of the first version lack the fields after retrieved_set_available; read as null, never as 0.
ANSWER = (
    f"""schema string, run_id string, engine string, model string, model_requested string, model_reported_by_platform boolean,
    params struct<no_fixture:boolean,search_ran:boolean,empty_citation_channel:boolean>, query_index int, repeat int, query_text string, intent string,
    requested_at timestamp, observed_at timestamp, answer_text string, citations array<{CITATION}>, cited_sources_available boolean, retrieved_set_available boolean,
    stop_reason string, prompt_set_version int, prompt_set_hash string, searches array<struct<query:string,results_count:int>>, search_count int,
    spans array<struct<start:int,end:int,citation_indexes:array<int>>>, spans_dropped int,
    usage struct<input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint,output_includes_reasoning:boolean>,
    raw_status string, raw_file string, raw_sha256 string, raw_bytes bigint, cost_estimate_usd double"""
)
ERROR = "schema string, run_id string, engine string, query_index int, repeat int, requested_at timestamp, error_type string, message string"
MANIFEST = (
    """run_id string, tool_version string, mode string, started_at timestamp, finished_at timestamp, status string, brand string, config_hash string,
    prompt_set struct<version:int,hash:string,n_queries:int>, repeats int, recommendation_intents array<string>,
    engines map<string,struct<status:string,planned:int,done:int,failed:int>>, calls struct<planned:int,made:int,failed:int,cap:int>"""
)


def _json(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("_name"))


def answers(spark: SparkSession, run_dir: str) -> DataFrame:
    """All answers of a run, with the file each came from. Raw payloads, errors, half-written and stray files are left out."""
    return _json(spark, f"{run_dir}/answers", ANSWER, "q*_r*.json").where(F.col("_name").rlike(ANSWER_FILE)).drop("_name")


def errors(spark: SparkSession, run_dir: str) -> DataFrame:
    return _json(spark, f"{run_dir}/answers", ERROR, "*.error.json").drop("_name")


def manifests(spark: SparkSession, brand_dir: str) -> DataFrame:
    return _json(spark, brand_dir, MANIFEST, "manifest.json").drop("_name")


def live_manifests(spark: SparkSession, brand_dir: str) -> DataFrame:
    return manifests(spark, brand_dir).where("mode = 'live'")


def citations(answers: DataFrame) -> DataFrame:
    """One row for each citation of each answer; its place in the array is what spans refer to."""
    key = ["run_id", "engine", "query_index", "repeat"]
    return answers.select(*key, F.posexplode("citations").alias("citation_index", "c")).select(*key, "citation_index", "c.*")


def ingest(df: DataFrame, path: str) -> None:
    """As Parquet, partitioned so that a run or an engine is read alone; what is there of these partitions is replaced whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "engine").parquet(path)


def answer_file(query_index: str = "query_index", repeat: str = "repeat"):
    return F.format_string("q%02d_r%d.json", F.col(query_index), F.col(repeat))


def page_file(url: str = "url"):
    return F.concat(F.left(F.sha2(F.col(url), 256), F.lit(24)), F.lit(".json"))


def with_payload_hash(df: DataFrame, payload: str) -> DataFrame:
    """raw_sha256 and raw_bytes of a payload as it stands."""
    return df.withColumn("raw_sha256", F.sha2(F.col(payload), 256)).withColumn("raw_bytes", F.octet_length(payload).cast("long"))
