"""Queries of the general record operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import drift, nested
from plumbline.operators.lineage import cut


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.payload_levels(_t(spark, sf, "raw_payloads"))


def _triples(spark: SparkSession, sf: str, wanted: list[str] | None = None) -> DataFrame:
    return nested.explode_triples(_t(spark, sf, "raw_payloads"), "payload_id", "payload", nested.REPEATED, nested.ITEMS.values(), "platform", wanted)


def p4_path_groups(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each repeated ancestor's table has."""
    t = _triples(spark, sf).where("kind = 'element'").select("payload_id", "path", "ordinals").distinct()
    return t.groupBy("path").agg(F.count("*").alias("n_rows"), F.countDistinct("payload_id").alias("n_payloads"))


def p4_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """How many payloads of each platform were read, and why the others were not."""
    rows = nested.statuses(_t(spark, sf, "raw_payloads"), "payload", nested.ITEMS.values(), "payload_id", "platform").distinct()
    return rows.groupBy("platform", "record_status").agg(F.count("*").alias("n"))


#: the flat tables with their values: (platform, repeated ancestor, columns and the paths below it)
FLAT = {
    "p4_content": ("anthropic", "content[]", {"type": "type", "text": "text", "id": "id", "name": "name", "tool_use_id": "tool_use_id", "search_query": "input.query"}),
    "p4_content_citations": ("anthropic", "content[].citations[]", {"type": "type", "url": "url", "title": "title", "cited_text": "cited_text"}),
    "p4_content_results": ("anthropic", "content[].content[]", {"type": "type", "url": "url", "title": "title", "page_age": "page_age"}),
    "p4_output": ("openai", "output[]", {"type": "type", "id": "id", "status": "status", "action_type": "action.type"}),
    "p4_output_content": ("openai", "output[].content[]", {"type": "type", "text": "text", "refusal": "refusal"}),
    "p4_output_queries": ("openai", "output[].action.queries[]", {"search_query": ""}),
    "p4_annotations": ("openai", "output[].content[].annotations[]", {"type": "type", "url": "url", "title": "title", "start_index": "start_index", "end_index": "end_index"}),
    "p4_candidates": ("google", "candidates[]", {"finish_reason": "finishReason", "role": "content.role"}),
    "p4_parts": ("google", "candidates[].content.parts[]", {"text": "text"}),
    "p4_grounding_chunks": ("google", "candidates[].groundingMetadata.groundingChunks[]", {"uri": "web.uri", "title": "web.title"}),
    "p4_grounding_supports": ("google", "candidates[].groundingMetadata.groundingSupports[]", {"start_index": "segment.startIndex", "end_index": "segment.endIndex", "text": "segment.text"}),
    "p4_grounding_queries": ("google", "candidates[].groundingMetadata.webSearchQueries[]", {"search_query": ""}),
    "p4_chunk_indices": ("google", "candidates[].groundingMetadata.groundingSupports[].groundingChunkIndices[]", {"chunk_index": ""}),
}
POSITIONS = ("item_pos", "child_pos", "leaf_pos")


def _flat(name: str):
    own, group, fields = FLAT[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = _triples(spark, sf, [group, *(f"{group}.{p}" if p else group for p in fields.values())]).where(F.col("platform") == own)
        rows = nested.group_table(t, "payload_id", group, fields)
        return rows.select("payload_id", *[F.get("ordinals", F.lit(i)).alias(p) for i, p in enumerate(POSITIONS[: group.count("[]")])], *fields)

    run.__name__, run.__doc__ = name, f"The flat table of {group}: a row for each element, with its place in each array above it and its values."
    return run


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return drift.profiles(_t(spark, sf, "export_records"), "feed_id", "file_no", "body")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.report(_profiles(spark, sf))


LINE = ["record_id", "record_kind", "feed_id", "file_no", "line_no"]


def _consistent(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    profiled = _profiles(spark, sf)
    names = drift.newest_names(drift.report(profiled), profiled)
    rows = _t(spark, sf, "export_records").select(*LINE, "body").where("true" if kind is None else F.col("record_kind") == kind)
    return drift.consistent(rows.dropDuplicates(["record_id"]), names, "feed_id", "file_no", "body", LINE)


def p6_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of each file and their types."""
    return drift.schemas(_profiles(spark, sf))


def _fields_sql() -> str:
    """Every field of every line, level by level: the table's own, then of payload, payload.output and payload.usage."""
    of = lambda source, prefix: f"SELECT feed_id, file_no, '{prefix}' || k AS path, json_extract(j, '$.\"' || k || '\"') AS v FROM (SELECT feed_id, file_no, j, unnest(json_keys(j)) AS k FROM {source})"
    inside = lambda source, path: f"SELECT feed_id, file_no, j FROM (SELECT feed_id, file_no, unnest({_elements('v')}) AS j FROM {source} WHERE path = '{path}') WHERE json_type(j) = 'OBJECT'"
    return f"""WITH b AS (SELECT feed_id, file_no, body::JSON AS j FROM export_records WHERE json_valid(body) AND json_type(body) = 'OBJECT'), top AS ({of('b', '')}),
  pj AS ({inside('top', 'payload')}), p AS ({of('pj', 'payload.')}), oj AS ({inside('p', 'payload.output')}), o AS ({of('oj', 'payload.output.')}), uj AS ({inside('p', 'payload.usage')}), u AS ({of('uj', 'payload.usage.')}),
  f AS (SELECT * FROM top UNION ALL SELECT * FROM p UNION ALL SELECT * FROM o UNION ALL SELECT * FROM u)
  SELECT feed_id, file_no::int AS file_no, path AS field_path, coalesce(string_agg(DISTINCT CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END, ',' ORDER BY CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END), '') AS types FROM f GROUP BY 1, 2, 3"""


def p6_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return _consistent(spark, sf)


def _kind_table(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return drift.table(cut(_consistent(spark, sf, kind)), [c for c in LINE if c != "record_kind"])


def p6_faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    return _kind_table(spark, sf, "faithfulness")


def p6_page(spark: SparkSession, sf: str) -> DataFrame:
    return _kind_table(spark, sf, "page")


def p6_payload(spark: SparkSession, sf: str) -> DataFrame:
    return _kind_table(spark, sf, "payload")


def _elements(x: str) -> str:
    """SQL: the elements of an array; an object in its place is one, anything else none."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _level(source: str, keep: str, array: str, name: str) -> str:
    """SQL: a row for each element of an array of each row of a source."""
    return f"SELECT {keep}, unnest(x) AS e, generate_subscripts(x, 1) - 1 AS {name} FROM (SELECT *, {_elements(array)} AS x FROM {source}) WHERE len(x) > 0"


def p4_levels() -> str:
    """CTEs of records, items, children and leaves, each with its JSON (e). Up to two layers of string and one enclosing object, as the test tables have them."""
    kinds = []
    for own, path, child in nested.CHILDREN:
        inner = path.split("[].", 1)[1].removesuffix("[]")
        kinds.append(_level(f"(SELECT * FROM items WHERE platform = '{own}')", f"payload_id, item_pos, item_type, '{child}' AS child_kind, platform, '{path}' AS path", f"json_extract(e, '$.{inner}')", "child_pos"))
    leaves = []
    for own, path, child in nested.LEAVES:
        inner = path.removesuffix("[]").rsplit(".", 1)[1]
        leaves.append(_level(f"(SELECT * FROM children WHERE platform = '{own}' AND child_kind = '{child}')", f"payload_id, item_pos, item_type, child_kind, child_pos, platform, '{path}' AS path", f"json_extract(e, '$.{inner}')", "leaf_pos"))
    array = "CASE platform " + " ".join(f"WHEN '{p}' THEN json_extract(p, '$.{k}')" for p, k in nested.ITEMS.items()) + " END"
    return f"""WITH d AS (SELECT DISTINCT ON (payload_id) payload_id, platform, payload FROM raw_payloads WHERE payload IS NOT NULL AND json_valid(payload)),
  s AS (SELECT payload_id, platform, CASE WHEN json_type(payload) = 'VARCHAR' THEN payload::JSON->>'$' ELSE payload END AS p FROM d),
  o AS (SELECT payload_id, platform, CASE WHEN json_exists(p, '$.payload') THEN json_extract(p, '$.payload') ELSE p::JSON END AS p FROM s WHERE json_valid(p)),
  r AS (SELECT payload_id, platform, CASE WHEN json_type(p) = 'VARCHAR' THEN (p->>'$')::JSON ELSE p END AS p FROM o),
  i AS ({_level('r', 'payload_id, platform', array, 'item_pos')}),
  items AS (SELECT *, coalesce(json_extract_string(e, CASE platform WHEN 'google' THEN '$.finishReason' ELSE '$.type' END), '') AS item_type, CASE platform {' '.join(f"WHEN '{p}' THEN '{k}[]'" for p, k in nested.ITEMS.items())} END AS path FROM i),
  children AS ({' UNION ALL '.join(kinds)}), leaves AS ({' UNION ALL '.join(leaves)})"""


def _p4_sql() -> str:
    return f"""{p4_levels()}
  SELECT payload_id, item_pos, item_type, '' AS child_kind, -1 AS child_pos, -1 AS leaf_pos FROM items
  UNION ALL SELECT payload_id, item_pos, item_type, child_kind, child_pos, -1 FROM children
  UNION ALL SELECT payload_id, item_pos, item_type, child_kind, child_pos, leaf_pos FROM leaves"""


def _flat_sql(name: str) -> str:
    own, group, fields = FLAT[name]
    depth = group.count("[]")
    at = lambda p: "'$" + (f".{p}" if p else "") + "'"
    value = lambda p: f"CASE WHEN json_type(e, {at(p)}) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(e, {at(p)}) END"
    return f"{p4_levels()} SELECT payload_id, {', '.join(POSITIONS[:depth])}, {', '.join(f'{value(p)} AS {n}' for n, p in fields.items())} FROM {('items', 'children', 'leaves')[depth - 1]} WHERE platform = '{own}' AND path = '{group}'"


def _p4_groups_sql() -> str:
    """Counts of every path that the levels name."""
    each = " UNION ALL ".join(f"SELECT payload_id, path FROM {x}" for x in ("items", "children", "leaves"))
    return f"{p4_levels()} SELECT path, count(*) AS n_rows, count(DISTINCT payload_id) AS n_payloads FROM ({each}) GROUP BY 1"


_STATUSES = f"""{p4_levels()}, q AS (SELECT DISTINCT payload_id, platform, payload FROM raw_payloads), f AS (SELECT payload_id, json_exists(p, '$.content') OR json_exists(p, '$.output') OR json_exists(p, '$.candidates') AS known FROM r)
  SELECT platform, CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'broken' WHEN coalesce(known, false) THEN 'read' ELSE 'no_record' END AS record_status, count(*) AS n FROM q LEFT JOIN f USING (payload_id) GROUP BY 1, 2"""


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_path_groups, p4_statuses, *map(_flat, FLAT), p6_found, p6_schemas, p6_consistent, p6_faithfulness, p6_page, p6_payload)}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _p4_sql(), "p4_path_groups": _p4_groups_sql(), "p4_statuses": _STATUSES, "p6_schemas": _fields_sql()} | {n: _flat_sql(n) for n in FLAT}
