"""SQL of the payload queries, written over the JSON itself: records, items, children and leaves of ``general``, then what each platform's answer says."""

from __future__ import annotations

from plumbline.functions import hosts
from plumbline.plans.general import p4_levels

_G = "candidates[].groundingMetadata."


def _scalar(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{path}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string({x}, '$.{path}') END"


def _string(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{path}') = 'VARCHAR' THEN json_extract_string({x}, '$.{path}') END"


def _whole(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{path}') = 'UBIGINT' THEN json_extract_string({x}, '$.{path}')::bigint END"


def _offset(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '$.{path}') IN ('UBIGINT', 'BIGINT') THEN json_extract_string({x}, '$.{path}')::bigint END"


_BASE = "coalesce(sum(length(t)) OVER (PARTITION BY payload_id ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS base"
_NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}\\x{{85}}]+|[\\s\\p{{Z}}\\x{{85}}]+$', '', 'g')"

_CTES = f"""{p4_levels()},
  atx AS (SELECT payload_id, item_pos, t, {_BASE.format('item_pos')} FROM (SELECT payload_id, item_pos, coalesce({_scalar('e', 'text')}, '') AS t FROM items WHERE platform = 'anthropic' AND item_type = 'text')),
  ac AS (SELECT c.payload_id, c.item_pos, c.child_pos, {_scalar('e', 'url')} AS url, {_scalar('e', 'title')} AS title, {_scalar('e', 'cited_text')} AS cited_text FROM children c WHERE path = 'content[].citations[]' AND item_type = 'text' AND json_type(e) = 'OBJECT'),
  ar AS (SELECT payload_id, item_pos, child_pos, {_scalar('e', 'url')} AS url, {_scalar('e', 'title')} AS title FROM children WHERE path = 'content[].content[]' AND item_type = 'web_search_tool_result'),
  ot AS (SELECT payload_id, item_pos, child_pos, t, {_BASE.format('item_pos, child_pos')} FROM (SELECT payload_id, item_pos, child_pos, coalesce({_scalar('e', 'text')}, '') AS t FROM children WHERE path = 'output[].content[]' AND item_type = 'message' AND {_string('e', 'type')} = 'output_text')),
  oa AS (SELECT l.payload_id, l.item_pos, l.child_pos, leaf_pos, base, {_scalar('e', 'url')} AS url, {_scalar('e', 'title')} AS title, base + {_offset('e', 'start_index')} AS a, base + {_offset('e', 'end_index')} AS b FROM leaves l JOIN ot USING (payload_id, item_pos, child_pos) WHERE path = 'output[].content[].annotations[]' AND {_string('e', 'type')} = 'url_citation' AND coalesce({_scalar('e', 'url')}, '') <> ''),
  gt AS (SELECT payload_id, string_agg(t, '' ORDER BY child_pos) AS t FROM (SELECT payload_id, child_pos, {_scalar('e', 'text')} AS t FROM children WHERE path = 'candidates[].content.parts[]' AND item_pos = 0) WHERE t IS NOT NULL GROUP BY 1),
  gc AS (SELECT payload_id, child_pos AS chunk, {_scalar('e', 'web.uri')} AS url, {_scalar('e', 'web.title')} AS title FROM children WHERE path = '{_G}groundingChunks[]' AND item_pos = 0),
  gl AS (SELECT payload_id, child_pos AS support, CASE WHEN json_type(e) = 'UBIGINT' THEN e::bigint END AS chunk FROM leaves WHERE path = '{_G}groundingSupports[].groundingChunkIndices[]' AND item_pos = 0),
  gu AS (SELECT DISTINCT payload_id, url FROM gl JOIN gc USING (payload_id, chunk)),
  src AS (SELECT payload_id, 'anthropic' AS platform, true AS is_cited, item_pos AS x, child_pos AS y, 0 AS z, url, title, cited_text FROM ac
    UNION ALL SELECT payload_id, 'anthropic', false, item_pos, child_pos, 0, url, title, NULL FROM ar UNION ALL SELECT payload_id, 'openai', true, item_pos, child_pos, leaf_pos, url, title, NULL FROM oa
    UNION ALL SELECT payload_id, 'google', gu.url IS NOT NULL, chunk, 0, 0, gc.url, title, NULL FROM gc LEFT JOIN gu USING (payload_id, url)),
  one AS (SELECT * FROM src WHERE coalesce(url, '') <> '' QUALIFY row_number() OVER (PARTITION BY payload_id, url ORDER BY is_cited DESC, x, y, z) = 1),
  ci AS (SELECT payload_id, platform, row_number() OVER (PARTITION BY payload_id ORDER BY is_cited DESC, x, y, z) - 1 AS citation_index, url, title, cited_text, is_cited FROM one),
  full_text AS (SELECT payload_id, string_agg(t, '' ORDER BY item_pos) AS t FROM atx GROUP BY 1 UNION ALL SELECT payload_id, string_agg(t, '' ORDER BY item_pos, child_pos) FROM ot GROUP BY 1 UNION ALL SELECT * FROM gt),
  gs AS (SELECT s.payload_id, child_pos AS support, list_transform(range(0, length(coalesce(t, '')) + 1), lambda i: octet_length(encode(left(coalesce(t, ''), i)))) AS at_byte, coalesce(t, '') AS t, CASE WHEN json_exists(e, '$.segment.startIndex') THEN {_whole('e', 'segment.startIndex')} ELSE 0 END AS a, {_whole('e', 'segment.endIndex')} AS b, {_scalar('e', 'segment.text')} AS said FROM children s LEFT JOIN gt USING (payload_id) WHERE path = '{_G}groundingSupports[]' AND item_pos = 0),
  gp AS (SELECT payload_id, support, t, said, list_position(at_byte, a) - 1 AS a, list_position(at_byte, b) - 1 AS b FROM gs),
  gx AS (SELECT payload_id, support, list(citation_index) AS ix, count(*) FILTER (citation_index IS NULL) AS lost FROM gl LEFT JOIN gc USING (payload_id, chunk) LEFT JOIN ci USING (payload_id, url) GROUP BY 1, 2),
  rng AS (SELECT payload_id, 'anthropic' AS platform, base AS a, base + length(any_value(t)) AS b, list(citation_index) AS ix, count(*) FILTER (citation_index IS NULL) AS lost, true AS placed FROM atx JOIN ac USING (payload_id, item_pos) LEFT JOIN ci USING (payload_id, url) GROUP BY payload_id, item_pos, base
    UNION ALL SELECT payload_id, 'openai', a, b, list(citation_index), 0, true FROM oa JOIN ci USING (payload_id, url) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY payload_id, a, b
    UNION ALL SELECT payload_id, 'openai', NULL, NULL, NULL, 0, false FROM oa WHERE a IS NULL OR b IS NULL
    UNION ALL SELECT payload_id, 'google', a, b, ix, lost, coalesce(a IS NOT NULL AND b IS NOT NULL AND (said IS NULL OR {_STRIP.format("t[a + 1:b]")} = {_STRIP.format('said')}), false) FROM gp LEFT JOIN gx USING (payload_id, support)),
  judged AS (SELECT rng.*, coalesce(placed AND a >= 0 AND a < b AND b <= length(t) AND len(ix) > 0 AND lost = 0, false) AS fits FROM rng LEFT JOIN full_text USING (payload_id)),
  sp AS (SELECT payload_id, platform, a::int AS span_start, b::int AS span_end, list_sort(list_distinct(ix)) AS ix FROM judged WHERE fits),
  counts AS (SELECT payload_id, {_string('e', 'tool_use_id')} AS tool, item_pos, CASE WHEN json_type(e, '$.content') = 'ARRAY' THEN json_array_length(e, '$.content') WHEN json_type(e, '$.content') = 'OBJECT' THEN 1 END::bigint AS n FROM items WHERE platform = 'anthropic' AND item_type = 'web_search_tool_result'),
  last_count AS (SELECT payload_id, tool, arg_max(n, item_pos) FILTER (n IS NOT NULL) AS n FROM counts GROUP BY 1, 2),
  oq AS (SELECT payload_id, item_pos, e, coalesce({_scalar('e', 'action.type')}, 'search') AS act FROM items WHERE platform = 'openai' AND item_type = 'web_search_call'),
  om AS (SELECT payload_id, item_pos, child_pos, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' END AS q FROM children WHERE path = 'output[].action.queries[]'),
  asked AS (SELECT i.payload_id, 'anthropic' AS platform, item_pos AS x, 0 AS y, {_scalar('e', 'input.query')} AS q, n FROM items i LEFT JOIN last_count c ON c.payload_id = i.payload_id AND c.tool = {_string('e', 'id')} WHERE platform = 'anthropic' AND item_type = 'server_tool_use' AND {_string('e', 'name')} = 'web_search'
    UNION ALL SELECT payload_id, 'openai', item_pos, child_pos, om.q, NULL FROM oq JOIN om USING (payload_id, item_pos) WHERE act = 'search'
    UNION ALL SELECT payload_id, 'openai', item_pos, 0, {_scalar('e', 'action.query')}, NULL FROM oq WHERE act = 'search' AND NOT EXISTS (SELECT 1 FROM om WHERE om.payload_id = oq.payload_id AND om.item_pos = oq.item_pos)
    UNION ALL SELECT payload_id, 'google', child_pos, 0, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' END, NULL FROM children WHERE path = '{_G}webSearchQueries[]' AND item_pos = 0),
  se AS (SELECT payload_id, platform, row_number() OVER (PARTITION BY payload_id ORDER BY x, y) - 1 AS search_no, q AS search_query, n AS results_count FROM asked WHERE q IS NOT NULL)"""

CITATIONS = f"{_CTES} SELECT payload_id, platform, citation_index::int AS citation_index, url, title, cited_text, is_cited, CASE WHEN is_cited THEN citation_index END::int AS cite_position, CASE WHEN {_NETLOC} IN {hosts.REDIRECTORS!r} AND coalesce(regexp_matches(lower(trim(title)), '^[a-z0-9][a-z0-9.-]*\\.[a-z]{{2,}}$'), false) THEN lower(trim(title)) ELSE {_NETLOC} END AS domain FROM ci"
SPANS = f"{_CTES} SELECT payload_id, platform, span_start, span_end, array_to_string(ix, ',') AS citation_indexes FROM sp"
SEARCHES = f"{_CTES} SELECT payload_id, platform, search_no::int AS search_no, search_query, results_count FROM se"

_any = lambda source, where: f"EXISTS (SELECT 1 FROM {source} WHERE {source}.payload_id = r.payload_id AND {where})"
_first = lambda what: f"(SELECT {what} FROM items WHERE items.payload_id = r.payload_id AND item_pos = 0)"
_listed = "item_type = 'text' AND json_type(e, '$.citations') IN ('ARRAY', 'OBJECT')"
_noted = "path = 'output[].content[]' AND item_type = 'message' AND json_exists(e, '$.annotations')"
_grounded = f"coalesce({_first('''json_exists(e, '$.groundingMetadata.groundingSupports')''')}, false)"
_by = lambda a, o, g: f"CASE platform WHEN 'anthropic' THEN {a} WHEN 'openai' THEN {o} ELSE {g} END"

ANSWERS = f"""{_CTES},
  known AS (SELECT * FROM r WHERE json_exists(p, CASE platform WHEN 'anthropic' THEN '$.content' WHEN 'openai' THEN '$.output' ELSE '$.candidates' END)),
  f AS (SELECT payload_id, platform, {_by(_string('p', 'model'), _string('p', 'model'), _string('p', 'modelVersion'))} AS model,
      {_by(_string('p', 'stop_reason'), f"coalesce({_string('p', 'incomplete_details.reason')}, {_string('p', 'status')})", _first(_string('e', 'finishReason')))} AS stop_reason,
      {_by(_any('items', "item_type = 'web_search_tool_result'"), _any('items', "item_type = 'web_search_call'"), _any('gc', 'true'))} AS search_ran,
      {_by(_any('items', _listed), _any('children', _noted), _grounded)} AS spans_recorded,
      {_by(_whole('p', 'usage.input_tokens'), _whole('p', 'usage.input_tokens'), _whole('p', 'usageMetadata.promptTokenCount'))} AS input_tokens,
      {_by(_whole('p', 'usage.output_tokens'), _whole('p', 'usage.output_tokens'), _whole('p', 'usageMetadata.candidatesTokenCount'))} AS output_tokens,
      {_by(_whole('p', 'usage.output_tokens_details.thinking_tokens'), _whole('p', 'usage.output_tokens_details.reasoning_tokens'), _whole('p', 'usageMetadata.thoughtsTokenCount'))} AS reasoning_tokens,
      {_by('NULL', _whole('p', 'usage.total_tokens'), _whole('p', 'usageMetadata.totalTokenCount'))} AS total_tokens,
      {_by(_whole('p', 'usage.server_tool_use.web_search_requests'), _whole('p', 'tool_usage.web_search.num_requests'), 'NULL')} AS search_count,
      CASE WHEN platform = 'anthropic' THEN coalesce((SELECT string_agg(DISTINCT coalesce({_string('e', 'caller.type')}, 'unknown'), ',' ORDER BY coalesce({_string('e', 'caller.type')}, 'unknown')) FROM items WHERE items.payload_id = r.payload_id AND item_type = 'web_search_tool_result'), '') END AS callers
    FROM known r)
  SELECT payload_id, platform, length(coalesce(t, ''))::int AS n_chars, model, stop_reason, search_ran, CASE platform WHEN 'google' THEN spans_recorded ELSE search_ran AND spans_recorded END AS cited_sources_available, CASE platform WHEN 'openai' THEN false ELSE search_ran END AS retrieved_set_available, input_tokens, output_tokens, reasoning_tokens, total_tokens, search_count, callers, spans_recorded,
    CASE WHEN spans_recorded THEN (SELECT count(*) FROM judged WHERE judged.payload_id = f.payload_id AND NOT fits) ELSE 0 END AS spans_dropped,
    (SELECT count(*) FROM ci WHERE ci.payload_id = f.payload_id) AS n_sources, (SELECT count(*) FROM sp WHERE sp.payload_id = f.payload_id) AS n_spans, (SELECT count(*) FROM se WHERE se.payload_id = f.payload_id) AS n_searches
  FROM f LEFT JOIN full_text USING (payload_id)"""

RECORDS = f"""SELECT payload_id, 'answer-2' AS schema, run_id, engine, query_index, repeat_no, coalesce(f.model, model_requested) AS model, f.model IS NOT NULL AS model_reported_by_platform, f.stop_reason, prompt_set_version, n_sources AS n_citations, CASE WHEN spans_recorded THEN n_spans END AS n_spans, output_tokens, 'kept' AS raw_status, sha256(payload) AS raw_sha256, octet_length(encode(payload)) AS raw_bytes
  FROM ({ANSWERS}) f JOIN (SELECT DISTINCT ON (payload_id) payload_id, answer_id, payload FROM raw_payloads) USING (payload_id) JOIN ({{_A}}) a USING (answer_id)"""

STORED = f"""SELECT run_id, engine, count(*) AS records, sum(n_chars)::bigint AS n_chars, sum(n_sources)::bigint AS citations, count(*) FILTER (spans_recorded) AS with_spans, sum(octet_length(encode(payload)))::bigint AS raw_bytes, min(query_text) AS first_question
  FROM ({ANSWERS}) f JOIN (SELECT DISTINCT ON (payload_id) payload_id, answer_id, payload FROM raw_payloads) USING (payload_id) JOIN ({{_A}}) a USING (answer_id) GROUP BY 1, 2"""

VERIFIED = f"{_CTES}, known AS (SELECT * FROM r WHERE json_exists(p, '$.content') OR json_exists(p, '$.output') OR json_exists(p, '$.candidates')) SELECT platform, max(length(coalesce(t, '')) > 0 AND EXISTS (SELECT 1 FROM ci WHERE ci.payload_id = known.payload_id AND is_cited)) AS is_verified FROM known LEFT JOIN full_text USING (payload_id) GROUP BY 1"
