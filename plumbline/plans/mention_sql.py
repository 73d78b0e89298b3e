"""SQL of the mention queries: every occurrence of every alias with its raw offsets, then the two sweeps, then sentences.

A text is cut into clusters (a base with its marks), each folded on its own, so that a place in the folded text leads
back to the raw one.
"""

from __future__ import annotations

from collections.abc import Callable

from plumbline.operators.mentions import ABBREVIATIONS, Entity


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sweep(l: str) -> str:
    """Of a sorted list of ranges, those that begin at or after the end of the last one kept."""
    return f"list_reduce(list_transform({l}, lambda x: [x]), lambda kept, x: CASE WHEN x[1].s >= kept[len(kept)].e THEN list_concat(kept, x) ELSE kept END)"


def spans(answers: str, entities: list[Entity], folded: Callable[[str], str]) -> str:
    """CTEs up to ``named``: answer_id, s, e, i (the entity's number) of every resolved span."""
    needles = ", ".join(f"({i}, {_quote(n)})" for i, e in enumerate(entities) for n in e.needles())
    ordered = "list({'s': s, 'minus': s - e, 'i': i, 'e': e} ORDER BY s, s - e, i)"
    return f"""WITH txt AS (SELECT answer_id, answer_text AS t FROM ({answers}) WHERE coalesce(answer_text, '') <> ''), needle(i, n) AS (VALUES {needles}),
  maybe AS (SELECT DISTINCT answer_id FROM txt JOIN needle ON contains({folded('t')}, n)),
  cl AS (SELECT answer_id, unnest(c) AS c, generate_subscripts(c, 1) AS no FROM (SELECT answer_id, regexp_extract_all(t, '(?s).\\p{{M}}*') AS c FROM txt JOIN maybe USING (answer_id))),
  fo AS (SELECT answer_id, no, length(c) AS nc, {folded('c')} AS f FROM cl),
  pl AS (SELECT answer_id, (coalesce(sum(nc) OVER w, 0))::bigint AS raw, (coalesce(sum(length(f)) OVER w, 0))::bigint AS fat FROM fo WINDOW w AS (PARTITION BY answer_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ft AS (SELECT answer_id, string_agg(f, '' ORDER BY no) AS f, sum(nc)::bigint AS n, sum(length(f))::bigint AS m FROM fo GROUP BY 1),
  ends AS (SELECT answer_id, raw, fat FROM pl UNION ALL SELECT answer_id, n, m FROM ft),
  hit AS (SELECT ft.answer_id, i, n.n, p.raw AS s, p.fat + length(n.n) AS to_at FROM ft JOIN needle n ON contains(f, n.n) JOIN pl p ON p.answer_id = ft.answer_id AND substr(f, p.fat + 1, length(n.n)) = n.n),
  occ AS (SELECT DISTINCT hit.answer_id, i, s, ends.raw AS e FROM hit JOIN ends ON ends.answer_id = hit.answer_id AND ends.fat = to_at),
  own AS (SELECT answer_id, i, {_sweep(ordered)} AS kept FROM occ GROUP BY 1, 2),
  flat AS (SELECT answer_id, x.s AS s, x.e AS e, x.i AS i FROM (SELECT answer_id, unnest(kept) AS x FROM own)),
  swept AS (SELECT answer_id, {_sweep(ordered)} AS kept FROM flat GROUP BY 1),
  named AS (SELECT answer_id, x.s AS s, x.e AS e, x.i AS i FROM (SELECT answer_id, unnest(kept) AS x FROM swept))"""


def mentions(answers: str, entities: list[Entity], folded: Callable[[str], str]) -> str:
    info = ", ".join(f"({i}, {_quote(e.name)}, {_quote(e.role)})" for i, e in enumerate(entities))
    return f"""{spans(answers, entities, folded)}, info(i, entity, entity_role) AS (VALUES {info}), g AS (SELECT answer_id, i, min({{'s': s, 'e': e}}) AS first, count(*) AS n_spans FROM named GROUP BY 1, 2)
  SELECT answer_id, entity, entity_role, first.s AS char_start, first.e AS char_end, n_spans, row_number() OVER (PARTITION BY answer_id ORDER BY first, i) AS entity_rank FROM g JOIN info USING (i)"""


def sentences(answers: str, entities: list[Entity], folded: Callable[[str], str], blanks: str) -> str:
    """The sentence around the first span of the brand (entity 0), the brand's spans in it, and the pieces they cut it into. ``blanks``: a class of characters."""
    short = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    marked = f"regexp_replace(t, '(?i)(^|[^A-Za-z.])({short})\\.', '\\1\\2' || chr(29), 'g')"  # their full stops end nothing
    marked = f"regexp_replace({marked}, '([.!?])({blanks}+)([A-Z0-9\"“''‘(\\[*-])', '\\1\\2' || chr(30) || '\\3', 'g')"
    marked = f"regexp_replace({marked}, '([。！？]+|\\n+)', '\\1' || chr(30), 'g')"
    return f"""{spans(answers, entities, folded)}, brand AS (SELECT answer_id, min(s) AS first FROM named WHERE i = 0 GROUP BY 1),
  pc AS (SELECT answer_id, replace(p, chr(29), '.') AS p, no FROM (SELECT answer_id, unnest(l) AS p, generate_subscripts(l, 1) AS no FROM (SELECT answer_id, string_split({marked}, chr(30)) AS l FROM txt JOIN brand USING (answer_id)))),
  pp AS (SELECT answer_id, p, coalesce(sum(length(p)) OVER (PARTITION BY answer_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS a FROM pc),
  se AS (SELECT answer_id, a + length(p) - length(regexp_replace(p, '^{blanks}+', '')) AS a, regexp_replace(p, '^{blanks}+|{blanks}+$', '', 'g') AS sentence FROM pp JOIN brand USING (answer_id) WHERE first >= a AND first < a + length(p)),
  hi AS (SELECT answer_id, sentence, s - a AS s, e - a AS e, length(sentence) AS n FROM se JOIN named USING (answer_id) WHERE i = 0 AND s >= a AND e <= a + length(sentence)),
  ga AS (SELECT *, s > coalesce(lag(e) OVER (PARTITION BY answer_id ORDER BY s, e), 0) AS before FROM hi)
  SELECT answer_id, any_value(sentence) AS sentence, count(*) AS n_highlights, count(*) + count(*) FILTER (before) + max((e < n)::int) FILTER (e = last) AS n_segments FROM (SELECT *, max(e) OVER (PARTITION BY answer_id) AS last FROM ga) GROUP BY 1"""
