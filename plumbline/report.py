"""The report of a run: collected small tables, as JSON, Markdown and HTML.

Everything that grows with the answers is aggregated by Spark; only engines, competitors and the evidence rows that are
asked for reach the driver. The report is a function of the tables alone: no clock, no order of arrival.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions import stats
from plumbline.operators import evidence, quotes, rates

MOST_EVIDENCE = 10_000  # rows of the printed appendix; the table itself is whole
WORDS = {"no_data": "no answers", "not_observable": "not observable", "not_measured": "not measured", "not_checkable": "could not be checked", "not_checked": "not checked", "no_citations": "no citations", "low_sample": "low sample", "ok": "ok"}


def _metric(row, prefix: str) -> dict:
    return {k: row[f"{prefix}_{k}"] for k in ("count", "n", "rate", "low", "high", "status")}


def build(config: Config, answers: DataFrame, citations: DataFrame, pages: DataFrame) -> tuple[dict, DataFrame]:
    """(the report, the whole table of evidence rows)"""
    entities = list(config.entities)
    rivals = entities[1:]
    rows = rates.analysed(answers, entities, config.recommendation, citations, config.owned)
    per_engine = rates.engine_metrics(rows, recommendation=bool(config.recommending()), owned=bool(config.owned))
    checked = quotes.checked(citations, pages)
    faith = {r["engine"]: r.asDict() for r in quotes.summary(checked).collect()}
    by_engine = {r["engine"]: r for r in per_engine.collect()}
    competitors: dict[str, dict] = {}
    if rivals:
        for r in rates.competitor_metrics(rows, rivals).collect():
            competitors.setdefault(r["engine"], {})[r["competitor"]] = _metric(r, "mention")
    texts = {r["engine"]: r.asDict() for r in per_engine.select("engine", *[stats.metric_text(F.col(f"{p}_count"), F.col(f"{p}_n"), F.col(f"{p}_status")).alias(p) for p in ("mention", "named_in_rec", "owned_cited")]).collect()}
    sections = []
    for name in [*config.engines, *sorted(set(by_engine) - set(config.engines))]:  # in order of the config
        r = by_engine.get(name)
        sections.append({"engine": name, "metrics": {p: _metric(r, p) for p in ("mention", "named_in_rec", "owned_cited")} if r else None, "texts": texts.get(name), "competitors": competitors.get(name, {}), "faithfulness": faith.get(name)})
    across = rates.across(per_engine, "mention").first().asDict()
    report = {"schema": "report-1", "brand": config.brand.name, "prompt_set": {"version": config.version, "hash": config.prompt_set_hash()}, "engines": sections, "across": across, "warnings": config.warnings()}
    return report, evidence.evidence_rows(answers, citations, checked)


def words(status: str) -> str:
    return WORDS.get(status, status.replace("_", " "))


_ESCAPED = str.maketrans({c: "\\" + c for c in "<>[]*`|"} | {"\n": " "})


def _cell(value: object) -> str:
    return "" if value is None else str(value).translate(_ESCAPED)


def _faith(f: dict | None) -> str:
    if not f:
        return words("no_citations")
    return f"{f['found']} of {f['checked']} found" if f["status"] == "ok" else words(f["status"])


def _table(report: dict) -> list[list[str]]:
    head = ["Engine", "Named", "Named in recommendations", "Owned site cited", "Quotes found", *sorted({c for s in report["engines"] for c in s["competitors"]})]
    rows = []
    for s in report["engines"]:
        t = s["texts"] or {}
        rival = lambda c, s=s: "" if c not in s["competitors"] else f"{s['competitors'][c]['count']} of {s['competitors'][c]['n']}"
        rows.append([s["engine"], *[t.get(p) or words("no_data") for p in ("mention", "named_in_rec", "owned_cited")], _faith(s["faithfulness"]), *map(rival, head[5:])])
    return [head, *rows]


def markdown(report: dict, rows: list[dict] = ()) -> str:
    head, *body = _table(report)
    line = lambda cells: "| " + " | ".join(map(_cell, cells)) + " |"
    out = [f"# {_cell(report['brand'])}", "", line(head), "|" + "---|" * len(head), *map(line, body), "", f"Named in {report['across']['count']} of {report['across']['n']} answers of all engines (a count, no rate).", ""]
    out += [f"* {_cell(w)}" for w in report["warnings"]]
    if rows:
        keys = list(rows[0])
        out += ["", "## Evidence", "", line(keys), "|" + "---|" * len(keys), *(line(r[k] for k in keys) for r in rows)]
    return "\n".join(out) + "\n"


def page(report: dict, rows: list[dict] = ()) -> str:
    """HTML without scripts; every value is escaped."""
    e = lambda v: html.escape("" if v is None else str(v))
    tr = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{e(c)}</{tag}>" for c in cells) + "</tr>"
    head, *body = _table(report)
    parts = [f"<!doctype html><meta charset=utf-8><title>{e(report['brand'])}</title><h1>{e(report['brand'])}</h1><table>", tr(head, "th"), *map(tr, body), "</table>"]
    if rows:
        keys = list(rows[0])
        parts += ["<h2>Evidence</h2><table>", tr(keys, "th"), *(f'<tr id="{e(r["row_id"])}">' + tr(r[k] for k in keys).removeprefix("<tr>") for r in rows), "</table>"]
    return "".join(parts) + "\n"


def write(report: dict, table: DataFrame, path: str | Path, most: int = MOST_EVIDENCE) -> None:
    """report.json, .md and .html, and the whole evidence as Parquet beside them."""
    path = Path(path)
    path.mkdir(parents=True, exist_ok=True)
    table.write.mode("overwrite").parquet(str(path / "evidence.parquet"))
    first = [r.asDict() for r in table.orderBy("row_id", "answer_id").limit(most).collect()]
    for name, text in (("report.json", json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False) + "\n"), ("report.md", markdown(report, first)), ("report.html", page(report, first))):
        draft = path / f".{name}.tmp"
        draft.write_text(text, encoding="utf-8")
        draft.replace(path / name)  # whole or not at all
