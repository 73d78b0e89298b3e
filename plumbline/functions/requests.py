"""Request documents of the platforms, as JSON columns: the question as it stands, one turn, no instruction beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_TOKENS = 4096
# How each platform names its search.
ANTHROPIC_SEARCH = '[{"type":"web_search_20260209","name":"web_search","allowed_callers":["direct"]}]'
OPENAI_SEARCH = '[{"type":"web_search"}]'
GOOGLE_SEARCH = '[{"google_search":{}}]'
XAI_SEARCH = '{"mode":"on","return_citations":true,"sources":[{"type":"web"},{"type":"x"}]}'


def _object(**fields: Column) -> Column:
    """JSON of fields that are JSON already."""
    parts = [F.concat(F.lit(f'"{n}":'), c) for n, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _text(c: Column) -> Column:
    """A string as JSON: what stands behind the key of an object."""
    j = F.to_json(F.struct(c.alias("s")))
    return F.substr(j, F.lit(6), F.length(j) - 6)


def _turn(question: Column, key: str = "content") -> Column:
    return F.concat(F.lit("["), _object(role=F.lit('"user"'), **{key: _text(question)}), F.lit("]"))


BODIES: dict[str, Callable[[Column, Column, bool], Column]] = {
    "anthropic": lambda m, q, s: _object(model=_text(m), max_tokens=F.lit(str(MOST_TOKENS)), tools=F.lit(ANTHROPIC_SEARCH if s else "[]"), messages=_turn(q)),
    "openai": lambda m, q, s: _object(model=_text(m), tools=F.lit(OPENAI_SEARCH if s else "[]"), input=_turn(q)),
    "google": lambda m, q, s: _object(contents=F.concat(F.lit('[{"role":"user","parts":['), _object(text=_text(q)), F.lit("]}]")), **({"tools": F.lit(GOOGLE_SEARCH)} if s else {})),
    "xai": lambda m, q, s: _object(model=_text(m), messages=_turn(q), **({"search_parameters": F.lit(XAI_SEARCH)} if s else {})),
    "perplexity": lambda m, q, s: _object(model=_text(m), messages=_turn(q)),
}


def request_body(platform: Column, model: Column, question: Column, search: bool = True) -> Column:
    """The document to send; null for a platform without one."""
    out = F.lit(None).cast("string")
    for name, make in BODIES.items():
        out = F.when(platform == name, make(model, question, search)).otherwise(out)
    return out
