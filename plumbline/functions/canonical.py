"""JSON in one form: keys sorted at every depth, so equal payloads hash alike."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_keys(text: str | None) -> str | None:
    """None for what is no JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def _all(texts: pd.Series) -> pd.Series:
    return texts.map(sorted_keys)


def canonical_json(payload: Column | str) -> Column:
    return F.pandas_udf(_all, T.StringType())(payload)
