"""Which urls a site's robots.txt lets be read. Rules are parsed once for each site and batch."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERVER_ERROR = 500  # from here on a site is taken to forbid everything; another status than 200 means no rules


@lru_cache(maxsize=256)
def _rules(body: str) -> RobotFileParser:
    p = RobotFileParser()
    p.parse(body.splitlines())
    return p


def allows(url: str | None, status: int | None, body: str | None, agent: str) -> bool | None:
    """None for no url; a site that could not be reached (no status) has no rules."""
    if url is None:
        return None
    if status is not None and not pd.isna(status) and status >= SERVER_ERROR:
        return False
    if status != 200 or body is None:
        return True
    return _rules(body).can_fetch(agent, url)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def allowed(urls: DataFrame, sites: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with may_fetch. sites: origin, http_status, body of its robots.txt, one row for each."""
    check = F.pandas_udf(lambda u, s, b: pd.Series([allows(*x, agent) for x in zip(u, s, b, strict=True)], dtype=object), T.BooleanType())
    rows = urls.withColumn("_origin", origin(F.col(url))).join(sites.toDF("_origin", "_status", "_body"), "_origin", "left")
    return rows.withColumn("may_fetch", check(F.col(url), F.col("_status"), F.col("_body"))).drop("_origin", "_status", "_body")
