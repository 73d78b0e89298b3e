"""Hosts of urls: who is cited, and whether a site is owned."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: where a search platform's links lead first, before they lead to the page
REDIRECTORS = ("vertexaisearch.cloud.google.com", "redirect.grounding.example")
SOCIAL = ("x.com", "twitter.com")


def netloc(url: Column) -> Column:
    """What stands between // and the path, in small letters; user and port belong to it."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def looks_like_host(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$")


def is_redirector(url: Column, redirectors: Iterable[str] = REDIRECTORS) -> Column:
    return netloc(url).isin(list(redirectors))


def resolve_domain(url: Column, title: Column, redirectors: Iterable[str] = REDIRECTORS) -> Column:
    """The title of a redirecting link, if it is a host's name; else the link's own host."""
    return F.when(is_redirector(url, redirectors) & F.coalesce(looks_like_host(title), F.lit(False)), F.lower(F.trim(title))).otherwise(netloc(url))


def citation_host(domain: Column, url: Column, title: Column) -> Column:
    stored = F.when(domain != "", domain)
    return strip_www(F.coalesce(stored, resolve_domain(url, title)))


def is_owned(domain: Column, owned: Iterable[str]) -> Column:
    """The host itself or one below it: a suffix without a dot before it is another site."""
    host = strip_www(domain)
    out = F.lit(False)
    for o in owned:
        out = out | (host == o) | host.endswith("." + o)
    return F.coalesce(out, F.lit(False))


def bare_host(text: Column) -> Column:
    """A configured site as a bare host: no scheme, path, port or www."""
    host = F.regexp_replace(F.lower(F.trim(text)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.nullif(strip_www(F.regexp_replace(F.regexp_replace(host, r"[/?#].*$", ""), r":\d*$", "")), F.lit(""))


def corpus(host: Column) -> Column:
    return F.when(strip_www(host).isin(list(SOCIAL)), "x").otherwise("web")


def source_type(host: Column) -> Column:
    return F.when(strip_www(host).isin(list(SOCIAL)), "social_post").otherwise("web")


def fetch_status(http_status: Column) -> Column:
    """Outcome of a fetch by its status code; null for no answer."""
    return (
        F.when(http_status.isin(401, 403), "auth_required").when(http_status == 402, "paywalled").when(http_status.isin(404, 410), "gone")
        .when((http_status >= 200) & (http_status < 300), "ok").when(http_status.isNotNull(), "http_error")
    )


def slug(name: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(name), r"(?U)[^\w]+", "-"), F.lit("-"))
    return F.when(s == "", "brand").otherwise(s)
