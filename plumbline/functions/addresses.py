"""Which addresses a guarded fetch may reach."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("unspecified", "loopback", "link_local", "multicast", "reserved", "private")


def kind(address: str | None) -> str | None:
    """'public', or why not; 'invalid' for what is no address. An IPv4 address inside an IPv6 one is judged as itself."""
    if address is None:
        return None
    try:
        a = ipaddress.ip_address(address.strip())
    except ValueError:
        return "invalid"
    a = getattr(a, "ipv4_mapped", None) or a
    for k in KINDS:
        if getattr(a, f"is_{k}"):
            return k
    return "public" if a.is_global else "not_global"


def _kinds(addresses: pd.Series) -> pd.Series:
    return addresses.map(kind)


def address_kind(address: Column | str) -> Column:
    return F.pandas_udf(_kinds, T.StringType())(address)
