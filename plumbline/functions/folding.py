"""Compatibility folding with a way back to the raw text.

Spark has neither NFKC nor full case folding, so texts that aren't plain ASCII go through an Arrow function; ASCII
ones are only put in small letters, which keeps every offset.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(text: str) -> str:
    return fold_with_origin(text)[0]


def fold_with_origin(text: str) -> tuple[str, list[int], list[int]]:
    """The folded text, and for each of its characters the raw range it came from: a base with its marks is one range."""
    if text.isascii():
        at = list(range(len(text)))
        return text.lower(), at, [i + 1 for i in at]
    out: list[str] = []
    begin: list[int] = []
    finish: list[int] = []
    n, a = len(text), 0
    while a < n:
        b = a + 1
        while b < n and unicodedata.combining(text[b]):
            b += 1
        form = unicodedata.normalize("NFKC", text[a:b]).casefold()
        out.append(form)
        begin += [a] * len(form)
        finish += [b] * len(form)
        a = b
    return "".join(out), begin, finish


def occurrences(text: str, needles: Iterable[tuple[int, str]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, number of the needle) of every occurrence, overlapping ones too, as raw offsets.

    ``needles`` are folded already. An occurrence that starts or ends inside one raw character isn't one.
    """
    folded, begin, finish = fold_with_origin(text)
    for number, needle in needles:
        at = folded.find(needle) if needle else -1
        while at >= 0:
            to = at + len(needle)
            if (at == 0 or begin[at] != begin[at - 1]) and (to == len(folded) or begin[to] != begin[to - 1]):
                yield begin[at], finish[to - 1], number
            at = folded.find(needle, at + 1)


def _folds(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def foreign(text: Column | str) -> Column:
    """Whether anything but ASCII is in the text: only then folding is more than small letters."""
    return (F.col(text) if isinstance(text, str) else text).rlike("[^\\x00-\\x7F]")


def folded(text: Column | str) -> Column:
    """The folded text; plain ASCII never leaves the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.pandas_udf(_folds, T.StringType())(F.when(foreign(text), text)), F.lower(text))
