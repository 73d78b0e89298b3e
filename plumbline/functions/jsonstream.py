"""JSON as a stream of events, at any depth: a stack of open containers in place of recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_blank = re.compile(r"[ \t\n\r]*").match
_plain = re.compile(r"(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|NaN|-?Infinity)|(?P<boolean>true|false)|(?P<null>null)").match
_CLOSES = {"{": "}", "[": "]"}


def events(text: str, pos: int = 0) -> Iterator[tuple[str, str | None, int]]:
    """(event, value, position): '{', '}', '[', ']', 'key', 'string', 'number', 'boolean' or 'null' of the JSON value at ``pos``.

    The position is where a container begins, and where anything else ends. Numbers and truth values come as written.
    ValueError where the text is no JSON, or goes on after its value; from a ``pos`` other than 0, what follows the
    value is not looked at.
    """
    opened: list[str] = []
    whole = pos == 0

    def name(pos: int) -> tuple[str, int]:
        if text[pos : pos + 1] != '"':
            raise ValueError(f"no key at {pos}")
        key, pos = scanstring(text, pos + 1)
        pos = _blank(text, pos).end()
        if text[pos : pos + 1] != ":":
            raise ValueError(f"no colon at {pos}")
        return key, _blank(text, pos + 1).end()

    pos = _blank(text, pos).end()
    while True:
        c = text[pos : pos + 1]
        if c == '"':
            value, pos = scanstring(text, pos + 1)
            yield "string", value, pos
        elif c in _CLOSES:
            yield c, None, pos
            opened.append(c)
            pos = _blank(text, pos + 1).end()
            if text[pos : pos + 1] != _CLOSES[c]:
                if c == "{":
                    key, pos = name(pos)
                    yield "key", key, pos
                continue
        else:
            m = _plain(text, pos)
            if m is None:
                raise ValueError(f"no value at {pos}")
            pos = m.end()
            yield m.lastgroup, m[0], pos
        while opened:
            pos = _blank(text, pos).end()
            c = text[pos : pos + 1]
            if c == ",":
                pos = _blank(text, pos + 1).end()
                if opened[-1] == "{":
                    key, pos = name(pos)
                    yield "key", key, pos
                break
            if c != _CLOSES[opened[-1]]:
                raise ValueError(f"neither comma nor end at {pos}")
            pos += 1
            opened.pop()
            yield c, None, pos
        else:
            if whole and _blank(text, pos).end() != len(text):
                raise ValueError(f"more than one value at {pos}")
            return


_PLAIN_VALUES = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str) -> object:
    """As json.loads, at any depth. The last one of repeated keys counts."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]
    key = None
    for event, value, _ in events(text):
        if event == "key":
            key = value
            continue
        if event in "}]":
            stack.pop()
            continue
        new = {} if event == "{" else [] if event == "[" else value if event == "string" else _PLAIN_VALUES[value] if value in _PLAIN_VALUES else int(value) if value.lstrip("-").isdigit() else float(value)
        into = stack[-1][0]
        if isinstance(into, dict):
            into[key] = new
        else:
            into.append(new)
        if event in _CLOSES:
            stack.append((new, key))
    return root[0]


def dumps(value: object) -> str:
    """As json.dumps with letters as they are, at any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[object] = [value]
    raw = type("Raw", (str,), {})
    while stack:
        v = stack.pop()
        if isinstance(v, raw):
            out.append(v)
        elif isinstance(v, dict):
            parts: list[object] = [raw("{")]
            for i, (k, x) in enumerate(v.items()):
                parts += [raw(", " * (i > 0) + json.dumps(k, ensure_ascii=False) + ": "), x]
            stack += reversed([*parts, raw("}")])
        elif isinstance(v, list):
            parts = [raw("[")]
            for i, x in enumerate(v):
                parts += [*([raw(", ")] if i else []), x]
            stack += reversed([*parts, raw("]")])
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)
