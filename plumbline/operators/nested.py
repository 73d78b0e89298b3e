"""Deeply nested semi-structured records to related flat tables.

Method: each record is read as a stream of events and turned into path-value-ordinal triples: the path with ``[]``
where an array is entered, the ordinals of the arrays on the way, and the value. Paths are grouped by their nearest
repeated ancestor, and each group is pivoted into one table, keyed by the record's id and the ordinals; a child's key
begins with its parent's, which is the link between them.

Optional and irregular parts: a single object where an array is usual is an array of one (``repeated`` names those
paths; ``infer_repeated`` finds them); null, absent and empty arrays give nothing; a record inside strings, enclosing
objects or arrays (``anchors``: keys that only the record itself has) is found first, the nearest one, under any number
of layers; records that are null, not JSON or incomplete give no triples and are counted by ``statuses``. An element of
an array gives a triple of its own kind even if it is empty, so no element is lost. Repeated keys: the last one counts,
as in JSON parsers. What lies deeper than ``MOST_DEPTH`` containers is one triple with its JSON text as value, so that
paths and ordinals stay short and nothing is lost.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.jsonstream import events
from plumbline.operators.lineage import collect_bounded

TRIPLES = "path string, ordinals array<int>, kind string, value string"
MOST_DEPTH = 64
_JSON_INSIDE = re.compile(r'\s*[{\["]').match
READ, NULL, BROKEN, NO_RECORD = "read", "null", "broken", "no_record"


def kind_of(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def locate(text: str, anchors: frozenset[str]) -> tuple[str, int] | None:
    """The text and the position of the record: the object with one of the anchor keys under the fewest layers (strings, objects, arrays), the first of these. ValueError if the outer text is no JSON."""
    best: tuple[int, str, int] | None = None
    todo = [(0, 0, text)]
    seen = 0
    while todo and (best is None or todo[0][0] < best[0]):
        base, number, t = heapq.heappop(todo)
        opened: list[int] = []
        found, inner = best, []
        try:
            for event, value, pos in events(t):
                if event in "{[":
                    opened.append(pos)
                elif event in "}]":
                    opened.pop()
                elif event == "key":
                    if value in anchors and (found is None or base + len(opened) - 1 < found[0]):
                        found = (base + len(opened) - 1, t, opened[-1])
                elif event == "string" and _JSON_INSIDE(value):
                    inner.append((base + len(opened) + 1, value))
        except ValueError:
            if number == 0:
                raise
            continue
        best = found
        for depth, value in inner:
            seen += 1
            heapq.heappush(todo, (depth, seen, value))
    return None if best is None else best[1:]


def triples(text: str, pos: int = 0, repeated: frozenset[str] = frozenset(), wanted: frozenset[str] | None = None, most_depth: int = MOST_DEPTH, empties: bool = False) -> tuple[list[tuple], set[str]]:
    """((path, ordinals, kind, value) of every element and leaf of the JSON value at ``pos``; its own keys).

    ``wanted``: only these paths; what is on the way to none of them is read over. ``empties``: an empty array or object
    is a leaf of its own, so that one can tell it from an absent one.
    """
    way = None if wanted is None else {p[:i] for p in wanted for i in (0, *(m.start() for m in re.finditer(r"\.|\[\]", p)), len(p))}
    out: list[tuple | None] = []
    frames: list[list] = []  # of open containers: path, ordinals, key or next index, where the key's triples begin, its keys' triples, muted, whether it is too deep, where it begins
    root_keys: set[str] = set()

    def emit(path: str, at: tuple, kind: str, value: str | None) -> None:
        if path and (wanted is None or path in wanted):
            out.append((path, at, kind, value))

    for event, value, end in events(text, pos):
        f = frames[-1] if frames else None
        if event == "key":
            if len(frames) == 1:
                root_keys.add(value)
            if f[5]:
                continue
            if f[2] is not None:
                f[4][f[2]] = (f[3], len(out))
            if value in f[4]:  # it came before: what it gave goes
                a, b = f[4][value]
                out[a:b] = [None] * (b - a)
            f[2], f[3] = value, len(out)
            continue
        if event in "}]":
            frames.pop()
            if f[6] is not None or empties and not f[5] and not (f[2] if f[4] is None else f[4] or f[2] is not None):
                emit(f[0], f[1], "object" if event == "}" else "array", text[f[7] : end])
            continue
        muted = f is not None and f[5]
        path, at = "", ()
        if f is not None and not muted:
            path, at = f[0], f[1]
            if f[4] is None:
                path, at = path + "[]", (*at, f[2])
                f[2] += 1
                emit(path, at, "element", None)
            else:
                path = f"{path}.{f[2]}" if path else f[2]
        if event not in "{[":
            if not muted:
                emit(path, at, event, None if event == "null" else value)
            continue
        raw = None
        if not muted:
            if event == "{" and path in repeated:
                path, at = path + "[]", (*at, 0)
                emit(path, at, "element", None)
            if len(frames) >= most_depth:
                muted, raw = True, True
            elif way is not None and path not in way:
                muted = True
        frames.append([path, at, 0, 0, None, muted, raw, end] if event == "[" else [path, at, None, 0, {}, muted, raw, end])
    return [t for t in out if t is not None], root_keys


def read(text: str | None, anchors: frozenset[str], repeated: frozenset[str], wanted: frozenset[str] | None = None, empties: bool = False) -> tuple[str, list[tuple]]:
    """(status, triples of the record)"""
    if text is None:
        return NULL, []
    try:
        found, keys = triples(text, 0, repeated, wanted, empties=empties)
        if not anchors or not anchors.isdisjoint(keys):
            return READ, found
        place = locate(text, anchors)
        return (NO_RECORD, []) if place is None else (READ, triples(*place, repeated, wanted, empties=empties)[0])
    except ValueError:
        return BROKEN, []


def explode_triples(df: DataFrame, key: str, payload: str, repeated: Iterable[str] = (), anchors: Iterable[str] = (), platform: str | None = None, wanted: Iterable[str] | None = None, empties: bool = False) -> DataFrame:
    """key (and platform), path, ordinals, kind, value; of ``wanted`` paths only, if they are given. ``empties``: see ``triples``."""
    rep, anc, want = frozenset(repeated), frozenset(anchors), None if wanted is None else frozenset(wanted)
    names = [key, *([platform] if platform else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, out = [], ([], [], [], [])
            for r, text in enumerate(b.column("_payload").to_pylist()):
                for t in read(text, anc, rep, want, empties)[1]:
                    take.append(r)
                    for c, x in zip(out, t):
                        c.append(x)
            at = pa.array(take, pa.int64())
            kinds = (pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(n).take(at) for n in names], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[*names, "path", "ordinals", "kind", "value"])

    slim = df.select(*names, F.col(payload).alias("_payload")).where(F.col("_payload").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*names).schema) + ", " + TRIPLES
    return slim.mapInArrow(run, schema)


def statuses(df: DataFrame, payload: str, anchors: Iterable[str], *keep: str) -> DataFrame:
    """The kept columns and record_status of each row: read, null, broken (no JSON, or incomplete) or no_record (JSON without one)."""
    anc = frozenset(anchors)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(t, anc, frozenset(), frozenset())[0] for t in b.column("_payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(got, pa.string())], names=[*names, "record_status"])

    slim = df.select(*names, F.col(payload).alias("_payload"))
    return slim.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.select(*names).schema) + "record_status string")


def infer_repeated(t: DataFrame, most: int = 10_000) -> set[str]:
    """Paths that are an array in any record. Bounded: more than ``most`` differing paths mean that keys are data."""
    rows = collect_bounded(t.where(F.col("path").endswith("[]")).select("path").distinct(), most, "repeated paths: keys are data here")
    return {r[0].removesuffix("[]") for r in rows}


def ancestor(path: Column) -> Column:
    """The nearest repeated ancestor: the path up to its last []."""
    return F.regexp_extract(path, r"^(.*\[\])?", 0)


def elements(t: DataFrame, keys: Iterable[str], *columns: Column) -> DataFrame:
    """keys, group, ordinals and ``columns``: the rows of every repeated ancestor's table at once, pivoted by the columns (aggregates of path and value). All rows of a record are in one partition."""
    keys = list(keys)
    return t.repartition(keys[0]).groupBy(*keys, ancestor(F.col("path")).alias("group"), "ordinals").agg(*columns)


def group_table(t: DataFrame, key: str, group: str, fields: dict[str, str]) -> DataFrame:
    """The table of one repeated ancestor: key, ordinals (the last is the row's own, the ones before it the parent's), one column for each of ``fields`` (name: path below the ancestor)."""
    mine = t.where(ancestor(F.col("path")) == group)
    pivot = [F.max(F.when(F.col("path") == (f"{group}.{p}" if group and p else group or p), F.col("value"))).alias(n) for n, p in fields.items()]
    return mine.groupBy(key, "ordinals").agg(*pivot) if pivot else mine.select(key, "ordinals").distinct()


def tables(t: DataFrame, key: str, most: int = 10_000) -> dict[str, DataFrame]:
    """Every group's table, by ancestor ('' is the record itself). Columns are the paths below the ancestor with dots as underscores."""
    paths = [r[0] for r in collect_bounded(t.where("kind <> 'element'").select("path").distinct(), most, "paths: keys are data here")]
    groups: dict[str, dict[str, str]] = {r[0]: {} for r in collect_bounded(t.where("kind = 'element'").select("path").distinct(), most, "repeated paths: keys are data here")}
    for p in sorted(paths):
        g = p[: p.rindex("[]") + 2] if "[]" in p else ""
        inner = p[len(g) :].lstrip(".")
        name = inner.replace(".", "_") or "value"
        taken = {n.lower() for n in groups.setdefault(g, {})} | {key.lower(), "ordinals"}
        while name.lower() in taken:
            name += "_"
        groups[g][name] = inner
    return {g: group_table(t, key, g, f) for g, f in groups.items()}


# --- answer payloads: items, children and leaves ---

ITEMS = {"anthropic": "content", "openai": "output", "google": "candidates"}
ITEM_TYPE = {"content[].type": "anthropic", "output[].type": "openai", "candidates[].finishReason": "google"}
#: (platform, path of the array, name of the children)
CHILDREN = [
    ("anthropic", "content[].citations[]", "citations"), ("anthropic", "content[].content[]", "content"),
    ("openai", "output[].content[]", "content"), ("openai", "output[].action.queries[]", "queries"),
    ("google", "candidates[].content.parts[]", "parts"), ("google", "candidates[].groundingMetadata.groundingChunks[]", "groundingChunks"),
    ("google", "candidates[].groundingMetadata.groundingSupports[]", "groundingSupports"), ("google", "candidates[].groundingMetadata.webSearchQueries[]", "webSearchQueries"),
]
LEAVES = [("openai", "output[].content[].annotations[]", "content"), ("google", "candidates[].groundingMetadata.groundingSupports[].groundingChunkIndices[]", "groundingSupports")]
REPEATED = frozenset([*ITEMS.values(), *(p.removesuffix("[]") for _, p, _ in CHILDREN + LEAVES)])


def payload_levels(df: DataFrame, key: str = "payload_id", payload: str = "payload", platform: str = "platform") -> DataFrame:
    """payload_id, item_pos, item_type, child_kind, child_pos, leaf_pos: a row for each element at each of three levels.

    The tables of items, children and leaves are made at once, with an item's type as their pivoted column; what an
    item holds is then linked to it by the record's id and the first ordinal. Both groupings are within one record, so
    one exchange serves them.
    """
    levels = {(own, f"{p}[]"): ("", 1) for own, p in ITEMS.items()} | {(own, p): (n, 2) for own, p, n in CHILDREN} | {(own, p): (n, 3) for own, p, n in LEAVES}
    t = explode_triples(df, key, payload, REPEATED, ITEMS.values(), platform, {*(p for _, p in levels), *ITEM_TYPE})
    of_platform = lambda pairs, then: F.coalesce(*[F.when((F.col(platform) == own) & then(p, x), x if isinstance(x, Column) else F.lit(x)) for own, p, x in pairs])
    label = of_platform([(own, p, F.col("value")) for p, own in ITEM_TYPE.items()], lambda p, x: F.col("path") == p)
    rows = elements(t, [key, platform], F.max(label).alias("label"))
    level = of_platform([(own, g, F.struct(F.lit(n).alias("child_kind"), F.lit(d).alias("depth"))) for (own, g), (n, d) in levels.items()], lambda g, x: F.col("group") == g)
    at = lambda i: F.when(F.col("l.depth") > i, F.get("ordinals", F.lit(i))).otherwise(-1)
    rows = rows.withColumn("l", level).where("l is not null")
    one = rows.groupBy(key, platform, F.get("ordinals", F.lit(0)).alias("item_pos")).agg(F.max("label").alias("item_type"), F.collect_set(F.struct("l.child_kind", at(1).alias("child_pos"), at(2).alias("leaf_pos"))).alias("all"))
    return one.select(F.col(key).alias("payload_id"), "item_pos", F.coalesce("item_type", F.lit("")).alias("item_type"), F.explode("all").alias("x")).select("payload_id", "item_pos", "item_type", "x.*").distinct()
