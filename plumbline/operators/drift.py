"""Schemas that drift between files: one consistent table, and every change reported.

Method: similarity flooding. Each file gets a schema graph: fields with their names, JSON types, nesting and a profile
of their content. Between a file and the one before it, every pair of a field that went and a field that came under
the same parent, or under parents that may be each other, starts with a similarity of names, types and content;
similarities then flow between pairs that are joined by an edge of both graphs (parent and child, siblings that
stayed) until they settle; and a consistent set of correspondences is selected, best first, each field at most once.
Content decides: a field that came is the one that went if what it holds is of the same kind, whatever it is called.

Profiles are merged by partial aggregation, so their number follows files times fields, not lines: counts by type, a
sketch of distinct values (the ``SKETCH`` of least hash, each a hash of the whole value) and of value shapes, and
ranges of numbers. The sketch is an estimator of how alike two sets are and drops no field and no line. A pair of files
is one group of one task.

Defined results: lines that are null or no JSON object are left out; a repeated line changes nothing; a field that
only holds null in one of two files is not retyped; files are compared in order of file_no, whenever they came.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.jsonstream import dumps, loads
from plumbline.operators.lineage import collect_bounded, cut
from plumbline.operators.nested import kind_of as _kind

DESCEND = frozenset({"payload", "payload.output", "payload.usage"})
SKETCH = 48  # values and shapes that a profile keeps, those of least hash
SETTLED = 1e-3  # how much a similarity may still move when the flooding ends
CALM = 8  # rounds after which each further one moves less, so that it ends
ACCEPT = 0.5  # least similarity of content for a rename
_RUN = re.compile(r"[^\W_]+")


def fields(record: dict, descend: frozenset[str], prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of every field; arrays of objects are entered without a mark."""
    for k, v in record.items():
        path = prefix + k
        yield path, v
        if path in descend:
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict):
                    yield from fields(x, descend, path + ".")


def entries(record: dict, descend: frozenset[str], prefix: str = "", place: tuple[int, ...] = ()) -> Iterator[tuple[str, tuple[int, ...], object]]:
    """(path, positions in the arrays on the way, value) of all that a record holds. What stands where an object is descended into but is none, or is empty, is a value of that path."""
    for k, v in record.items():
        path = prefix + k
        if path not in descend:
            yield path, place, v
            continue
        many = isinstance(v, list) and len(v) > 0
        for i, x in enumerate(v if many else [v]):
            here = (*place, i) if many else place
            if isinstance(x, dict) and x:
                yield from entries(x, descend, path + ".", here)
            else:
                yield path, here, x


def _leaves(v: object) -> Iterator[object]:
    todo = [v]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
        elif v is not None:
            yield v


def _shape(s: str) -> str:
    """What a value looks like: runs of letters, of digits and of both, with the signs between them; long text by its length only."""
    if len(s) > 60 or s.count(" ") > 3:
        return f"text {int(math.log2(len(s)))}"
    return _RUN.sub(lambda m: "9" if m.group().isdigit() else "a" if m.group().isalpha() else "x", s)


def _least(values: Iterable[str]) -> list[str]:
    return heapq.nsmallest(SKETCH, values, key=lambda s: (zlib.crc32(s.encode("utf-8", "surrogatepass")), s))


def profile(values: list[object]) -> dict:
    """A mergeable profile of a field's values within some lines."""
    p: dict = {"n": len(values), "types": sorted({_kind(v) for v in values if v is not None}), "lo": None, "hi": None, "whole": 0, "numbers": 0, "sum": 0.0, "chars": 0, "texts": 0}
    leaves = [x for v in values if v is not None for x in (_leaves(v) if isinstance(v, (dict, list)) else (v,))]
    numbers = [x for x in leaves if isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)]
    texts = [x if isinstance(x, str) else dumps(x) for x in leaves if isinstance(x, (str, bool)) or not math.isfinite(x)]
    if numbers:
        p |= {"lo": min(numbers), "hi": max(numbers), "numbers": len(numbers), "whole": sum(1 for x in numbers if isinstance(x, int) or x.is_integer()), "sum": float(sum(numbers))}
    distinct = set(texts)
    p["texts"], p["chars"] = len(texts), sum(map(len, texts))
    # long values stand in the sketch by a hash of all of it
    short = (t if len(t) <= 40 else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() for t in distinct)
    return p | {"values": _least({*short, *map(repr, set(numbers))}), "shapes": _least(set(map(_shape, distinct)))}


def merge(a: dict, b: dict) -> dict:
    out = {k: a[k] + b[k] for k in ("n", "whole", "numbers", "sum", "chars", "texts")}
    for k, f in (("lo", min), ("hi", max)):
        both = [x[k] for x in (a, b) if x[k] is not None]
        out[k] = f(both) if both else None
    return out | {"types": sorted({*a["types"], *b["types"]}), "values": _least({*a["values"], *b["values"]}), "shapes": _least({*a["shapes"], *b["shapes"]})}


def _dice(a: Iterable[str], b: Iterable[str]) -> float:
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def name_similarity(a: str, b: str) -> float:
    split = lambda s: re.findall(r"[a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s).lower())
    x, y = split(a), split(b)
    grams = lambda w: Counter(f" {s} "[i : i + 3] for s in w for i in range(len(s)))
    return max(_dice(x, y), _dice(grams(x), grams(y)))


def content_similarity(a: dict, b: dict, names: float) -> float:
    if not a["types"] or not b["types"]:
        return 0.55 if names >= 0.5 else 0.0  # nothing to go by but the name
    if a["types"] != b["types"]:
        return 0.0
    if a["types"] == ["boolean"]:
        return 0.55 if names >= 0.5 else 0.3
    if a["numbers"] > a["texts"]:
        if not b["numbers"]:
            return 0.0
        kind = 1.0 if (a["whole"] < a["numbers"]) == (b["whole"] < b["numbers"]) else 0.3
        scale = lambda p: math.log10(1 + abs(p["sum"] / p["numbers"]))
        size = max(0.0, 1 - abs(scale(a) - scale(b)))
        union = max(a["hi"], b["hi"]) - min(a["lo"], b["lo"])
        overlap = max(0.0, min(a["hi"], b["hi"]) - max(a["lo"], b["lo"])) / union if union else 1.0
        return kind * max(size, overlap, _dice(a["values"], b["values"]))
    if not a["texts"] or not b["texts"]:
        return 0.0
    shared = _dice(a["values"], b["values"])
    least = min(len(a["values"]), len(b["values"]))
    within = len({*a["values"]} & {*b["values"]}) / least if least else 0.0
    shapes = _dice(a["shapes"], b["shapes"])
    x, y = a["chars"] / a["texts"], b["chars"] / b["texts"]
    length = min(x, y) / max(x, y) if max(x, y) else 1.0
    if least and max(len(a["values"]), len(b["values"])) <= 8 and a["n"] >= 2 * len(a["values"]):  # codes from a short list
        return max(shared, 0.9 * within)
    signs = lambda p: {_RUN.sub("w", x) for x in p["shapes"]} - {"w"}
    frames = 0.85 * _dice(signs(a), signs(b))  # the signs between words and numbers, where there are any
    return max(shared, 0.9 * within, max(shapes, frames) * (0.4 + 0.6 * length))


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def flood(old: dict[str, dict], new: dict[str, dict]) -> list[tuple[str, str, float]]:
    """Renamed fields: (old path, new path, similarity)."""
    gone, come = [p for p in old if p not in new], [p for p in new if p not in old]
    went, came = set(gone), set(come)
    start: dict[tuple[str, str], float] = {}
    content: dict[tuple[str, str], float] = {}
    for a in gone:
        for b in come:
            if _parent(a) == _parent(b) or _parent(a) in went and _parent(b) in came:
                names = name_similarity(a.rpartition(".")[2], b.rpartition(".")[2])
                content[a, b] = content_similarity(old[a], new[b], names)
                if content[a, b] > 0:
                    start[a, b] = 0.7 * content[a, b] + 0.3 * names
    if not start:
        return []
    stayed = {p for p in old if p in new}
    below: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for a, b in start:
        below.setdefault((_parent(a), _parent(b)), []).append((a, b))
    now, moved, rounds = dict(start), 1.0, 0
    while moved >= SETTLED:
        # the two best of each field's pairs: a pair's best rival is the one that isn't itself
        best: dict[tuple[int, str], list[tuple[float, tuple[str, str]]]] = {}
        for pair, s in now.items():
            for side in (0, 1):
                top = best.setdefault((side, pair[side]), [])
                top.append((s, pair))
                top.sort(reverse=True)
                del top[2:]
        after = {}
        for pair, s in now.items():
            a, b = pair
            rival = max((x for side in (0, 1) for x, other in best[side, pair[side]] if other != pair), default=0.0)
            up = now.get((_parent(a), _parent(b)), 1.0 if _parent(a) in stayed or not _parent(a) else 0.0)
            down = [now[x] for x in below.get(pair, ())]
            flow = 0.15 * up + 0.15 * (sum(down) / len(down) if down else 0.0)
            after[pair] = start[pair] + 0.5 * s + flow - 0.25 * rival
        most = max(after.values())
        after = {k: max(0.0, v / most) for k, v in after.items()} if most > 0 else after
        rounds += 1
        pace = min(1.0, CALM / rounds)
        after = {k: now[k] + pace * (after[k] - now[k]) for k in now}
        moved = max(abs(after[k] - now[k]) for k in now)
        now = after
    out, used = [], set()
    for (a, b), s in sorted(now.items(), key=lambda x: (-x[1], -start[x[0]], x[0])):
        if a not in used and b not in used and content[a, b] >= ACCEPT and s > 0:
            used |= {a, b}
            out.append((a, b, round(s, 6)))
    return out


def changes(old: dict[str, dict], new: dict[str, dict]) -> list[tuple[str, str, str]]:
    """(field_path, change_kind, new_path)"""
    renamed = flood(old, new)
    was, now = {a for a, _, _ in renamed}, {b for _, b, _ in renamed}
    out = [(a, "renamed", b) for a, b, _ in renamed]
    out += [(p, "removed", "") for p in old if p not in new and p not in was]
    out += [(p, "added", "") for p in new if p not in old and p not in now]
    out += [(p, "retyped", "") for p in old if p in new and old[p]["types"] and new[p]["types"] and old[p]["types"] != new[p]["types"]]
    return sorted(out)


# --- Spark ---


FILE = "feed_id long, file_no int, fields binary"
HELD = 1 << 24  # code points of lines that a task holds
FEW = 64  # lines of a file below which they travel as they are: a profile would be larger


def _merged(a: dict[str, dict], b: dict[str, dict]) -> dict[str, dict]:
    return {p: merge(a[p], b[p]) if p in a and p in b else a.get(p) or b[p] for p in [*a, *(x for x in b if x not in a)]}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(feed_id, file_no, lines as a list or profiles by path)"""
    cols = list(zip(*[(*k, pickle.dumps(f)) for *k, f in rows], strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["feed_id", "file_no", "fields"])


def _profiled(lines: list[str], descend: frozenset[str]) -> dict[str, dict]:
    found: dict[str, list] = {}
    for text in lines:
        for path, v in fields(_record(text) or {}, descend):
            found.setdefault(path, []).append(v)
    return {p: profile(v) for p, v in found.items()}


def _join_sorted(descend: frozenset[str]):
    """Merges neighbouring rows of one file, lines or profiles, to its profile; rows come sorted by file. A file without a readable line has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, lines, held = None, {}, [], 0

        def settle() -> None:
            nonlocal whole, lines, held
            if lines:
                whole = _merged(whole, _profiled(lines, descend)) if whole else _profiled(lines, descend)
            lines, held = [], 0

        for b in batches:
            out = []
            for f, n, part in zip(*[b.column(c).to_pylist() for c in ("feed_id", "file_no", "fields")], strict=True):
                part = pickle.loads(part)
                if (f, n) != key:
                    settle()
                    if whole:
                        out.append((*key, whole))
                    key, whole = (f, n), {}
                if isinstance(part, dict):
                    whole = _merged(whole, part) if whole else part
                else:
                    lines += part
                    held += sum(map(len, part))
                    if held > HELD:
                        settle()
            yield _rows(out)
        settle()
        if whole:
            yield _rows([(*key, whole)])

    return run


def _record(text: str | None) -> dict | None:
    try:
        record = loads(text) if text else None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def profiles(df: DataFrame, feed: str, file_no: str, body: str, descend: frozenset[str] = DESCEND, tasks: int = 256) -> DataFrame:
    """feed_id, file_no, fields (profile by path): one row for each file with a readable line, kept.

    A task makes a profile of each file of which it has many lines; of others the lines travel, as a profile would be
    larger. What comes of ``tasks`` tasks is merged first, and then the file, each time as a sorted stream.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[str]] = {}
        size = 0
        done = lambda: _rows([(*k, _profiled(lines, descend) if len(lines) > FEW else lines) for k, lines in held.items()])
        for b in batches:
            for f, n, text in zip(*[b.column(c).to_pylist() for c in ("feed_id", "file_no", "body")], strict=True):
                held.setdefault((f, n), []).append(text)
                size += len(text)
            if size > HELD:
                yield done()
                held, size = {}, 0
        yield done()

    slim = df.select(F.col(feed).cast("long").alias("feed_id"), F.col(file_no).cast("int").alias("file_no"), F.col(body).alias("body")).where("feed_id is not null and file_no is not null and body is not null")
    key = ["feed_id", "file_no"]
    merged = slim.mapInArrow(part, FILE).withColumn("salt", F.floor(F.spark_partition_id() / tasks))
    for spread in ([*key, "salt"], key):
        merged = merged.repartition(*spread).sortWithinPartitions(*spread).select(*key, "fields").mapInArrow(_join_sorted(descend), FILE)
    return cut(merged)


def schemas(profiled: DataFrame) -> DataFrame:
    """feed_id, file_no, field_path, types: the fields of each file and the JSON types of their values, '' where all are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(f, n, path, ",".join(p["types"])) for f, n, part in zip(*[b.column(c).to_pylist() for c in ("feed_id", "file_no", "fields")], strict=True) for path, p in pickle.loads(part).items()]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["feed_id", "file_no", "field_path", "types"])

    return profiled.mapInArrow(run, "feed_id long, file_no int, field_path string, types string")


def report(profiled: DataFrame) -> DataFrame:
    """feed_id, file_no, field_path, change_kind, new_path: every change of a file against the one before it."""
    before = profiled.select("feed_id", "file_no").withColumn("prev", F.lag("file_no").over(Window.partitionBy("feed_id").orderBy("file_no"))).where("prev is not null")
    old = profiled.select("feed_id", F.col("file_no").alias("prev"), F.col("fields").alias("old"))
    both = before.join(profiled.withColumnRenamed("fields", "new"), ["feed_id", "file_no"]).join(old, ["feed_id", "prev"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for f, n, was, now in zip(*[b.column(c).to_pylist() for c in ("feed_id", "file_no", "old", "new")], strict=True):
                out += [(f, n, *c) for c in changes(pickle.loads(was), pickle.loads(now))]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["feed_id", "file_no", "field_path", "change_kind", "new_path"])

    return both.select("feed_id", "file_no", "old", "new").mapInArrow(compare, "feed_id long, file_no int, field_path string, change_kind string, new_path string")


def newest_names(changed: DataFrame, files: DataFrame) -> DataFrame:
    """feed_id, file_no, names (map of a field's name to the one it ends up with): a row for each file with fields that are renamed after it.

    A feed's files are gone through from the last one back, as a sorted stream that holds one map of names.
    """
    renames = changed.where("change_kind = 'renamed'").groupBy("feed_id", "file_no").agg(F.collect_set(F.struct("field_path", "new_path")).alias("renames"))
    rows = files.select("feed_id", "file_no").join(renames, ["feed_id", "file_no"], "left")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed, after = None, {}
        for b in batches:
            out = []
            for f, n, renamed in zip(*[b.column(c).to_pylist() for c in ("feed_id", "file_no", "renames")], strict=True):
                if f != feed:
                    feed, after = f, {}
                if after:
                    out.append((f, n, list(after.items())))
                if renamed:
                    after = after | {r["field_path"]: after.get(r["new_path"], r["new_path"]) for r in renamed}
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string())), strict=True)], names=["feed_id", "file_no", "names"])

    return rows.repartition("feed_id").sortWithinPartitions("feed_id", F.desc("file_no")).mapInArrow(back, "feed_id long, file_no int, names map<string,string>")


def consistent(df: DataFrame, names: DataFrame, feed: str, file_no: str, body: str, keep: Iterable[str] = (), descend: frozenset[str] = DESCEND) -> DataFrame:
    """The kept columns, place, field (the name that the field of this file ended up with), kind and value: one table for all layouts.

    ``names``: see ``newest_names``. ``place``: the positions (from 0) in the arrays on the way, joined by dots; ''
    outside arrays. A field whose later name its line already has keeps its own. Kept columns of these names push them
    to _place and so on. Lines that are null or no JSON object give nothing.
    """
    kept = list(keep)
    names_out = []
    for n in ("place", "field", "kind", "value"):
        while n.lower() in {k.lower() for k in kept}:
            n = "_" + n
        names_out.append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, place, path, kind, value = [], [], [], [], []
            for i, (text, pairs) in enumerate(zip(b.column("_body").to_pylist(), b.column("_names").to_pylist(), strict=True)):
                if (record := _record(text)) is None:
                    continue
                newest = dict(pairs or ())
                found = list(entries(record, descend))
                used = {(p, o) for p, o, _ in found}
                for p, o, v in found:
                    new = newest.get(p, p)
                    if new != p and (new, o) not in used:
                        p = new
                        used.add((p, o))
                    take.append(i)
                    place.append(".".join(map(str, o)))
                    path.append(p)
                    kind.append(_kind(v))
                    value.append(None if v is None else v if isinstance(v, str) else dumps(v))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in kept], pa.array(place, pa.string()), pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array(value, pa.string())], names=[*kept, *names_out])

    lines = df.select(*kept, F.col(feed).cast("long").alias("_feed"), F.col(file_no).cast("int").alias("_file"), F.col(body).alias("_body"))
    slim = lines.join(names.toDF("_feed", "_file", "_names"), ["_feed", "_file"], "left").select(*kept, "_body", "_names")
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.select(*kept).schema)
    return slim.mapInArrow(run, head + ", ".join(f"{n} string" for n in names_out))


_NUMBER, _WHOLE = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$", r"^-?(0|[1-9]\d{0,17})$"


def types(long: DataFrame, most: int = 5_000) -> dict[str, str]:
    """The type of each field: the narrowest that holds all its values without loss, string where none does. Strings that read as numbers or truth values count as such where others of the field are."""
    v = F.col("value")
    number = v.rlike(_NUMBER) & ~v.rlike(r"^-?\d{16,}")
    some = lambda c: F.count(F.when(c, 1))
    by = long.groupBy("field").agg(F.count("value").alias("n"), some(F.expr("kind = 'boolean'")).alias("truths"), some(F.expr("kind = 'number'")).alias("numbers"), some(F.expr("kind in ('array', 'object')")).alias("nested"), some(v.isin("true", "false", "0", "1")).alias("as_truth"), some(v.rlike(_WHOLE)).alias("as_whole"), some(number).alias("as_number"))
    out = {}
    for r in collect_bounded(by, most, "fields"):
        flat = r["nested"] == 0
        out[r["field"]] = "boolean" if flat and r["truths"] and r["as_truth"] == r["n"] else "bigint" if flat and r["numbers"] and r["as_whole"] == r["n"] else "double" if flat and r["numbers"] and r["as_number"] == r["n"] else "string"
    return out


def table(long: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The cast-and-union form of ``consistent``: one row for each key and place, one column of its own type for each field.

    Fields of an array's elements are in the element's row. Dots become underscores; names that clash get one more at the end.
    """
    keys = [*keys, "place"]
    used, columns = {k.lower() for k in keys}, []
    for field, kind in sorted(types(long).items()):
        name = re.sub(r"\W", "_", field)
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        columns.append(F.max(F.when(F.col("field") == field, F.col("value")).try_cast(kind)).alias(name))
    return long.groupBy(*keys).agg(*columns or [F.count("*").alias("n_values")])
