"""Bring text that looks the same into one form, and pair the records that it makes equal.

Method: the texts of a batch that hold any code point of the mapping tables are exploded to one column of positioned
code points; the broadcast tables (decomposition, width, ligatures, blanks, unseen signs, look-alike letters) are
joined to it; combining marks are put in order of their class within each cluster; pairs of base and mark are
recomposed; and the strings are rebuilt. The columns are numpy arrays, so a batch is a handful of array operations
and nothing is shuffled. Texts without such a code point are in their final form already.

What makes no difference to a reader is mapped: width of characters, kind of a blank, signs that can't be seen, how
an accented letter is composed, joined letters, look-alike letters of another alphabet. Letter case, wording, line
breaks, accents, strokes, raised and circled digits and the drawing of an emoji (joiners and variation selectors
after one) are kept.

Pairs: records are reduced to (raw hash, hash of the form), each once; groups of equal form with more than one raw
variant are found by partial aggregation, variants (not records) are paired, and only then are the records of two
variants joined. Copies of one variant are thus never compared with each other, whatever their number, and no step
relies on a join's partitioning, so that AQE may split a form or a variant that a third of all rows have. ``classes``
gives one row for each record instead: its class of equal forms and how many records it reads like.

Defined results: null texts are left out; texts that are empty in either form pair only if the raw ones differ;
repeated rows of one id count once; an id with several texts pairs under each of them, never with itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets and the Latin letters that they look like.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝѵӏАВЕКМНОРСТУХІЈЅԌԚԜѴӀҮ", "aeopcyxijshdqwvlABEKMHOPCTYXIJSGQWVIY", strict=True))
GREEK = dict(zip("αικνορυχγϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "aikvopuxycjABEZHIKMNOPTYXC", strict=True))
ARMENIAN = dict(zip("օսհցզՕՏՍԼ", "ouhgqOSUL", strict=True))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN
VISIBLE_CF = range(0x600, 0x606), range(0x6DD, 0x6DE), range(0x70F, 0x710), range(0x890, 0x892), range(0x8E2, 0x8E3), range(0x110BD, 0x110CE)
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
ZWJ, SELECTORS, TAGS = 0x200D, (0xFE0E, 0xFE0F), range(0xE0020, 0xE0080)
HANGUL = range(0xAC00, 0xD7A4)


def _letters(cp: int) -> str | None:
    """What a code point reads as, before look-alikes; None if it stands for itself."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " " if c != " " else None
    if cp in UNSEEN or kind == "Cf" and not any(cp in r for r in VISIBLE_CF):
        return ""
    parts = unicodedata.decomposition(c).split()
    if not parts or cp in HANGUL:
        return None
    if not parts[0].startswith("<"):
        return unicodedata.normalize("NFD", c)
    letters = "".join(chr(int(p, 16)) for p in parts[1:])
    if parts[0] in ("<wide>", "<narrow>") or parts[0] == "<compat>" and kind[0] == "L" and len(letters) > 1 and all(x.isalpha() for x in letters):
        return "".join(_letters(ord(x)) if _letters(ord(x)) is not None else x for x in letters)
    return None


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """The mapping relations, made from the Unicode database by rule: (code point, ordinal, replacement), classes and pairs."""
    cps, starts, sizes, flat = [], [], [], []
    marks, classes = [], []
    firsts, seconds, composed = [], [], []
    emoji = []
    for cp in [*range(0xD800), *range(0xF900, 0x1F900), *range(0x1F900, 0x1FB00), *TAGS, *range(0xE0100, 0xE01F0), 0xE0001]:
        c = chr(cp)
        k = unicodedata.combining(c)
        if k:
            marks.append(cp)
            classes.append(k)
        if cp >= 0x2190 and unicodedata.category(c) in ("So", "Sk"):
            emoji.append(cp)
        to = _letters(cp)
        if to is None and c in LOOKALIKE:
            to = c
        if to is not None:
            to = "".join(LOOKALIKE.get(x, x) for x in to)
            if to != c:
                cps.append(cp)
                starts.append(len(flat))
                sizes.append(len(to))
                flat += map(ord, to)
        d = unicodedata.decomposition(c).split()
        if len(d) == 2 and not d[0].startswith("<") and cp not in HANGUL:
            a, b = (chr(int(x, 16)) for x in d)
            if unicodedata.combining(b) and unicodedata.normalize("NFC", a + b) == c:
                firsts.append(ord(LOOKALIKE.get(a, a)))
                seconds.append(ord(b))
                composed.append(cp)
    # of the composed letters that look alike, the Latin one; it comes first as its code point is lower
    pair = np.array(firsts, np.uint64) << np.uint64(32) | np.array(seconds, np.uint64)
    pair, at = np.unique(pair, return_index=True)
    return {"cp": np.array(cps, np.uint32), "start": np.array(starts, np.int64), "size": np.array(sizes, np.int64), "flat": np.array(flat, np.uint32), "mark": np.array(marks, np.uint32), "class": np.array(classes, np.uint8), "pair": pair, "composed": np.array(composed, np.uint32)[at], "emoji": np.array(emoji, np.uint32)}


@lru_cache(maxsize=1)
def _dirty() -> re.Pattern:
    t = tables()
    plain = {ord(c) for c in "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"}  # decompose and recompose to themselves
    cps = sorted((set(t["cp"].tolist()) | set(t["mark"].tolist())) - plain)
    out, a = [], None
    for x, y in zip(cps, [*cps[1:], -1]):
        a = x if a is None else a
        if y != x + 1:
            out.append(f"{re.escape(chr(a))}-{re.escape(chr(x))}" if a != x else re.escape(chr(a)))
            a = None
    return re.compile("[" + "".join(out) + "]")


@lru_cache(maxsize=1)
def _dense() -> tuple[np.ndarray, ...]:
    """The broadcast side of the join, spread out by code point: a lookup is one indexing."""
    t = tables()
    start, size, ccc, emoji = np.full(0x110000, -1, np.int32), np.ones(0x110000, np.uint8), np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    start[t["cp"]], size[t["cp"]], ccc[t["mark"]], emoji[t["emoji"]] = t["start"], t["size"], t["class"], True
    return start, size, ccc, emoji


def normalise_all(texts: list[str | None]) -> list[str | None]:
    """The consistent form of each text."""
    dirty = _dirty()
    todo = [i for i, t in enumerate(texts) if t and not t.isascii() and dirty.search(t)]
    if not todo:
        return list(texts)
    start, size, ccc, emoji = _dense()
    t = tables()
    pieces = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in todo]
    cp = np.concatenate(pieces)
    rec = np.repeat(np.arange(len(todo)), [len(p) for p in pieces])
    # signs that can't be seen stay where they choose the drawing of an emoji
    odd = np.nonzero((cp == ZWJ) | (cp == SELECTORS[0]) | (cp == SELECTORS[1]) | (cp >= TAGS[0]) & (cp <= TAGS[-1]))[0]
    keep = np.zeros(len(cp), bool)
    for i in odd.tolist():
        same = i > 0 and rec[i - 1] == rec[i]
        after = same and (emoji[cp[i - 1]] or keep[i - 1] or cp[i] != ZWJ and cp[i - 1] in (0x23, 0x2A, *range(0x30, 0x3A)))
        if cp[i] == ZWJ:
            after = after and i + 1 < len(cp) and rec[i + 1] == rec[i] and bool(emoji[cp[i + 1]])
        keep[i] = bool(after)
    # join the mapping tables: each code point gives the rows of its replacement, in order
    n = np.where(keep, 1, size[cp]).astype(np.int64)
    src = np.repeat(np.arange(len(cp)), n)
    ordinal = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
    at = start[cp[src]]
    mapped = (at >= 0) & ~keep[src]
    out = np.where(mapped, t["flat"][np.where(mapped, at + ordinal, 0)] if len(t["flat"]) else 0, cp[src]).astype(np.uint32)
    rec = rec[src]
    # order the marks of each cluster by class
    k = ccc[out]
    unsorted = (k[1:] > 0) & (k[:-1] > k[1:]) & (rec[1:] == rec[:-1])
    if unsorted.any():
        base = k == 0
        base[np.r_[True, rec[1:] != rec[:-1]]] = True
        by = np.argsort(np.cumsum(base).astype(np.int64) * 256 + k, kind="stable")
        out, rec, k = out[by], rec[by], k[by]
    # recompose base and mark, mark by mark
    live = np.nonzero((k > 0) & (np.arange(len(out)) > 0))[0]
    if len(live):
        gone = np.zeros(len(out), bool)
        last_class = {}
        lead = -1
        prev = -2
        for i in live.tolist():
            if prev != i - 1 or rec[i - 1] != rec[i]:
                lead = i - 1 if rec[i - 1] == rec[i] and k[i - 1] == 0 else -1
                last_class = 0
            prev = i
            if lead < 0:
                continue
            key = np.uint64(out[lead]) << np.uint64(32) | np.uint64(out[i])
            p = int(np.searchsorted(t["pair"], key))
            if p < len(t["pair"]) and t["pair"][p] == key and last_class != k[i]:
                out[lead] = t["composed"][p]
                gone[i] = True
            else:
                last_class = k[i]
        out, rec = out[~gone], rec[~gone]
    result = list(texts)
    ends = np.searchsorted(rec, np.arange(len(todo) + 1))
    raw = out.astype("<u4")
    for j, i in enumerate(todo):
        result[i] = raw[ends[j] : ends[j + 1]].tobytes().decode("utf-32-le", "surrogatepass")
    return result


def normalise_text(text: str | None) -> str | None:
    return normalise_all([text])[0]


@lru_cache(maxsize=1)
def _one_to_one() -> dict[int, str]:
    t = tables()
    return {int(c): "".join(map(chr, t["flat"][a : a + n])) for c, a, n in zip(t["cp"].tolist(), t["start"].tolist(), t["size"].tolist(), strict=True) if n <= 1 and chr(c) not in CYRILLIC}


def skeleton(text: str) -> str:
    """For word lists: text with its foreign signs folded, where most of its letters are Latin; texts with Han letters as they are."""
    if text.isascii() or not _dirty().search("".join(set(text))) or re.search("[㐀-鿿]", text):  # each sign is looked up once
        return text
    letters = {c: text.count(c) for c in set(text) if c.isalpha()}
    cyrillic = sum(n for c, n in letters.items() if "Ѐ" <= c <= "ӿ")
    return normalise_text(text) if 3 * cyrillic < sum(letters.values()) else text.translate(_one_to_one())


_CYRILLIC_WORD = re.compile("[A-Za-zЀ-ӿ]*[Ѐ-ӿ][A-Za-zЀ-ӿ]*")
_BACK = {ord(v): k for k, v in reversed(CYRILLIC.items()) if k in "аеорсухАВЕКМНОРСТУХ"}


def readable(form: str | None) -> str | None:
    """The form with whole words in one alphabet: words with a Cyrillic letter of their own get their other letters back.

    A function of the form alone, so equal forms stay equal.
    """
    if not form or form.isascii():
        return form
    return unicodedata.normalize("NFC", _CYRILLIC_WORD.sub(lambda m: unicodedata.normalize("NFD", m.group()).translate(_BACK), form))


# --- Spark ---


def normalise(df: DataFrame, text: str, to: str = "normal_text") -> DataFrame:
    """Adds the consistent form of ``text``; a column of that name is replaced."""
    df = df.drop(to)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([readable(x) for x in normalise_all(b.column(at).to_pylist())], pa.string())], names=[*b.schema.names, to])

    return df.mapInArrow(run, df.select("*", df[text].cast("string").alias(to)).schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        forms = normalise_all(texts)
        raw = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        form = [h if f is t or f == t else xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass")) for t, f, h in zip(texts, forms, raw, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("table_name"), b.column("rec_id"), pa.array(raw, pa.binary()), pa.array(form, pa.binary())], names=["table_name", "rec_id", "raw", "form"])


def forms(sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """sources: (table, id column, text column, name). table_name, rec_id, raw, form: 128-bit hashes of every text and of its form."""
    out = None
    for df, key, text, name in sources:
        rows = df.where(F.col(text).isNotNull()).select(F.lit(name).alias("table_name"), F.col(key).cast("long").alias("rec_id"), F.col(text).alias("text"))
        rows = rows.mapInArrow(_hashes, "table_name string, rec_id long, raw binary, form binary")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def pairs(hashed: DataFrame) -> DataFrame:
    """table_name, rec_a, rec_b: each pair of records that are equal in form and not in raw text."""
    group = ["table_name", "form"]
    mixed = hashed.groupBy(*group).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*group)
    rows = hashed.join(mixed, group, "left_semi")
    variants = rows.select(*group, "raw").distinct()
    both = variants.withColumnRenamed("raw", "raw_a").join(variants.withColumnRenamed("raw", "raw_b"), group).where("raw_a < raw_b")
    left = both.join(rows.select(*group, F.col("raw").alias("raw_a"), F.col("rec_id").alias("a")), [*group, "raw_a"])
    out = left.join(rows.select(*group, F.col("raw").alias("raw_b"), F.col("rec_id").alias("b")), [*group, "raw_b"])
    return out.where("a <> b").select("table_name", F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b")).distinct()


def classes(hashed: DataFrame) -> DataFrame:
    """table_name, rec_id, class_id (the first record of that form), n_records and n_variants of the form, n_links (records of the form in other code points): a row for each record and form. ``hashed``: see ``forms``."""
    group = ["table_name", "form"]
    variants = hashed.groupBy(*group, "raw").agg(F.count("*").alias("_same"), F.min("rec_id").alias("_first"))
    forms_ = variants.groupBy(*group).agg(F.sum("_same").alias("n_records"), F.count("*").alias("n_variants"), F.min("_first").alias("class_id"))
    out = hashed.join(variants.drop("_first"), [*group, "raw"]).join(forms_, group)
    return out.select("table_name", "rec_id", "class_id", "n_records", "n_variants", (F.col("n_records") - F.col("_same")).alias("n_links"))
