"""Which entities a text names, where and in what order: deterministic string matching with raw offsets.

A broadcast list of needles (bounded: one for each alias of the configuration) is matched in one pass over each text;
overlaps are settled by two interval sweeps, first within an entity, then across entities, as array expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import folding

# What ends the name of an organisation, and what is no part of a name that follows it.
ORGANISATION_ENDS = ("牙醫診所", "牙醫", "診所", "醫院", "口腔外科", "集團")
LEADING_WORDS = (
    "另外", "還有", "以及", "或者", "其次", "再來", "至於", "包括", "例如",
    "推薦", "建議", "可以看看", "像是", "譬如",
    "跟", "和", "與", "或", "及", "的", "是", "有", "在", "去", "找", "看",
)
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "st", "jr", "sr", "prof", "inc", "ltd", "co", "vs", "etc", "e.g", "i.e")

SPANS = "array<struct<start:int,end:int,entity:int>>"


@dataclass(frozen=True)
class Entity:
    name: str
    role: str  # brand or competitor
    aliases: tuple[str, ...] = field(default=())

    def needles(self) -> list[str]:
        return [n for a in (self.name, *self.aliases) if (n := folding.fold(a))]


def all_occurrences(text: Column, entities: list[Entity]) -> Column:
    """array of (start, end, number of the entity): every occurrence of every alias, overlapping ones too.

    Plain ASCII texts that contain no needle stay in the JVM.
    """
    needles = [(i, n) for i, e in enumerate(entities) for n in e.needles()]

    @F.pandas_udf(SPANS)
    def match(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b, "entity": i} for a, b, i in folding.occurrences(t, needles)])

    low, worth = F.lower(text), folding.foreign(text)
    for _, n in needles:
        worth = worth | F.contains(low, F.lit(n))
    return F.coalesce(match(F.when(worth, text)), F.when(text.isNotNull(), F.from_json(F.lit("[]"), SPANS)))


def sweep(spans: Column) -> Column:
    """Of spans in order of start and falling length, those that begin at or after the end of the last one kept."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("minus"), s["entity"].alias("entity"))))
    none = F.from_json(F.lit("[]"), SPANS)
    state = F.struct(none.alias("kept"), F.lit(-1).alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] - s["minus"]
        take = s["start"] >= acc["reach"]
        one = F.struct(s["start"].alias("start"), end.alias("end"), s["entity"].alias("entity"))
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(one))).otherwise(acc["kept"]).alias("kept"), F.when(take, end).otherwise(acc["reach"]).alias("reach"))

    return F.aggregate(ordered, state, step, lambda acc: acc["kept"])


def resolved(spans: Column, n_entities: int) -> Column:
    """Two sweeps: within each entity, then across entities. One sweep over all would keep other spans."""

    def of(i: int) -> Column:
        return sweep(F.filter(spans, lambda s: s["entity"] == i))

    return sweep(F.flatten(F.array(*[of(i) for i in range(n_entities)])))


def spans_by_entity(df: DataFrame, text: str, entities: list[Entity], to: str = "spans") -> DataFrame:
    """Adds the resolved spans."""
    return df.withColumn("_all", all_occurrences(F.col(text), entities)).withColumn(to, resolved(F.col("_all"), len(entities))).drop("_all")


def mentions(df: DataFrame, key: list[str], text: str, entities: list[Entity]) -> DataFrame:
    """key, entity, entity_role, char_start, char_end, n_spans, entity_rank: a row for each entity that a text names. Repeated rows of a key count once; only their spans are shuffled."""
    once = spans_by_entity(df, text, entities).select(*key, "spans").where(F.size("spans") > 0).dropDuplicates(key)
    at = once.select(*key, F.explode("spans").alias("s")).groupBy(*key, F.col("s.entity").alias("i"))
    first = at.agg(F.min(F.struct("s.start", "s.end")).alias("first"), F.count("*").alias("n_spans"))
    names = F.array(*[F.lit(e.name) for e in entities])
    roles = F.array(*[F.lit(e.role) for e in entities])
    # few entities to a text: their order is an array's, no window over all rows of a text
    ranked = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "i", "n_spans"))).alias("m")).select(*key, F.posexplode("m").alias("p", "m"))
    return ranked.select(*key, names[F.col("m.i")].alias("entity"), roles[F.col("m.i")].alias("entity_role"), F.col("m.first.start").alias("char_start"), F.col("m.first.end").alias("char_end"), "m.n_spans", (F.col("p") + 1).alias("entity_rank"))


# --- names that no alias explains ---

# What looks like a name.
NAME_PATTERNS = (
    r"[一-鿿]{2,10}(?:牙醫診所|牙醫|診所|醫院|口腔外科|集團)",
    r"\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){1,3}\b",
    r"[「『]([^」』]{2,30})[」』]",
)
_ORGANISATION = "(?:" + "|".join(ORGANISATION_ENDS) + ")"
#: all leading words at once: three characters have to be left, and after a single character the name of an organisation
_LEADING = re.compile(
    "(?:(?:" + "|".join(w for w in LEADING_WORDS if len(w) > 1) + ")(?=.{3})|[" + "".join(w for w in LEADING_WORDS if len(w) == 1) + f"](?=.{{3}})(?=.*{_ORGANISATION}$))*",
    re.S,
)
CANDIDATES = "array<struct<entity:string,char_start:int,char_end:int,form:string>>"


def name_candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(name, start, end, folded name) of whatever looks like a name, pattern by pattern."""
    out = []
    for m in (m for p in NAME_PATTERNS for m in re.finditer(p, text or "")):
        whole = m[m.lastindex or 0].rstrip()
        name = _LEADING.sub("", whole.lstrip(), count=1)
        end = m.start(m.lastindex or 0) + len(whole)
        if len(name) > (2 if name.isascii() else 1):
            out.append((name, end - len(name), end, folding.fold(name)))
    return out


def unknown_entities(df: DataFrame, key: list[str], text: str, entities: list[Entity]) -> DataFrame:
    """key, entity, char_start, char_end of names that no alias explains: candidates off every resolved span, the first of each folded form."""
    found = F.pandas_udf(lambda texts: texts.map(name_candidates), CANDIDATES)(F.col(text))
    rows = spans_by_entity(df, text, entities, "_spans").select(*key, "_spans", found.alias("_found"))
    off = lambda c: ~F.exists("_spans", lambda s: (c["char_start"] < s["end"]) & (c["char_end"] > s["start"]))
    rows = rows.withColumn("_free", F.filter("_found", off)).withColumn("_forms", F.transform("_free", lambda c: c["form"]))
    first = F.filter("_free", lambda c, i: F.array_position("_forms", c["form"]) == i + 1)
    return rows.select(*key, F.explode(first).alias("u")).select(*key, "u.entity", "u.char_start", "u.char_end")


# --- the sentence around a mention ---

# Fixed value: where a sentence ends and another begins.
SENTENCE_BREAK = r"[。！？]+|\n+|(?<=[.!?])\s+(?=[A-Z0-9\"“'‘(\[*-])"
_ABBREVIATED = re.compile(r"(?:^|[^A-Za-z.])(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.$", re.I)


def sentence_ranges(text: str) -> tuple[list[int], list[int]]:
    """Where the sentences of a text begin, and where each of them ends: a CJK full stop belongs to its sentence, blanks between sentences to none."""
    stops = [m for m in re.finditer(SENTENCE_BREAK, text) if not _ABBREVIATED.search(text, max(0, m.start() - 12), m.start())]
    return [0, *(m.end() for m in stops)], [*(m.end() if m[0][0] in "。！？" else m.start() for m in stops), len(text)]


def sentence_at(text: str, position: int) -> tuple[int, int]:
    """Raw range of the sentence that holds a position, without blanks at its ends."""
    begins, ends = sentence_ranges(text)
    i = bisect_right(begins, position) - 1
    body = text[begins[i] : ends[i]]
    a = begins[i] + len(body) - len(body.lstrip())
    return a, a + len(body.strip())


def sentences(df: DataFrame, key: list[str], text: str, entities: list[Entity], role: str = "brand") -> DataFrame:
    """key, sentence, highlights (ranges within the sentence) around the first mention of an entity of that role."""
    own = [i for i, e in enumerate(entities) if e.role == role]

    @F.pandas_udf("struct<sentence:string,highlights:array<struct<start:int,end:int>>>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans, strict=True):
            mine = sorted((x["start"], x["end"]) for x in (s if s is not None else ()) if x["entity"] in own)
            if not mine:
                out.append((None, []))
                continue
            a, b = sentence_at(t, mine[0][0])
            out.append((t[a:b], [{"start": x - a, "end": y - a} for x, y in mine if x >= a and y <= b]))
        return pd.DataFrame(out, columns=["sentence", "highlights"])

    return spans_by_entity(df, text, entities, "_spans").withColumn("_c", cut(F.col(text), F.col("_spans"))).select(*key, F.col("_c.sentence").alias("sentence"), F.col("_c.highlights").alias("highlights"))


def segments(sentence: Column, highlights: Column) -> Column:
    """The sentence as pieces in order: (piece, is a mention)."""
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<piece:string,marked:boolean>>").alias("out"))
    piece = lambda a, b, mark: F.filter(F.array(F.struct(sentence.substr(a + 1, b - a).alias("piece"), F.lit(mark).alias("marked"))), lambda x: x["piece"] != "")
    done = F.aggregate(highlights, start, lambda s, h: F.struct(h["end"].alias("at"), F.concat(s["out"], piece(s["at"], h["start"], False), piece(h["start"], h["end"], True)).alias("out")))
    return F.concat(done["out"], piece(done["at"], F.length(sentence), False))
