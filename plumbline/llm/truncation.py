"""Find texts that were cut off at a field limit or in mid-transfer, and report how often each source cuts.

Method: the form of a text's end says only where it is surely whole (a terminal, a link, a finished table row, an emoji)
or looks finished (a list entry, a heading, a title); everything else is open. The final token of every text that is not
surely whole is then looked up in the corpus vocabulary trie: one that no text knows as a word, but that is a proper
prefix of known words, is half a word, and the text is cut. What the trie leaves open is cut if it ends on a mark of a
cut, if its length is a pile-up (as many texts of exactly this length as no neighbouring length has), or if its sentence
is open; a finished form is whole unless the trie says otherwise, and half words of one or two letters there need the
length evidence too. ``detect`` names the evidence of each row, in this order, ``evidence`` counts it.

The trie is held as a relation of (prefix node) rows and is only ever as deep as it is asked: of each first letter those
lengths are made that some final token has, so that neither the trie is gathered in one place nor a run of thousands of
letters gives all its prefixes.

Defined results: null and empty texts and texts of blanks only are whole; ids that occur twice are reported once
(cut if any of their rows is); a text that ends on a mark of a cut is cut whatever precedes it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ranking import cut

MARK = re.compile(r"(?:…|\.{3,}|\[\s*(?:…|\.{3}|truncated|cut|more)\s*\]|\(\s*(?:…|\.{3}|continued|more)\s*\))[\s\"'”»“’)\]*_]*$", re.I)
CLOSERS = " \t\"'”»“’‘)]}*_`›」』】）"
TERMINAL = ".!?。！？｡؟।"
ENTRY = re.compile(r"^\s*(?:[-*•‣◦–+]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)])(?:\s+|$)")
BARE_MARKER = re.compile(r"^\s*(?:[-*•‣◦–+]|\(?\d{1,4}[.)]?|\(?[A-Za-z][.)])\s*\**\s*$")
LINK = re.compile(r"(?:https?://|www\.)\S+$", re.I)
LINK_TO_ITEM = re.compile(r"^(?:https?://)?[^\s/]+\.[a-z]{2,}(?:/\S*)?$", re.I)
LAST_WORD = re.compile(r"([^\W\d_]+)[^\w]*$")
INNER_END = re.compile(r"[.!?](?:\s)|[。！？]")
SPACELESS = re.compile("[぀-ヿ一-鿿]")
TITLE_WORDS = 24
WHOLE, FINISHED, OPEN, MARKED = "whole", "finished", "open", "marked"  # surely whole; whole unless its last word is half; cut; cut by a mark
HALF_WORD, MARK_OF_CUT, FIELD_LIMIT, OPEN_SENTENCE = "half_word", "mark", "length", "open_sentence"  # evidence


def _clean(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", s.replace("…", "\x00")).replace("\x00", "…") if unicodedata.category(c) != "Cf")


def _shape(entry: str) -> str:
    """The punctuation of a list entry, its words and numbers left out."""
    body = ENTRY.sub("", entry, count=1)
    return re.sub(r"[^,:;()*–—|]+", "", body)


def _final_word(s: str) -> str:
    """The word that a line ends on, closing signs aside; '' if it ends on anything else."""
    m = LAST_WORD.search(s)
    return m.group(1) if m and s.rstrip(CLOSERS).endswith(m.group(1)) else ""


def _ends_number(last: str, before: str) -> bool:
    """A number with a full stop on a line of its own that continues no list and can't begin one: the wrapped end of a sentence."""
    return last[:-1].isdigit() and last[-1] == "." and int(last[:-1]) != 1 and before != "" and not ENTRY.match(before) and before[-1] not in TERMINAL + ":"


def judge_end(tail: str | None) -> tuple[str, str]:
    """(form of the end, final token to be looked up: '' for none). ``tail``: the last lines of a text."""
    if tail is None or not tail.strip():
        return WHOLE, ""
    if tail.isascii():
        t = tail.strip()
    else:
        t = _clean(tail).strip()
        if not t:
            return WHOLE, ""
    if mark := MARK.search(t):
        return MARKED, _final_word(t[: mark.start()])
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    last, before = lines[-1], lines[-2] if len(lines) > 1 else ""
    word = _final_word(last)
    if BARE_MARKER.match(last) and not _ends_number(last, before) and (not last[-1].isdigit() or before and not before[-1].isdigit() or ENTRY.match(before)):
        return OPEN, word
    if last.startswith("|"):
        return (WHOLE, "") if last.endswith("|") and len(last) > 1 and (not before.startswith("|") or last.count("|") >= before.count("|")) else (OPEN, word)
    if "\t" in last and "\t" in before:
        return (WHOLE, "") if last.count("\t") >= before.count("\t") else (OPEN, word)
    if LINK.search(last):
        return FINISHED, word
    kind = unicodedata.category(last[-1])
    if kind in ("So", "Sk") or last[-1] in "️⃣" or last[-1] in ")]" and unicodedata.category(last[-2:-1] or " ") in ("So", "Sm"):
        return WHOLE, ""
    bare = last.rstrip(CLOSERS)
    if last.count("**") % 2 or last.startswith("**") and not last.endswith("**") and ENTRY.match(last) is None and "**" not in last[2:]:
        return OPEN, word
    if bare and bare[-1] in TERMINAL:
        return WHOLE, ""
    if ENTRY.match(last):
        if last.count("(") > last.count(")") or last[-1] in ",:;(–—-&":
            return OPEN, word
        if ENTRY.match(before) and len(_shape(last)) < len(_shape(before)) and _shape(before).startswith(_shape(last)):
            return OPEN, word
        return FINISHED, word
    if re.match(r"#{1,6}\s", last) or last.startswith("**") and last.endswith("**"):
        return FINISHED, word
    words = last.split()
    if ": " in last and len(words) <= TITLE_WORDS and last[-1] not in ",;:(" and not INNER_END.search(last) and not _opens_quote(last):
        return FINISHED, word
    if not before and len(words) <= 4 and not SPACELESS.search(last) and all(w[:1].isupper() or w[:1].isdigit() or w in ("&", "/", "|") for w in words) and last[-1] not in ",;:(":
        return FINISHED, word
    return OPEN, word


def _opens_quote(s: str) -> bool:
    return s.count("“") + s.count("„") > s.count("”") + s.count("“") or s.count("«") > s.count("»")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [judge_end(t) for t in b.column("tail").to_pylist()]
        cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "tail"]
        names = [n for n in b.schema.names if n != "tail"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([d[0] for d in done], pa.string()), pa.array([d[1].lower() for d in done], pa.string())], names=[*names, "form", "last_word"])


def ends(df: DataFrame, key: str, text: str, table: str) -> DataFrame:
    """table_name, rec_id, n_chars, form, last_word of every non-empty text."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.lit(table).alias("table_name"), F.col(key).cast("long").alias("rec_id"), F.length(text).alias("n_chars"),
        F.substring_index(F.rtrim(F.regexp_replace(F.col(text), r"\n\s*\n", "\n")), "\n", -2).alias("tail"),
    )
    return rows.mapInArrow(_ends, "table_name string, rec_id long, n_chars int, form string, last_word string")


def vocabulary(*texts: DataFrame) -> DataFrame:
    """word: every word that some text has before its last word. One row per word, combined before the shuffle."""
    parts = [t.select(F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower(F.col(t.columns[0])), r"[^\p{L}]*\p{L}+[^\p{L}]*$", ""), r"[^\p{L}]+"))).alias("word")) for t in texts]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where(F.length("word") > 0).distinct()


def trie_nodes(words: DataFrame, asked: DataFrame) -> DataFrame:
    """node: those of ``asked`` (w) that are an inner node of the trie, i.e. a proper prefix of a word.

    Words meet the lengths that are asked of their first letter, one row for each letter, and give only these prefixes.
    """
    lengths = asked.groupBy(F.left("w", F.lit(1)).alias("letter")).agg(F.collect_set(F.length("w")).alias("asked"))
    branch = words.withColumn("letter", F.left("word", F.lit(1))).join(lengths, "letter")
    nodes = branch.select("word", F.explode(F.filter("asked", lambda n: n < F.length("word"))).alias("n")).select(F.left("word", F.col("n")).alias("node")).distinct()
    return nodes.join(asked, F.col("node") == F.col("w"), "left_semi")


def pile_ups(lengths: DataFrame, factor: float = 4.0, least: int = 5) -> DataFrame:
    """table_name, n_chars: lengths that far more texts have than the lengths next to them, i.e. field limits."""
    counts = lengths.groupBy("table_name", "n_chars").agg(F.count("*").alias("n"))
    near = counts.select("table_name", F.explode(F.array(*[F.col("n_chars") + d for d in (-3, -2, -1, 1, 2, 3)])).alias("n_chars"), F.col("n").alias("m"))
    around = near.groupBy("table_name", "n_chars").agg((F.sum("m") / 6).alias("around"))
    return counts.join(around, ["table_name", "n_chars"], "left").where((F.col("n") >= least) & (F.col("n") > factor * F.coalesce("around", F.lit(0.0)))).select("table_name", "n_chars", F.lit(True).alias("at_limit"))


def detect(sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """sources: (table, id column, text column, name). table_name, rec_id, n_chars, at_limit, cut, evidence (null where whole): one row for each row with a text."""
    if not sources:
        raise ValueError("no source")
    judged = None
    for df, key, text, name in sources:
        e = ends(df, key, text, name)
        judged = e if judged is None else judged.unionByName(e)
    judged = cut(judged)  # a few dozen bytes a text; read by each of the joins below
    words = cut(vocabulary(*[df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")) for df, _, text, _ in sources]))
    asked = judged.where((F.col("form") != WHOLE) & (F.col("last_word") != "")).select(F.col("last_word").alias("w")).distinct()
    unknown = cut(asked.join(words, F.col("word") == F.col("w"), "left_anti"))
    half = trie_nodes(words, unknown).select(F.col("node").alias("last_word"), F.lit(True).alias("is_half"))
    limits = pile_ups(judged.select("table_name", "n_chars"))
    out = judged.join(half, "last_word", "left").join(limits, ["table_name", "n_chars"], "left")
    at_limit, form, is_half = F.coalesce("at_limit", F.lit(False)), F.col("form"), F.coalesce("is_half", F.lit(False))
    evidence = (
        F.when(is_half & (form.isin(OPEN, MARKED) | (form == FINISHED) & ((F.length("last_word") > 2) | at_limit)), HALF_WORD)
        .when(form == MARKED, MARK_OF_CUT).when((form == OPEN) & at_limit, FIELD_LIMIT).when(form == OPEN, OPEN_SENTENCE)
    )
    return out.select("table_name", "rec_id", "n_chars", at_limit.alias("at_limit"), evidence.isNotNull().alias("cut"), evidence.alias("evidence"))


def found(sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    return detect(sources).where("cut").select("table_name", "rec_id").distinct()


def evidence(verdicts: DataFrame) -> DataFrame:
    """table_name, evidence, texts, at_limit: how many cut texts each kind of evidence decided, ids that repeat once, and how many of them are of a piled-up length."""
    one = verdicts.where("cut").groupBy("table_name", "rec_id").agg(F.min("evidence").alias("evidence"), F.max("at_limit").alias("at_limit"))
    return one.groupBy("table_name", "evidence").agg(F.count("*").alias("texts"), F.count_if("at_limit").alias("at_limit"))


def rates(verdicts: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """How often texts are cut by ``label`` (engine, domain, ...). labels: rec_id and label, one row per id."""
    one = verdicts.groupBy("rec_id").agg(F.max("cut").alias("cut"), F.max("at_limit").alias("at_limit"))
    return one.join(labels, "rec_id").groupBy(label).agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit")).withColumn("cut_share", F.round(F.col("cut") / F.col("texts"), 6))
