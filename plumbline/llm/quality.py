"""Per-document text statistics, and the kind of text they point to: prose, list, table or junk.

Method: every text is counted as a state of bounded size, and states merge associatively: sums over all code points,
counts over the lines that are closed, and as boundary state a summary of the open first and last line (first and last
signs, cells so far, blanks at its end), the words at either edge, and the line that waits for the first word of the
next one. A document longer than ``CHUNK`` code points is split into chunks after a line end, else after a blank, else
where the next one comes; chunks are spread over the cluster and merged in a tree of ``FAN_IN`` a node, ``LEVELS`` of
them, enough for the longest text that a table can hold. Merged counts equal those of the whole text in every field,
whatever the split. A document of one chunk takes the same steps in place. Ratios and rules come last.

Garbled text is judged as if it were sound: a text without sentences but with much that isn't ASCII is restored
first when a model of ``mojibake`` is given, whatever its length.

Defined results: null text gives null statistics and null kind; empty text gives zero counts and 'prose'; repeated
ids are merged to one row each in ``found``, which takes ids to be unique as the table says; extra columns are ignored.
``n_chars`` is the length as given; the other counts are those of the text with foreign signs folded.
"""

from __future__ import annotations

import functools
import heapq
import pickle
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import mojibake
from plumbline.llm.lookalike import skeleton
from plumbline.operators.lineage import collect_bounded
from plumbline.operators.lineage import cut as lineage_cut

CHUNK = 32_768
FAN_IN, LEVELS = 64, 3
VIRTUAL_LINE = 80  # a line counts as one for each so many code points (a Han one is two), so that wrapped and unwrapped prose weigh alike
BARE = 60  # longest list entry without a marker
SKETCH = 512  # smallest trigram hashes that are kept
ENTRY = re.compile(r"\s*(?:[-*•‣◦–+·▪]|\(?\d{1,4}[.)]|\(?[^\W\d_][.)])\s+\S")
TERMINAL = re.compile(r"[.!?。！？…][”\"»“’')\]*_\s]*$")
SENTENCE = re.compile(r"[^\s.!?][)”»“’\"']?[.!?…](?=[\s”»“\"’)*]|$)|[。！？]")
SENTENCE_END = re.compile(r"[.!?…](?<=[^\s.!?].)(?=[\s”»“\"’)*]|$)")  # as many as of SENTENCE where no full-width sign ends one, and found sooner
MIDDLE_END = re.compile(r"[.!?] ")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")  # the same in lower-case ASCII
HAN = re.compile("[㐀-鿿぀-ヿ]")
LONG_RUN = 26
SYMBOL = re.compile(r"[^\w\s]|_")
ASCII_SYMBOL = re.compile(r"[!-/:-@\[-`{-~]")
NOISE = re.compile(r"[!#-'*+/:<-@\[-`{}~]")  # signs that are rare in rows of a table
# the ASCII signs of these, deleted from UTF-8 to be counted
_SYMBOLS, _ASCII_SYMBOLS, _NOISE = (bytes(i for i in range(128) if x.match(chr(i))) for x in (SYMBOL, ASCII_SYMBOL, NOISE))
_ASCII = bytes(range(128))
GAP = re.compile(r"\S {2,}(?=\S)")
_CUT = re.compile(r"\n|[^\S\n](?=\S)")
TIGHT = {";": re.compile(r";(?! )"), ",": re.compile(r",(?![ ”»“’])")}
TEXT_SUMS = ("chars", "words", "word_chars", "symbols", "ascii_symbols", "noise", "non_ascii", "han", "common", "sentences", "long_chars")
LINE_SUMS = ("lines", "virtual", "terminal", "entries", "rows", "gap_rows", "weak_rows")
TAIL, HEAD = 24, 16  # signs at the end of a line that tell whether it ends a sentence, and at its start that tell whether it is an entry


# --- lines ---


def _row(first: str, last: str, pipes: int, tabs: int, middle_end: bool, semis: int, tight_semis: int, semi_blank: bool, commas: int, tight_commas: int, comma_blank: bool, braces: bool, gaps: int) -> tuple[bool, int]:
    """(a row of three or more marked cells, gaps of blanks between cells if it isn't)"""
    if first == last == "|":
        return pipes >= 4, 0
    if tabs >= 2:
        return True, 0
    if middle_end:
        return False, 0
    if not braces and (semis >= 2 and tight_semis >= 2 and not semi_blank or commas >= 2 and not comma_blank and tight_commas >= 2):
        return True, 0
    return False, gaps


def _whole_row(line: str) -> tuple[bool, int]:
    s = line.strip()
    if s[:1] == "|" == s[-1:]:
        return s.count("|") >= 4, 0
    if s.count("\t") >= 2:
        return True, 0
    if MIDDLE_END.search(s):
        return False, 0
    if "{" not in s and "}" not in s:  # signs between braces are code
        if s.count(";") >= 2 and len(TIGHT[";"].findall(s)) >= 2 and "; " not in s:
            return True, 0
        if s.count(",") >= 2 and ", " not in s and len(TIGHT[","].findall(s)) >= 2:
            return True, 0
    return False, len(GAP.findall(s)) if "  " in s else 0


def _piece(text: str) -> dict:
    """Summary of a piece of a line. A piece that goes on does so after a blank."""
    body = text.strip()
    trail = text[len(text.rstrip()) :] if body else ""
    return {
        "n": len(text), "han": len(HAN.findall(text)), "tail": text[-TAIL:], "head": re.sub(r"\s+", " ", text.lstrip())[:HEAD] if body else "", "first": body[:1], "last": body[-1:], "word": len(body.split(None, 1)[0]) if body else 0,
        "pipes": body.count("|"), "tabs": body.count("\t"), "middle_end": MIDDLE_END.search(body) is not None,
        "semis": body.count(";"), "tight_semis": len(TIGHT[";"].findall(body)), "semi_blank": "; " in body, "commas": body.count(","), "tight_commas": len(TIGHT[","].findall(body)), "comma_blank": ", " in body, "braces": "{" in body or "}" in body, "gaps": len(GAP.findall(body)) if "  " in body else 0,
        "trail": (trail[:1] == " ", trail.count("\t"), len(trail) > 1 and not trail.strip(" ")),
    }


def _join(a: dict, b: dict) -> dict:
    """Two pieces of one line as one."""
    if not a["first"] or not b["first"]:  # one of them is blank
        out = dict(b if not a["first"] else a) | {"n": a["n"] + b["n"], "han": a["han"] + b["han"], "tail": (a["tail"] + b["tail"])[-TAIL:]}
        if a["first"] and b["n"]:
            out["trail"] = (a["trail"][0], a["trail"][1] + b["tail"].count("\t"), False)
        return out
    blank, tabs, gap = a["trail"]
    out = {k: a[k] + b[k] for k in ("n", "han", "pipes", "tabs", "semis", "tight_semis", "commas", "tight_commas", "gaps")}
    out |= {k: a[k] or b[k] for k in ("middle_end", "semi_blank", "comma_blank", "braces")}
    out |= {"tail": (a["tail"] + b["tail"])[-TAIL:], "head": (a["head"] + b["head"])[:HEAD], "first": a["first"], "last": b["last"], "word": a["word"], "trail": b["trail"]}
    # what the blanks between them make of the sign before
    out["tabs"] += tabs
    out["gaps"] += gap
    if blank:
        out["middle_end"] |= a["last"] in ".!?"
        for sign, name in ((";", "semi"), (",", "comma")):
            if a["last"] == sign:
                out[f"tight_{name}s"] -= 1
                out[f"{name}_blank"] = True
    return out


def _no_lines() -> dict:
    """Counts over closed lines, the length of their first word, and the length of the last one if it waits for the next one's first word."""
    return dict.fromkeys(LINE_SUMS, 0) | {"longest": 0, "wraps": {}, "word": None, "waits": None}


def _tally(c: dict, n: int, han: int, word: int, ends: bool, row: bool, gaps: int, entry: bool) -> None:
    """Adds one line that isn't blank."""
    if c["word"] is None:
        c["word"] = word
    if c["waits"] is not None:
        k = c["waits"] + 1 + word
        c["wraps"][k] = c["wraps"].get(k, 0) + 1
    gap = 2 <= gaps <= 20  # three to twenty cells; with one gap a cell may have filled its column
    c["lines"] += 1
    c["longest"] = max(c["longest"], n)
    c["terminal"] += ends
    c["rows"] += row
    c["gap_rows"] += gap
    c["weak_rows"] += gaps == 1
    c["entries"] += entry
    c["virtual"] += 1 if row or gap or entry else -(-(n + han) // VIRTUAL_LINE)
    c["waits"] = None if entry or ends or n >= BARE or row or gap else n


def _whole_lines(lines: list[str], wide: bool) -> dict:
    c = _no_lines()
    for line in lines:
        if line and not line.isspace():
            n = len(line)
            row, gaps = _whole_row(line)
            _tally(c, n, len(HAN.findall(line)) if wide else 0, len(line.split(None, 1)[0]), TERMINAL.search(line, max(0, n - TAIL)) is not None, row, gaps, ENTRY.match(line) is not None)
    return c


def _closed(p: dict) -> dict:
    """The counts of a line that is whole now."""
    c = _no_lines()
    if p["first"]:
        row, gaps = _row(*(p[k] for k in ("first", "last", "pipes", "tabs", "middle_end", "semis", "tight_semis", "semi_blank", "commas", "tight_commas", "comma_blank", "braces", "gaps")))
        _tally(c, p["n"], p["han"], p["word"], TERMINAL.search(p["tail"]) is not None, row, gaps, ENTRY.match(p["head"]) is not None)
    return c


def _follow(a: dict, b: dict) -> dict:
    """The counts of lines and of those after them."""
    if not a["lines"]:
        return b
    if not b["lines"]:
        return a
    out = {k: a[k] + b[k] for k in LINE_SUMS} | {"longest": max(a["longest"], b["longest"]), "word": a["word"], "waits": b["waits"]}
    wraps = dict(a["wraps"])
    for k, n in b["wraps"].items():
        wraps[k] = wraps.get(k, 0) + n
    if a["waits"] is not None:
        k = a["waits"] + 1 + b["word"]
        wraps[k] = wraps.get(k, 0) + 1
    return out | {"wraps": wraps}


# --- texts ---


def _hashes(words: list[str]) -> set[int]:
    return {zlib.crc32(f"{a} {b} {d}".encode("utf-8", "surrogatepass")) for a, b, d in zip(words, words[1:], words[2:])}


def _sums(block: str, common: frozenset[str], common_chars: frozenset[str]) -> tuple[dict, list[str]]:
    """(counts over all code points and words, the words)"""
    c = dict.fromkeys(TEXT_SUMS, 0)
    c["chars"] = len(block)
    words = (ASCII_WORD if block.isascii() else WORD).findall(block.lower())
    c["words"], c["word_chars"] = len(words), sum(map(len, words))
    c["common"] = sum(map(common.__contains__, words))
    raw = block.encode("utf-8", "surrogatepass")
    without = lambda signs: len(raw) - len(raw.translate(None, signs))
    c["symbols"], c["ascii_symbols"], c["noise"] = without(_SYMBOLS), without(_ASCII_SYMBOLS), without(_NOISE)
    wide = False
    if len(raw) > len(block):
        foreign = raw.translate(None, _ASCII).decode("utf-8", "surrogatepass")
        c["non_ascii"] = len(foreign)
        signs = set(foreign)
        c["symbols"] += sum(foreign.count(x) for x in signs if SYMBOL.match(x))
        wide = not signs.isdisjoint("。！？")
        if any(map(HAN.match, signs)):
            c["han"] = len(HAN.findall(foreign))
            c["common"] += sum(foreign.count(x) for x in signs if x in common_chars)
    c["sentences"] = len((SENTENCE if wide else SENTENCE_END).findall(block))
    runs = block.split()
    if max(map(len, runs), default=0) >= LONG_RUN:
        c["long_chars"] = sum(len(x) for x in runs if len(x) >= LONG_RUN and not HAN.search(x) and "://" not in x)
    return c, words


def count(text: str, common: frozenset[str], chars: frozenset[str]) -> dict:
    """The counts of a whole text. Trigrams are made where the rules ask for them."""
    c, words = _sums(text, common, chars)
    c |= _whole_lines(text.split("\n"), c["han"] > 0)
    return c | {"trigrams": heapq.nsmallest(SKETCH, _hashes(words)) if few_sentences(c) else [], "n_trigrams": max(0, c["words"] - 2)}


def few_sentences(c: dict) -> bool:
    """Trigrams count in texts of few sentences only: elsewhere nothing repeats endlessly."""
    return c["sentences"] * 500 < c["chars"]


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about ``size``: cut after a line end, else between a blank and what follows it."""
    at = 0
    while len(text) - at > size:
        to = text.rfind("\n", at + size // 2, at + size) + 1
        if not to:
            m = _CUT.search(text, at + size - 1)
            if m is None:
                break
            to = m.end()
        yield text[at:to]
        at = to
    yield text[at:]


def partial(chunk: str, common: frozenset[str], chars: frozenset[str]) -> dict:
    """The state of a chunk: text (sums), left and right (open lines; right is None without a line end), lines (closed ones between), words at the edges, trigrams."""
    c, words = _sums(chunk, common, chars)
    lines = chunk.split("\n")
    left, right = _piece(lines[0]), _piece(lines[-1]) if len(lines) > 1 else None
    return {"text": c, "left": left, "lines": _whole_lines(lines[1:-1], c["han"] > 0), "right": right, "first": words[:2], "last": words[-2:], "trigrams": heapq.nsmallest(SKETCH, _hashes(words))}


def merge(x: dict, y: dict) -> dict:
    out = {"text": {k: x["text"][k] + y["text"][k] for k in TEXT_SUMS}}
    if x["right"] is None:
        out |= {"left": _join(x["left"], y["left"]), "lines": y["lines"], "right": y["right"]}
    elif y["right"] is None:
        out |= {"left": x["left"], "lines": x["lines"], "right": _join(x["right"], y["left"])}
    else:
        out |= {"left": x["left"], "lines": _follow(_follow(x["lines"], _closed(_join(x["right"], y["left"]))), y["lines"]), "right": y["right"]}
    across = _hashes(x["last"] + y["first"])
    return out | {"first": (x["first"] + y["first"])[:2] if len(x["first"]) < 2 else x["first"], "last": (x["last"] + y["last"])[-2:] if len(y["last"]) < 2 else y["last"], "trigrams": heapq.nsmallest(SKETCH, {*x["trigrams"], *y["trigrams"], *across})}


def close(state: dict) -> dict:
    lines = _closed(state["left"])
    if state["right"] is not None:
        lines = _follow(_follow(lines, state["lines"]), _closed(state["right"]))
    c = state["text"] | lines
    return c | {"trigrams": state["trigrams"] if few_sentences(c) else [], "n_trigrams": max(0, c["words"] - 2)}


def _n_words(c: dict) -> int:
    """Two Han characters count as a word."""
    return c["words"] + c["han"] // 2


def kind(c: dict) -> str:
    """Rule outcomes, in order."""
    if not c["lines"]:
        return "prose"
    lines, virtual, n, words = c["lines"], c["virtual"], max(1, c["chars"]), _n_words(c)
    density = c["sentences"] / n * 100
    gap_rows = c["gap_rows"] + c["weak_rows"] if lines > 1 and 2 * c["gap_rows"] >= c["weak_rows"] else 0
    if c["noise"] > 0.2 * n:
        return "junk"
    if c["rows"] + gap_rows > 0.5 * virtual:
        return "table"
    if c["entries"] > 0.5 * virtual:
        return "list"
    if c["ascii_symbols"] > 0.12 * n or c["long_chars"] > 0.5 * n:
        return "junk"
    if c["n_trigrams"] >= 15 and few_sentences(c):
        kept = c["trigrams"]
        distinct = len(kept) if len(kept) < SKETCH else (SKETCH - 1) / (kept[-1] / 2**32)
        if distinct < 0.2 * c["n_trigrams"]:
            return "junk"
    wraps = dict(c["wraps"])
    if c["waits"] is not None:  # the last line: nothing follows
        wraps[c["waits"] + 1] = wraps.get(c["waits"] + 1, 0) + 1
    bare = c["entries"] + sum(k for at, k in wraps.items() if density < 0.1 or at <= c["longest"])
    if bare > 0.5 * virtual and bare >= 3 and density < 0.75:
        return "list"
    if density < 0.06 and (words >= 40 or words >= 15 and c["common"] < 0.1 * words) and lines <= 2 + words / 10:
        return "junk"
    return "prose"


OUT = "n_chars long, n_words long, mean_word_length double, symbol_ratio double, n_lines long, terminal_line_share double, common_word_share double, entry_share double, row_share double, sentences long, text_kind string"


def _ratios(c: dict, n_chars: int) -> dict:
    r = lambda a, b: round(a / b, 6) if b else 0.0
    return {
        "n_chars": n_chars, "n_words": _n_words(c), "mean_word_length": r(c["word_chars"], c["words"]), "symbol_ratio": r(c["symbols"], c["chars"]), "n_lines": c["lines"], "terminal_line_share": r(c["terminal"], c["lines"]),
        "common_word_share": r(c["common"], _n_words(c)), "entry_share": r(c["entries"], c["lines"]), "row_share": r(c["rows"] + (c["gap_rows"] if c["lines"] > 1 else 0), c["lines"]), "sentences": c["sentences"], "text_kind": kind(c),
    }


def _maybe_garbled(c: dict, text_kind: str) -> bool:
    return text_kind == "junk" and c["non_ascii"] > 0.08 * c["chars"]


def judge(text: str, lang: str | None, common: frozenset[str], chars: frozenset[str], model: mojibake.LanguageModel | None = None) -> dict:
    folded = skeleton(text)
    c = count(folded, common, chars)
    out = _ratios(c, len(text))
    if model is not None and _maybe_garbled(c, out["text_kind"]):
        restored, _, garbled = mojibake.inspect(folded, lang, model)
        if garbled and restored != folded:
            out["text_kind"] = kind(count(restored, common, chars))
    return out


def _words(common_words: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The given list of frequent words, a fixed table of a few hundred rows; Han ones also as single characters."""
    rows = [r[0].lower() for r in collect_bounded(common_words.select("word").where(F.col("word").isNotNull()).distinct(), 100_000, "common words")]
    return frozenset(skeleton(w) for w in rows) | frozenset(rows), frozenset(c for w in rows for c in w if HAN.match(c))


def statistics(docs: DataFrame, common_words: DataFrame, model: mojibake.LanguageModel | None = None, key: str = "doc_id", text: str = "text", lang: str | None = "lang", chunk: int = CHUNK) -> DataFrame:
    """One row of statistics for each row of ``docs``; repeated rows of a document over ``chunk`` are one."""
    common, chars = _words(common_words)
    shared = docs.sparkSession.sparkContext.broadcast((common, chars, model))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    fields = [x.split()[0] for x in OUT.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, chars, m = shared.value
        for b in batches:
            rows = [judge(t, x, common, chars, m) if t is not None else dict.fromkeys(fields) for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
            yield _batch(b.column("doc_id"), rows)

    def _batch(ids: pa.Array, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([ids, *[pa.array([r[f.split()[0]] for r in rows], kinds[f.split()[1]]) for f in OUT.split(", ")]], names=["doc_id", *fields])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1
                for part, piece in enumerate(chunks(skeleton(t), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([h], pa.int64()), pa.array([part], pa.int32()), pa.array([len(t) if part == 0 else 0], pa.int64()), pa.array([piece], pa.string())], names=["doc_id", "h", "part", "n_chars", "text"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, chars, _ = shared.value
        for b in batches:
            states = [pickle.dumps(partial(t, common, chars)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "h", "part", "n_chars")), pa.array(states, pa.binary())], names=["doc_id", "h", "part", "n_chars", "state"])

    def node(t: pa.Table) -> pa.Table:
        parts = {p: (n, s) for p, n, s in zip(t["part"].to_pylist(), t["n_chars"].to_pylist(), t["state"].to_pylist(), strict=True)}  # repeated rows of a document give a part twice
        state = functools.reduce(merge, (pickle.loads(parts[p][1]) for p in sorted(parts)))
        ids = {c: t[c].slice(0, 1).cast(pa.int64()) for c in ("doc_id", "h")}
        return pa.table(ids | {"part": pa.array([min(parts) // FAN_IN], pa.int32()), "n_chars": pa.array([sum(n for n, _ in parts.values())], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [close(pickle.loads(s)) for s in b.column("state").to_pylist()]
            rows = _batch(b.column("doc_id"), [_ratios(c, n) for c, n in zip(counts, b.column("n_chars").to_pylist(), strict=True)])
            yield rows.append_column("doubt", pa.array([_maybe_garbled(c, kind(c)) for c in counts], pa.bool_()))

    n = F.length("text")
    short = slim.where(F.col("text").isNull() | (n <= chunk)).mapInArrow(whole, f"doc_id long, {OUT}")
    key = ["doc_id", "h"]
    state = "doc_id long, h long, part int, n_chars long, state binary"
    tree = slim.where(n > chunk).select("doc_id", "text").mapInArrow(split, "doc_id long, h long, part int, n_chars long, text string").repartition(*key, "part").mapInArrow(parts, state)
    for _ in range(LEVELS):
        tree = tree.groupBy(*key, F.floor(F.col("part") / FAN_IN).alias("node")).applyInArrow(node, state)
    long = tree.mapInArrow(finish, f"doc_id long, {OUT}, doubt boolean")
    if model is None:
        return short.unionByName(long.drop("doubt"))
    # junk that may be garbled is judged once more as a whole, with restoring
    long = lineage_cut(long)
    again = slim.where(n > chunk).join(long.where("doubt").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "lang")
    return short.unionByName(long.where("not doubt").drop("doubt")).unionByName(again.mapInArrow(whole, f"doc_id long, {OUT}"))


def found(docs: DataFrame, common_words: DataFrame, model: mojibake.LanguageModel | None = None) -> DataFrame:
    """doc_id, text_kind of every document that isn't prose."""
    return statistics(docs, common_words, model).where("text_kind <> 'prose'").select("doc_id", "text_kind").distinct()
