"""Text expressions: quotes, tokens, excerpts. All run in the JVM; offsets are code points of the raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT = 200
SPAN_EXCERPT = 160
#: scripts that are written without blanks between words
SPACELESS = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FA1F}]"
#: Markdown that a quote has and its page doesn't, and what stands for it, in this order
MARKDOWN = (
    (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?mU)^\s{0,3}#{1,6}\s+", ""),
    (r"(?mU)^\s*(?:[-*+]|\d+[.)])\s+", ""),
    (r"\*\*|__|`", ""),
)


def strip_blanks(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_blank(c: Column) -> Column:
    return strip_blanks(F.regexp_replace(c, r"(?U)\s+", " "))


def comparable(c: Column) -> Column:
    """For comparing: one blank for many, small letters, ß as ss as full case folding has it."""
    return F.replace(F.lower(one_blank(c)), F.lit("ß"), F.lit("ss"))


def clip(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.left(c, F.lit(limit)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


def excerpt(c: Column, limit: int = EXCERPT) -> Column:
    return clip(strip_blanks(c), limit)


def normal_quote(c: Column) -> Column:
    """A quote's words without its Markdown and without the ellipsis where it was cut."""
    for pattern, to in MARKDOWN:
        c = F.regexp_replace(c, pattern, to)
    return one_blank(F.regexp_replace(strip_blanks(c), r"(?U)(?:\.\.\.|…)\s*$", ""))


def quote_pieces(c: Column) -> Column:
    """The normal forms of a quote's lines, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n+"), normal_quote), lambda p: p != "")


def spaceless(c: Column) -> Column:
    return F.coalesce(c.rlike(SPACELESS), F.lit(False))


def tokens(c: Column, by_character: Column) -> Column:
    """Words (runs of letters, numbers of any kind and underscores; a combining mark ends one), or single letters and digits where either side of a comparison is in a spaceless script; small letters."""
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.when(by_character, F.filter(F.split(low, ""), lambda x: x.rlike(r"^[\p{L}\p{N}]$"))).otherwise(words)


def byte_to_code_point(text: Column, at: Column) -> Column:
    """The code point that begins at a byte offset of the UTF-8 form; null inside a character or beyond the end."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, F.lit(1), at) if not isinstance(at, int) else F.substring(raw, 1, at)
    starts = F.hex(F.substring(raw, at + 1, F.lit(1)))
    boundary = (at == F.octet_length(raw)) | ~starts.rlike("^[89AB]")
    return F.when((at >= 0) & (at <= F.octet_length(raw)) & boundary, F.length(F.decode(head, "UTF-8")))


def markdown_cell(c: Column) -> Column:
    """Safe inside a Markdown table: signs escaped, lines joined."""
    return F.regexp_replace(F.regexp_replace(c, r"([<>\[\]*`|])", r"\\$1"), r"\n", " ")
