"""Find and restore text that was decoded with the wrong character encoding.

Method: every candidate decoding (a chain of wrong-decoder/true-encoding pairs) is priced by its description
length, i.e. its size after zstandard compression with a dictionary of one language, plus an escape price for
code points that the language's texts hardly ever show, plus the price of naming the chain. A chain is applied only
where it makes the description shorter; otherwise the text stays as it is.

Candidates are looked for only in the stretches that a decoder could have made (a table of that decoder's lead
and continuation characters), so clean text costs one scan. A stretch is priced with a margin of clean text on
either side, as garbling may touch a single character.

The only driver-side state is the language models: alphabets, known words and dictionaries of ``DICT_BYTES`` each. They
are made of exact counts over every labelled text, from its first sign to its last: texts with a letter, texts with a
word, and pieces (words, or windows where a script has no blanks). A letter or word is known by the share of its
language's texts that show it, and a dictionary is trained on pieces in proportion to their counts, so what the driver
sees is bounded by ``ROWS`` and ``PIECES`` and doesn't grow with the table. A first model is made of the
texts that look sound by their signs alone, the second of all texts that the first leaves as they are; every row of the
input is judged by the second.

Defined results: a null text gives (false, null, ''); an empty text is clean; text with U+FFFD or C1 controls is
garbled whether or not it can be restored; repeated ids give one row each per id in ``found``; extra columns are
carried along untouched by ``repair``; without any labelled text (empty table) a neutral model is used.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.lineage import collect_bounded, release, stored

ROWS = 1000  # a letter is known if one in so many texts of its language shows it, and two at least; a Han sign if half as many do
FIRST_WORDS, WORDS_OF = 100, 300  # a word likewise: fewer are known while garbled ones, which recur too, are among the counted
PIECES = 100_000  # a dictionary is trained on the pieces that make one in so many of their language's at least
WINDOW, LONG = 4, 24  # code points of a piece in scripts without blanks; longest word that is one piece
FLUSH = 400_000  # counts that a task holds before it hands them on
LANGUAGES = 1000  # more labels than that are refused, as a model of each goes to every worker
DICT_BYTES = 48 * 1024
MARGIN = 12  # code points of context on either side of a stretch
ROUNDS = 3  # longest chain
#: bytes for naming a chain: the rarer the mistake and the easier it is met by chance, the dearer
CHAIN_COST = {"cp1252>utf-8": 1.5, "mac_roman>utf-8": 2.5, "cp850>utf-8": 2.5, "cp437>utf-8": 3.0, "cp1251>utf-8": 4.0, "koi8_r>utf-8": 6.0, "gbk>utf-8": 4.0, "cp1252>utf-8 (blank lost)": 2.0}
LEGACY_COST = 8.0
UNSEEN_ELSEWHERE = 2.0  # bytes for a code point that only another language knows
UNSEEN = 4.0  # bytes for a code point that no language knows


def _single_byte(codec: str, sloppy: bool = True) -> dict[int, str]:
    """Byte -> characters a decoder of this kind produces; undefined bytes become the C1 control of that number."""
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            if sloppy:
                table[b] = chr(b)
    return table


class Decoder:
    """A wrong single-byte decoder: which characters it makes, and back to bytes."""

    def __init__(self, name: str, *codecs: str) -> None:
        self.name = name
        self.back: dict[str, int] = {}
        for codec in codecs:
            for b, c in _single_byte(codec).items():
                self.back.setdefault(c, b)
        groups: dict[str, list[str]] = defaultdict(list)
        for c, b in self.back.items():
            if b >= 0x80:
                groups["hi"].append(c)
                if b < 0xC0:
                    groups["cont"].append(c)
                elif 0xC2 <= b < 0xE0:
                    groups["two"].append(c)
                elif 0xE0 <= b < 0xF0:
                    groups["three"].append(c)
                elif 0xF0 <= b < 0xF5:
                    groups["four"].append(c)
        k = {g: "[" + "".join(map(re.escape, cs)) + "]" for g, cs in groups.items()}
        self.leads = frozenset(groups["two"] + groups["three"] + groups["four"])
        self.pair = re.compile(f"{k['cont']}(?<=[{''.join(map(re.escape, groups['two'] + groups['three'] + groups['four']))}]{k['cont']})")  # in every match of utf8, and found sooner
        self.high = frozenset(groups["hi"])
        self.utf8 = re.compile(f"(?:{k['two']}{k['cont']}|{k['three']}{k['cont']}{{2}}|{k['four']}{k['cont']}{{3}})+")
        self.run = re.compile(f"{k['hi']}(?:[ ]?{k['hi']})*")
        self.words = re.compile(f"{k['hi']}+")

    def encode(self, s: str) -> bytes | None:
        try:
            return bytes([self.back[c] for c in s])
        except KeyError:
            return None


DECODERS = {
    "cp1252": Decoder("cp1252", "cp1252", "latin-1"),
    "mac_roman": Decoder("mac_roman", "mac_roman"),
    "cp850": Decoder("cp850", "cp850"),
    "cp437": Decoder("cp437", "cp437"),
    "cp1251": Decoder("cp1251", "cp1251"),
    "koi8_r": Decoder("koi8_r", "koi8_r"),
}
#: whose signs are letters of words in their own right: what they decode to has to be known
CYRILLIC_DECODERS = ("cp1251", "koi8_r")
#: (wrong decoder, true encoding) where both are legacy encodings
LEGACY = [("cp1252", "gbk"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r")]
_HAN = re.compile("[‐-♂　-ヿ㄀-ㄯ㈀-㏿一-鿿-︰-￥�]+")
_FOREIGN = re.compile(r"[^\x00-\x7f]{2,}")
_BROKEN = re.compile("[�\x80-\x9f]")
_WORD = re.compile(r"[^\W\d_]+")
#: a no-break space that was garbled with its lead byte and then became an ordinary blank
_LOST_BLANK = re.compile("[ÃÂ](?=[ \n])")


class LanguageModel:
    """Per-language zstandard dictionaries and alphabets; picklable, opened lazily on each worker."""

    def __init__(self, dictionaries: dict[str, bytes], alphabets: dict[str, frozenset[str]], words: dict[str, frozenset[str]]) -> None:
        self.dictionaries, self.alphabets, self.words = dictionaries, alphabets, words
        self.everywhere = frozenset().union(*alphabets.values()) if alphabets else frozenset()
        self.all_words = frozenset().union(*words.values()) if words else frozenset()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def _compressor(self, lang: str):
        opened = self.__dict__.setdefault("_open", {})
        if lang not in opened:
            data = self.dictionaries.get(lang)
            kind = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
            opened[lang] = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False, **kind)
        return opened[lang]

    def size(self, text: str, lang: str) -> int:
        return len(self._compressor(lang).compress(text.encode("utf-8", "surrogatepass")))

    def length(self, text: str, lang: str) -> float:
        """Description length in bytes."""
        cost = float(self.size(text, lang))
        if not text.isascii():
            own = self.alphabets.get(lang, frozenset())
            for c in text:
                if c > "\x7f" and c not in own:
                    cost += UNSEEN_ELSEWHERE if c in self.everywhere else UNSEEN
        return cost

    def plausible(self, text: str, any_letter: bool = False) -> bool:
        """No code point that is unassigned or private, and, unless ``any_letter`` leaves them to their price, no letter that no language knows."""
        for c in text:
            if c > "\x7f" and c not in self.everywhere and not "一" <= c <= "鿿":
                kind = unicodedata.category(c)
                if kind in ("Cn", "Co", "Cs", "Cc", "Mn", "Lm") or kind[0] == "L" and self.everywhere and not any_letter:
                    return False
        return True


TEXTS, LETTERS, WORDS, PIECE = "texts", "letters", "words", "pieces"  # what is counted, by language


class Counts:
    """What texts show, by language: texts and their pieces, texts with a letter, texts with a word that isn't ASCII, each piece."""

    def __init__(self) -> None:
        self.of: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, lang: str, text: str) -> None:
        signs, words = set(text), text.split()
        pieces = _pieces(words, max(signs))
        self.of[lang, PIECE].update(pieces)
        self.of[lang, TEXTS].update({"": 1, PIECE: len(pieces)})
        if not text.isascii():
            self.of[lang, LETTERS].update(c for c in signs if c > "\x7f")
            # of other words nothing is asked
            self.of[lang, WORDS].update(_foreign_words(words))

    def __len__(self) -> int:
        return sum(map(len, self.of.values()))

    def rows(self) -> list[tuple[str, str, str, int]]:
        return [(lang, kind, item, n) for (lang, kind), counts in self.of.items() for item, n in counts.items()]


def _foreign_words(words: list[str]) -> set[str]:
    """The words that aren't ASCII, of a text that was split at blanks."""
    return {w for w in set(_WORD.findall(" ".join(w for w in set(words) if not w.isascii()).lower())) if not w.isascii()}


def _pieces(words: list[str], top: str) -> list[str]:
    """Every word; of one over ``LONG`` or in a script without blanks every window, or stretches if it is ASCII."""
    if top < "⺀" and max(map(len, words), default=0) <= LONG:
        return words
    out = []
    for w in words:
        if len(w) > LONG or max(w) >= "⺀":
            width, step = (LONG, LONG) if w.isascii() else (WINDOW, 1)
            out += [w[i : i + width] for i in range(0, max(1, len(w) - width + step), step)]
        else:
            out.append(w)
    return out


def _least(kind: str, texts: int, pieces: int, rows: int, words: int) -> tuple[int, int]:
    """How often an item must have been counted to be part of a model, and a Han sign."""
    if kind == PIECE:
        n = max(1, -(-pieces // PIECES))
        return n, n
    if kind == WORDS:
        n = max(2, -(-texts // words))
        return n, n
    two = min(2, texts)
    return max(two, -(-texts // rows)), max(two, -(-texts // (2 * rows)))


def _han(c: str) -> bool:
    return "一" <= c <= "鿿"


def _totals(rows: list[tuple[str, str, str, int]]) -> dict[str, tuple[int, int]]:
    """Language -> texts and pieces, of languages with any text."""
    n = {(lang, item): k for lang, _, item, k in rows}
    return {lang: (n[lang, ""], n.get((lang, PIECE), 0)) for lang, item in sorted(n) if item == "" and n[lang, ""] > 0}


def _model(totals: dict[str, tuple[int, int]], rows: list[tuple[str, str, str, int]]) -> LanguageModel:
    """The model of items that are counted often enough."""
    by: dict[tuple[str, str], list[tuple[int, str]]] = defaultdict(list)
    for lang, kind, item, n in rows:
        by[lang, kind].append((n, item))
    dictionaries, alphabets, words = {}, {}, {}
    for lang, (_, total) in totals.items():
        pieces = [p for n, item in sorted(by[lang, PIECE]) for p in [f" {item}".encode("utf-8", "surrogatepass") if item < "⺀" else item.encode("utf-8", "surrogatepass")] * max(1, round(n * PIECES / max(total, PIECES)))]
        try:
            dictionaries[lang] = zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: its words serve as the dictionary's content
            dictionaries[lang] = b"".join(pieces)[-DICT_BYTES:] or lang.encode() * 8
        alphabets[lang] = frozenset(x for _, c in by[lang, LETTERS] for x in (c, *c.upper(), *c.lower()) if x > "\x7f")  # capitals are rare
        words[lang] = frozenset(w for _, w in by[lang, WORDS])
    return LanguageModel(dictionaries, alphabets, words)


def _frequent(rows: list[tuple[str, str, str, int]], words: int) -> LanguageModel:
    totals = _totals([r for r in rows if r[1] == TEXTS])
    return _model(totals, [r for r in rows if r[1] != TEXTS and r[0] in totals and r[3] >= _least(r[1], *totals[r[0]], ROWS, words)[r[1] == LETTERS and _han(r[2])]])


def _sound(text: str) -> bool:
    return not _BROKEN.search(text) and not any(_strict(text))


def train(rows: list[tuple[str | None, str | None]]) -> LanguageModel:
    """The model of all (language, text) rows but those that a model of the sound ones would change. ``fit`` gives the same for a table."""
    rows = [(lang, t) for lang, t in rows if lang and t]

    def counted(rows: list[tuple[str, str]], words: int) -> LanguageModel:
        counts = Counts()
        for lang, t in rows:
            counts.add(lang, t)
        return _frequent(counts.rows(), words)

    first = counted([(lang, t) for lang, t in rows if _sound(t)] or rows, FIRST_WORDS)
    clean = [(lang, t) for lang, t in rows if not changes(t, lang, first)]
    return counted(clean, WORDS_OF) if clean else first


@lru_cache(maxsize=1)
def _paired(text: str) -> frozenset[str]:
    """The decoders that may have made a part of the text: it is asked more than once."""
    runs = " ".join(_FOREIGN.findall(text))
    chars = set(runs)
    return frozenset(d.name for d in DECODERS.values() if chars & d.leads and d.pair.search(runs))


def _strict(text: str) -> Iterator[str]:
    """Sure signs of UTF-8 read by another decoder: used only to keep them out of the first counts."""
    if not text.isascii():
        paired = _paired(text)
        for d in (DECODERS["cp1252"], DECODERS["mac_roman"], DECODERS["cp850"], DECODERS["cp1251"]):
            if d.name in paired:
                hits = d.utf8.findall(text)
                if len(hits) > 1 or any(len(h) > 3 for h in hits):
                    yield d.name


def _utf8_regions(text: str, d: Decoder, model: LanguageModel) -> list[tuple[int, int, str]]:
    out = []
    for m in d.utf8.finditer(text):
        try:
            new = d.encode(m.group()).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if model.plausible(new, d.name not in CYRILLIC_DECODERS) or d.name == "cp1252" and _utf8_like(new, d):
            out.append((m.start(), m.end(), new))
    return out


def _utf8_like(text: str, d: Decoder) -> bool:
    """Still UTF-8 read by the same decoder: the inner layer of a double mistake."""
    return any(m.end() - m.start() == len(text) for m in d.utf8.finditer(text)) or all(c in d.high for c in text)


def _to_utf8_from_gbk(s: str) -> str:
    return b"".join(b"\xff" if c == "�" else c.encode("gb18030") for c in s).decode("utf-8", "replace")


def _gbk_regions(text: str, seen: frozenset[str]) -> list[tuple[int, int, str]]:
    """UTF-8 read as GBK: pairs of bytes became Han characters; odd bytes were lost or took the next ASCII one.

    A run is cut to what reaches from its first to its last character that the language doesn't know,
    give or take two, whichever loses fewest bytes.
    """
    out = []
    for m in _HAN.finditer(text):
        run, base = m.group(), m.start()
        odd = [i for i, c in enumerate(run) if c not in seen]
        if not odd:
            continue
        best = None
        for a in {max(0, odd[0] - k) for k in range(3)}:
            for b in {min(len(run), odd[-1] + 1 + k) for k in range(3)}:
                new = _to_utf8_from_gbk(run[a:b])
                lost = new.count("�")
                if lost * 2 <= len(new) and (best is None or (lost, b - a) < best[0]):
                    best = (lost, b - a), (base + a, base + b, new)
        if best:
            out.append(best[1])
    return out


def _legacy_regions(text: str, d: Decoder, true: str, model: LanguageModel) -> list[tuple[int, int, str]]:
    out = []
    for m in (d.words if true == "gbk" else d.run).finditer(text):
        if true != "gbk" and (text[m.start() - 1 : m.start()].isascii() and text[m.start() - 1 : m.start()].isalpha() or text[m.end() : m.end() + 1].isascii() and text[m.end() : m.end() + 1].isalpha()):
            continue  # half a word in another alphabet
        raw = b"".join(c.encode() if c == " " else bytes([d.back[c]]) for c in m.group())
        try:
            s = raw.decode(true)
        except UnicodeDecodeError:
            continue
        if s != m.group() and model.plausible(s) and any(map(str.isalpha, s)):
            out.append((m.start(), m.end(), s))
    return out


def _merge(text: str, hits: list[tuple[int, int, str]]) -> list[list[tuple[int, int, str]]]:
    """Hits whose margins touch are priced together."""
    groups: list[list[tuple[int, int, str]]] = []
    for h in hits:
        if groups and h[0] - groups[-1][-1][1] <= 2 * MARGIN:
            groups[-1].append(h)
        else:
            groups.append([h])
    return groups


def _apply(text: str, hits: list[tuple[int, int, str]], a: int, b: int) -> str:
    parts, at = [], a
    for s, e, new in hits:
        parts += [text[at:s], new]
        at = e
    return "".join(parts) + text[at:b]


def _price(text: str, hits: list[tuple[int, int, str]], model: LanguageModel, langs: list[str], fold: bool = False) -> tuple[float, list[tuple[int, int, str]]]:
    """Bytes saved by the stretches that save any, and those stretches. ``fold``: letter case, which some decoders swap, is left out of it."""
    saved, kept = 0.0, []

    def shorter(old: str, new: str) -> float:
        if fold:
            old, new = old.lower(), new.lower()
        return min(model.length(old, x) for x in langs) - min(model.length(new, x) for x in langs)

    for group in _merge(text, hits):
        a, b = max(0, group[0][0] - MARGIN), min(len(text), group[-1][1] + MARGIN)
        gain = shorter(text[a:b], _apply(text, group, a, b))
        if gain > 0:
            saved += gain
            kept += group
        elif len(group) > 1:
            for h in group:
                a, b = max(0, h[0] - MARGIN), min(len(text), h[1] + MARGIN)
                gain = shorter(text[a:b], _apply(text, [h], a, b))
                if gain > 1:
                    saved += gain
                    kept.append(h)
    return saved, kept


def _candidates(text: str, model: LanguageModel, lang: str | None) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    chars = {c for c in set(text) if c > "\x7f"}
    paired = _paired(text)
    for d in DECODERS.values():
        if d.name in paired and (hits := _utf8_regions(text, d, model)):
            yield f"{d.name}>utf-8", hits
    seen = model.alphabets.get(lang, model.everywhere)
    known = model.words.get(lang, model.all_words)
    strange = chars - seen
    if any("一" <= c <= "鿿" for c in strange) and (hits := _gbk_regions(text, seen)):
        yield "gbk>utf-8", hits
    odd_words = None
    for wrong, true in LEGACY:
        d = DECODERS[wrong]
        if not chars & d.high or wrong == "cp1251" and not _cyrillic(text):
            continue
        if not strange & d.high:  # letters the language uses: only worth pricing if words are unknown
            if odd_words is None:
                odd_words = any(w not in known for w in _foreign_words(text.split()))
            if not odd_words:
                continue
        if hits := _legacy_regions(text, d, true, model):
            if strange & d.high:
                yield f"{wrong}>{true}", hits
            if true != "gbk" and (words := _by_word(text, hits, known)):
                yield f"{wrong}>{true}", words
    if "Ã" in chars or "Â" in chars:
        hits = [(m.start(), m.end() + (m.group() == "Â"), "à" if m.group() == "Ã" else "\xa0") for m in _LOST_BLANK.finditer(text)]
        if hits:
            yield "cp1252>utf-8 (blank lost)", hits


def _cyrillic(text: str) -> bool:
    """A good part of the letters is Cyrillic: single ones may only look like Latin letters."""
    raw = text.encode("utf-8", "surrogatepass")
    cyrillic = len(raw) - len(raw.translate(None, b"\xd0\xd1\xd2\xd3"))  # the first bytes of U+0400 to U+04FF
    return cyrillic > 0 and (4 * cyrillic > len(text) or 4 * cyrillic > sum(map(str.isalpha, text)))


def _by_word(text: str, hits: list[tuple[int, int, str]], known: frozenset[str]) -> list[tuple[int, int, str]]:
    """Cuts runs to their unknown words that become known, when the run mixes sound and garbled words."""
    out = []
    for s, e, new in hits:
        at = s
        for old_word, new_word in zip(text[s:e].split(" "), new.split(" "), strict=True):
            bare = new_word.lower().strip("«»„“”.,:;!?()—–-")
            if old_word.lower() not in known and (bare in known or not _WORD.search(old_word)):
                out.append((at, at + len(old_word), new_word))
            at += len(old_word) + 1
    return out


def _savings(text: str, lang: str | None, langs: list[str], model: LanguageModel) -> Iterator[tuple[float, str, list[tuple[int, int, str]]]]:
    """Bytes that each candidate saves, its name included."""
    for name, hits in _candidates(text, model, lang):
        saved, kept = _price(text, hits, model, langs, fold=name not in CHAIN_COST)
        yield saved - CHAIN_COST.get(name, LEGACY_COST), name, kept


def _asked(lang: str | None, model: LanguageModel) -> tuple[str | None, list[str]]:
    lang = lang if lang in model.dictionaries else None
    return lang, [lang] if lang else list(model.dictionaries) or [""]


def inspect(text: str | None, lang: str | None, model: LanguageModel) -> tuple[str | None, str, bool]:
    """(restored text, chain, garbled)."""
    if not text or text.isascii():
        return text, "", False
    lang, langs = _asked(lang, model)
    chain: list[str] = []
    broken = bool(_BROKEN.search(text))
    for _ in range(ROUNDS):
        best: tuple[float, str, list] = max(_savings(text, lang, langs, model), key=lambda x: x[0], default=(0.0, "", []))
        if best[0] <= 0:
            break
        text = _apply(text, sorted(best[2]), 0, len(text))
        chain.append(best[1])
    return text, " | ".join(chain), broken or bool(chain)


def changes(text: str, lang: str | None, model: LanguageModel) -> bool:
    """Whether ``inspect`` calls the text garbled."""
    return not text.isascii() and (bool(_BROKEN.search(text)) or any(x[0] > 0 for x in _savings(text, *_asked(lang, model), model)))


# --- Spark ---


COUNTED = "lang string, kind string, item string, n long"


def _counted(df: DataFrame, only_sound: bool, first: LanguageModel | None = None, flush: int = FLUSH) -> DataFrame:
    """Counts over (lang, text), partial ones; with ``first`` what to add to them: the texts it leaves that weren't counted, less those it would change that were."""
    shared = df.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, more, less = shared.value, Counts(), Counts()

        def hand_on() -> Iterator[pa.RecordBatch]:
            for counts, sign in ((more, 1), (less, -1)):
                for (lang, kind), of in counts.of.items():
                    n = len(of)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(kind, n), pa.array(of.keys(), pa.string(), size=n), pa.array([sign * k for k in of.values()], pa.int64())], names=["lang", "kind", "item", "n"])
            more.of.clear()
            less.of.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counted = not only_sound or _sound(text)
                wanted = counted if model is None else not changes(text, lang, model)
                if wanted != (counted and model is not None):
                    (more if wanted else less).add(lang, text)
                    if len(more) + len(less) > flush:
                        yield from hand_on()
        yield from hand_on()

    return df.mapInArrow(run, COUNTED)


def _known(counts: DataFrame, letters: int, words: int) -> tuple[dict[str, tuple[int, int]], LanguageModel]:
    """Texts and pieces by language, and the model of what is counted often enough: the driver sees that only."""
    totals = _totals([tuple(r) for r in collect_bounded(counts.where(F.col("kind") == TEXTS).select("lang", "kind", "item", "n"), 2 * LANGUAGES, "numbers of texts")])
    if not totals:
        return totals, _model(totals, [])
    least = [(lang, kind, *_least(kind, *n, letters, words)) for lang, n in totals.items() for kind in (LETTERS, WORDS, PIECE)]
    bound = F.broadcast(counts.sparkSession.createDataFrame(least, "lang string, kind string, least long, least_han long"))
    han = (F.col("kind") == LETTERS) & F.col("item").between("一", "鿿")
    rows = counts.join(bound, ["lang", "kind"]).where(F.col("n") >= F.when(han, F.col("least_han")).otherwise(F.col("least"))).select("lang", "kind", "item", "n").collect()
    return totals, _model(totals, [tuple(r) for r in rows])


def fit(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS) -> LanguageModel:
    """The model of every labelled text but those that a model of the sound ones would change. A letter is known if one in ``rows`` texts shows it."""
    texts = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang <> '' and text <> ''")
    summed = lambda c: stored(c.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    for only_sound in (True, False):  # where no text is sound, all count
        counts = summed(_counted(texts, only_sound))
        totals, first = _known(counts, rows, FIRST_WORDS)
        if totals:
            break
        release(counts)
    else:
        return first
    changed = _counted(texts.where(F.col("text").rlike("[^\\x00-\\x7F]")), only_sound, first)
    whole = summed(counts.unionByName(changed))
    release(counts)
    totals, second = _known(whole, rows, WORDS_OF)
    release(whole)
    return second if totals else first


def repair(df: DataFrame, model: LanguageModel, text: str = "text", lang: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Adds garbled (boolean), restored_text and chain to every row. Names that clash with existing columns get a leading underscore."""
    spark = spark or df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = {}
    for want in ("garbled", "restored_text", "chain"):
        while want in (x.lower() for x in df.columns):
            want = "_" + want
        names[len(names)] = want
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.BooleanType()), T.StructField(names[1], T.StringType()), T.StructField(names[2], T.StringType())])
    at, lang_at = df.columns.index(text), df.columns.index(lang) if lang else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * len(texts)
            done = [inspect(t, x, m) for t, x in zip(texts, langs, strict=True)]
            cols = [*batch.columns, pa.array([d[2] for d in done], pa.bool_()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *names.values()])

    return df.mapInArrow(run, schema)


def judge(df: DataFrame, model: LanguageModel, text: str, lang: str | None, *keep: str) -> DataFrame:
    """Only the garbled rows. Plain ASCII and null texts are dropped before Python sees them, as they cannot be garbled."""
    cols = [*keep, text, *([lang] if lang and lang not in keep else [])]
    suspects = df.select(*cols).where(F.col(text).rlike("[^\\x00-\\x7F]"))
    return repair(suspects, model, text, lang).where("garbled")
