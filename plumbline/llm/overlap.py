"""Long exact spans shared between records.

Method: sliding sentence spans, with one change. A shared span of 200 code points need not hold one whole sentence,
let alone several, so sentence ends alone cannot find every pair. The units are therefore stretches between
content-defined cuts: every position whose 8-gram has the least hash of some window of 64 is a cut, a sentence end
counting as less than any other 8-gram. Cuts depend on nearby text only, so two copies of a span are cut alike, and
stretches end with their sentences wherever sentences are short. From each cut, the run of as many consecutive
stretches as make 60 code points is hashed. A span of 200 holds at least one whole run (the first cut comes within
64, a run ends within 60 + 64 more, 8 for the 8-gram), so joining equal hashes loses no pair.

Records of one text are one from here on: texts are told apart by a 128-bit digest, each distinct one gets a number of
its own, and their pairs are filled in at the end, so copies, even a third of all rows, are never hashed or compared.
Runs are hashed once and kept, and joined globally: counts by hash combine before the shuffle, hashes that a single
text has are dropped, and what is left meets its count in a join that AQE may split where a hash is hot. Runs that
occur up to ``HOT`` times give pairs directly, occurrence by occurrence, since a passage may stand twice in a text and
only its second place go on as in the other; those that occur more often (a boilerplate that a third of all rows may
share) are replaced by the hashes of all 200-grams around them. Texts with the same shared grams are one class; classes
meet by their grams, and only then are their texts paired, so that work follows the result. Around a run of length l, a
span of 200 goes on for half of 200 - l on one side at least, so pairs whose contexts differ on both sides are dropped
by a hash of each. A pair whose runs overlap along one diagonal for 200 code points is proven; for the rest the text
around the run, 200 to either side, is compared code point by code point, which settles that run exactly.

``classes`` gives one row for each record: its class of equal texts and how many other classes it shares a span with;
``class_pairs`` those links, without expanding copies.

``shares`` and ``cleaned`` never pair the texts of a hot run: every 200-gram that holds one meets its like, and the
places of those that another text has too are covered, so that work follows the text that is shared, however many
records share it. Pairs that meet by a run of few occurrences, at most ``HOT`` for each occurrence, are laid side by
side, and every place of every common 200-gram is covered. Every common span holds a run of one kind or the other, so
both together are the cover of all maximal common spans; copies are covered whole. ``cleaned`` leaves out what a
non-first repeated span covers.

Defined results: null texts and texts under the least length are left out; repeated rows of one id count once, and a
repeat inside one record is no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ranking import cut
from plumbline.operators.lineage import release, stored

LEAST = 200
GRAM, WINDOW, RUN = 8, 64, 60
BLOCK = 400_000  # code points hashed at a time
HOT = 48  # occurrences of one run above which pairs are made from 200-grams only
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_ENDS = np.array([ord(c) for c in ".!?。！？\n"], np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every window of ``width``, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``, kept by the worker."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers = both[0], both[1]
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Hashed:
    """Code points of a text, or of several on end, and the hash of any substring in constant time."""

    def __init__(self, text: str) -> None:
        self.cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.cp)
        powers, self.back = _power_table(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(self.cp.astype(np.uint64) + _SEED) * powers[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))

    def cuts(self) -> np.ndarray:
        n = len(self.cp) - GRAM + 1
        if n < WINDOW:
            return np.zeros(0, np.int64)
        at = np.arange(n)
        h = self.of(at, at + GRAM) | np.uint64(1 << 63)
        ends = np.isin(self.cp[:n], _ENDS)
        h[ends] &= np.uint64((1 << 63) - 1)
        least = _slide(h, WINDOW, np.minimum)
        pad = np.zeros(WINDOW - 1, np.uint64)
        chosen = _slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum)
        return np.nonzero(chosen[:n] == h)[0]

    def runs(self, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """(number of the text, hash, start, end, before, after) of the runs.

        Every occurrence counts, as a span may go on around any of them; of those with the same ``least`` code points
        on both sides the first stands for all, so that endless repetition gives few.

        ``ends``: where each text ends. Windows that reach into the next text only add cuts near a text's end, as any
        other surroundings of a shared span may.
        before, after: 32-bit hashes of what goes before and after a run, for half of what it lacks to ``least``; 0
        where the text ends sooner.
        """
        cuts = self.cuts()
        to = np.searchsorted(cuts, cuts + RUN)
        ok = to < len(cuts)
        a, b = cuts[ok], cuts[to[ok]]
        text = np.searchsorted(ends, a, side="right")
        starts = np.concatenate([[0], ends[:-1]])
        inside = b <= ends[text]
        a, b, text = a[inside], b[inside], text[inside]
        h = self.of(a, b).view(np.int64)
        left, right = self.of(np.maximum(a - least, starts[text]), a), self.of(b, np.minimum(b + least, ends[text]))
        by = np.lexsort((a, right, left, h, text))
        new = np.ones(len(by), bool)
        new[1:] = np.any([x[by][1:] != x[by][:-1] for x in (text, h, left, right)], axis=0)
        by = np.sort(by[new])
        a, b, text, h = a[by], b[by], text[by], h[by]
        far = (least - (b - a) + 1) // 2
        lo, hi = a - far, b + far
        before, after = ((self.of(x, y) >> np.uint64(33)).astype(np.int64) | 1 for x, y in ((np.maximum(lo, 0), a), (b, np.minimum(hi, len(self.cp)))))
        return text, h, a - starts[text], b - starts[text], np.where(lo >= starts[text], before, 0), np.where(hi <= ends[text], after, 0)

    def places(self, around: list[tuple[int, int]], size: int) -> np.ndarray:
        """Where the ``size``-grams begin that hold one of the ranges."""
        n = len(self.cp) - size + 1
        wanted = np.zeros(max(0, n) + 1, np.int32)
        for a, b in around:
            lo, hi = max(0, b - size), min(a, n - 1)
            if lo <= hi:
                wanted[lo] += 1
                wanted[hi + 1] -= 1
        return np.nonzero(np.cumsum(wanted)[:-1] > 0)[0]

    def grams(self, around: list[tuple[int, int]], size: int) -> np.ndarray:
        """Distinct hashes of the ``size``-grams that hold one of the ranges."""
        at = self.places(around, size)
        return np.unique(self.of(at, at + size).view(np.int64))


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("rec").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size < BLOCK or to == at):
                    size += len(texts[to])
                    to += 1
                ends = np.cumsum([len(t) for t in texts[at:to]])
                which, h, *rest = Hashed("".join(texts[at:to])).runs(ends, least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][which]), pa.array(h), *[pa.array(c.astype(np.int32)) for c in rest]], names=["rec", "h", "a", "b", "before", "after"])
                at = to

    return run


def _texts(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("rec"), F.col(text).alias("text")).where(F.col("rec").isNotNull() & (F.length("text") >= least))


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, text: each distinct text and its number; t, rec: the records that have it). Both are kept: numbers are given once."""
    digest = F.unhex(F.md5("text")).alias("digest")
    once = stored(rows.select(digest, "text").groupBy("digest").agg(F.first("text").alias("text")).withColumn("t", F.monotonically_increasing_id()))
    holders = rows.select(digest, "rec").distinct().join(once.select("digest", "t"), "digest").select("t", "rec")
    return once.select(F.col("t").alias("rec"), "text"), cut(holders)


def _shared(texts: DataFrame, least: int) -> DataFrame:
    """rec, h, a, b, before, after, n: the runs whose hash more than one text has, and how often it occurs. Kept, as several joins read it.

    ``texts`` are distinct. Counts by hash are combined before they are shuffled, and the join is free to split a hot hash.
    """
    runs = stored(texts.mapInArrow(_runs(least), "rec long, h long, a int, b int, before int, after int"))
    shared = runs.groupBy("h").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n")
    out = cut(runs.join(shared, "h"))
    release(runs)
    return out


def shared_runs(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """rec, h, a, b, before, after of every run that another text has too; rec is one of the records of the text."""
    texts, holders = _distinct(_texts(df, key, text, least))
    owner = holders.groupBy("t").agg(F.min("rec").alias("owner"))
    return _shared(texts, least).join(owner, F.col("rec") == F.col("t")).select(F.col("owner").alias("rec"), "h", "a", "b", "before", "after")


def _common(x: str, y: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _settle(least: int):
    """Whether the span around a common run reaches ``least``, by the text on either side of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda n: b.column(n).to_pylist()  # noqa: B023, E731
            keep = []
            for x, y, xa, ya, n in zip(col("near_a"), col("near_b"), col("left_a"), col("left_b"), col("length"), strict=True):
                same = x[xa : xa + n] == y[ya : ya + n]
                keep.append(same and n + _common(x[:xa][::-1], y[:ya][::-1]) + _common(x[xa + n :], y[ya + n :]) >= least)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("rec_a").filter(mask), b.column("rec_b").filter(mask)], names=["rec_a", "rec_b"])

    return run


def _look_up(least: int):
    """What is asked of a text: the surroundings of a run, or the grams that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        names = ["rec", "a", "left", "near", "g"]
        for b in batches:
            for i, t, wanted in zip(b.column("rec").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                rows = [(i, r["a"], min(r["a"], least), t[max(0, r["a"] - least) : r["b"] + least], None) for r in wanted if not r["hot"]]
                if hot := [(r["a"], r["b"]) for r in wanted if r["hot"]]:
                    rows += [(i, None, None, None, g) for g in Hashed(t).grams(hot, least).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _by_few(texts: DataFrame, runs: DataFrame, least: int, hot: int, grams: bool) -> tuple[DataFrame, DataFrame]:
    """(t_a, t_b: each two texts whose common span holds a run of few occurrences, both ways round or not; rec, g: the grams around the hot runs, if they are asked for)"""
    # runs of few occurrences: the pairs within each, by diagonal
    groups = runs.where(F.col("n") <= hot).groupBy("h").agg(F.array_sort(F.collect_set(F.struct("rec", "a", "b", "before", "after"))).alias("at"))
    left = groups.select(F.posexplode("at").alias("i", "x"), "at")
    both = left.select("x", F.explode(F.slice("at", F.col("i") + 2, F.size("at"))).alias("y")).where("x.rec < y.rec and (x.before = y.before and x.before <> 0 or x.after = y.after and x.after <> 0)")
    diagonal = both.groupBy(F.col("x.rec").alias("rec_a"), F.col("y.rec").alias("rec_b"), (F.col("x.a") - F.col("y.a")).alias("d")).agg(F.array_sort(F.collect_set(F.struct(F.col("x.a").alias("a"), F.col("x.b").alias("b")))).alias("at"))
    # the longest chain of overlapping runs along the diagonal
    start = F.struct(F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.lit(0).alias("best"))

    def step(s, r):
        on = r["a"] <= s["to"]
        a, b = F.when(on, s["from"]).otherwise(r["a"]), F.greatest(s["to"], r["b"])
        return F.struct(a.alias("from"), b.alias("to"), F.greatest(s["best"], b - a).alias("best"))

    chained = diagonal.withColumn("best", F.aggregate("at", start, step, lambda s: s["best"]))
    judged = cut(chained.groupBy("rec_a", "rec_b").agg(F.max("best").alias("best"), F.collect_list(F.struct("d", "at")).alias("lines")))
    proven = judged.where(F.col("best") >= least).select("rec_a", "rec_b")
    open_ = judged.where(F.col("best") < least).select("rec_a", "rec_b", F.explode("lines").alias("l")).select("rec_a", "rec_b", "l.d", F.explode("l.at").alias("r")).select("rec_a", "rec_b", F.col("r.a").alias("a"), F.col("r.b").alias("b"), (F.col("r.a") - F.col("d")).alias("a2"), (F.col("r.b") - F.col("d")).alias("b2"))
    # one reading of the texts for all that is asked of them
    cold = F.lit(False).alias("hot")
    asked = open_.select(F.col("rec_a").alias("rec"), "a", "b", cold).union(open_.select("rec_b", "a2", "b2", cold))
    if grams:
        asked = asked.union(runs.where(F.col("n") > hot).select("rec", "a", "b", F.lit(True)))
    wanted = asked.groupBy("rec").agg(F.collect_set(F.struct("a", "b", "hot")).alias("wanted"))
    answers = cut(texts.join(wanted, "rec").mapInArrow(_look_up(least), "rec long, a int, left int, near string, g long").distinct())
    near = answers.where("near is not null").select("rec", "a", "left", "near")
    one = near.select(F.col("rec").alias("rec_a"), "a", F.col("left").alias("left_a"), F.col("near").alias("near_a"))
    two = near.select(F.col("rec").alias("rec_b"), F.col("a").alias("a2"), F.col("left").alias("left_b"), F.col("near").alias("near_b"))
    checked = open_.join(one, ["rec_a", "a"]).join(two, ["rec_b", "a2"]).withColumn("length", F.col("b") - F.col("a")).mapInArrow(_settle(least), "rec_a long, rec_b long")
    few = proven.union(checked).select(F.least("rec_a", "rec_b").alias("t_a"), F.greatest("rec_a", "rec_b").alias("t_b")).distinct()
    return few, answers.where("g is not null").select("rec", "g")


def _runs_of(texts: DataFrame, least: int) -> DataFrame:
    if least < WINDOW + RUN + WINDOW + GRAM:
        raise ValueError("runs are too long for spans that short")
    return _shared(texts, least)


def _text_pairs(texts: DataFrame, least: int, hot: int = HOT) -> DataFrame:
    """t_a, t_b: the numbers of each two different texts with a common span of at least ``least`` code points. ``texts``: see ``_distinct``."""
    few, grams = _by_few(texts, _runs_of(texts, least), least, hot, True)
    # runs of many occurrences: classes of equal grams
    twice = grams.groupBy("g").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("g")
    classed = cut(grams.join(twice, "g", "left_semi").groupBy("rec").agg(F.array_sort(F.collect_set("g")).alias("gs")).withColumn("c", F.xxhash64("gs")))
    member = classed.select("rec", "c")
    of_class = classed.groupBy("c").agg(F.first("gs").alias("gs")).select("c", F.explode("gs").alias("g"))
    meet = of_class.withColumnRenamed("c", "c_a").join(of_class.withColumnRenamed("c", "c_b"), "g").where("c_a < c_b").select("c_a", "c_b").distinct()
    left, right = member.select(F.col("rec").alias("rec_a"), F.col("c").alias("c_a")), member.select(F.col("rec").alias("rec_b"), F.col("c").alias("c_b"))
    within = left.join(right, F.col("c_a") == F.col("c_b")).where("rec_a < rec_b").select("rec_a", "rec_b")
    across = meet.join(left, "c_a").join(right, "c_b").select("rec_a", "rec_b")
    return few.toDF("rec_a", "rec_b").union(within).union(across).select(F.least("rec_a", "rec_b").alias("t_a"), F.greatest("rec_a", "rec_b").alias("t_b")).distinct()


def pairs(df: DataFrame, key: str, text: str, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """rec_a, rec_b: each pair of records with a common span of at least ``least`` code points."""
    texts, holders = _distinct(_texts(df, key, text, least))
    found = _text_pairs(texts, least, hot)
    # back to records: those of the two texts, and copies of one
    one, two = holders.select(F.col("t").alias("t_a"), F.col("rec").alias("x")), holders.select(F.col("t").alias("t_b"), F.col("rec").alias("y"))
    many = holders.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("t").alias("t_a"), F.col("t").alias("t_b"))
    both = found.union(many).join(one, "t_a").join(two, "t_b").where("x <> y")
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def _owners(holders: DataFrame) -> DataFrame:
    """t, owner, n: the first record of each text and how many have it."""
    return holders.groupBy("t").agg(F.min("rec").alias("owner"), F.count("*").alias("n"))


def class_pairs(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """class_a, class_b: each two classes of equal texts with a common span. A class is named by its first record."""
    texts, holders = _distinct(_texts(df, key, text, least))
    owners = _owners(holders).select("t", "owner")
    both = _text_pairs(texts, least).join(owners.toDF("t_a", "x"), "t_a").join(owners.toDF("t_b", "y"), "t_b")
    return both.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()


def classes(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """rec, class_id (the first record with that text), n_copies (records of the class), n_links (other classes with a common span): one row for each record and text of at least ``least``."""
    texts, holders = _distinct(_texts(df, key, text, least))
    found = cut(_text_pairs(texts, least))
    links = found.select(F.col("t_a").alias("t")).union(found.select("t_b")).groupBy("t").agg(F.count("*").alias("n_links"))
    out = holders.join(_owners(holders), "t").join(links, "t", "left")
    return out.select("rec", F.col("owner").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _gram_places(least: int):
    """Each ``least``-gram of a text that holds one of its shared runs: (t, hash, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, text, at in zip(b.column("rec").to_pylist(), b.column("text").to_pylist(), b.column("at").to_pylist(), strict=True):
                hashed = Hashed(text)
                where = hashed.places([(r["a"], r["b"]) for r in at], least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), t, np.int64)), pa.array(hashed.of(where, where + least).view(np.int64)), pa.array(where.astype(np.int32))], names=["t", "g", "a"])

    return run


def _common_ranges(least: int):
    """Where two texts are covered by their common spans of at least ``least``: both ways round."""

    def ranges(here: np.ndarray, there: np.ndarray) -> list[dict]:
        hit = np.concatenate([[False], np.isin(here, there), [False]])
        edge = np.nonzero(hit[1:] != hit[:-1])[0].tolist()
        return [{"a": x, "b": y - 1 + least} for x, y in zip(edge[::2], edge[1::2], strict=True)]  # starts of common grams from x to y

    def grams(t: str) -> np.ndarray:
        at = np.arange(len(t) - least + 1)
        return Hashed(t).of(at, at + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for b in batches:
            col = lambda n: b.column(n).to_pylist()  # noqa: B023, E731
            t, other, found = [], [], []
            for t_a, t_b, x, y in zip(col("t_a"), col("t_b"), col("x"), col("y"), strict=True):
                x, y = grams(x), grams(y)
                t += [t_a, t_b]
                other += [t_b, t_a]
                found += [ranges(x, y), ranges(y, x)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(other, pa.int64()), pa.array(found, at)], names=["t", "other", "at"])

    return run


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of a text's ranges, as ranges that don't meet, and its length."""
    at = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        ranges = []
        for given in batch.column("given").to_pylist():
            out: list[dict] = []
            for r in sorted(given, key=lambda r: r["a"]):
                if out and r["a"] <= out[-1]["b"]:
                    out[-1]["b"] = max(out[-1]["b"], r["b"])
                else:
                    out.append(r)
            ranges.append(out)
        total = [sum(r["b"] - r["a"] for r in x) for x in ranges]
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(ranges, at), pa.array(total, pa.int64())], names=["t", "at", "shared_chars"])


def _covered(texts: DataFrame, owners: DataFrame, least: int, earlier: bool, hot: int = HOT) -> DataFrame:
    """t, at, shared_chars: the ranges of each text that are in spans of at least ``least`` which another text has too; ``earlier``: one with an earlier first record.

    A text's places are at most its length, so the list of them is its own size.
    """
    runs, owner = _runs_of(texts, least), owners.select("t", "owner")
    few, _ = _by_few(texts, runs, least, hot, False)
    one, two = texts.toDF("t_a", "x"), texts.toDF("t_b", "y")
    beside = few.join(one, "t_a").join(two, "t_b").select("t_a", "t_b", "x", "y").mapInArrow(_common_ranges(least), "t long, other long, at array<struct<a: int, b: int>>")
    if earlier:
        beside = beside.join(owner, "t").join(owner.toDF("other", "other_owner"), "other").where("other_owner < owner")
    around = runs.where(F.col("n") > hot).groupBy("rec").agg(F.collect_set(F.struct("a", "b")).alias("at"))
    grams = stored(texts.join(around, "rec").select("rec", "text", "at").mapInArrow(_gram_places(least), "t long, g long, a int").join(owner, "t"))
    by = grams.groupBy("g").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("owner").alias("first")).where("lo <> hi").select("g", "first")
    kept = grams.join(by, "g").where(F.col("first") < F.col("owner") if earlier else F.lit(True))
    given = beside.select("t", F.explode("at").alias("r")).union(kept.select("t", F.struct(F.col("a"), (F.col("a") + least).alias("b"))))
    return given.groupBy("t").agg(F.collect_set("r").alias("given")).mapInArrow(_cover, "t long, at array<struct<a: int, b: int>>, shared_chars long")


def shares(df: DataFrame, key: str, text: str, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """rec, n_chars, shared_chars, shared_share: how much of each record lies in spans of at least ``least`` code points that other records have too. Records under ``least`` share nothing; empty and null texts have no row."""
    texts, holders = _distinct(_texts(df, key, text, least))
    owners = cut(_owners(holders))
    by_text = owners.join(_covered(texts, owners, least, False, hot), "t", "left").select("t", "n", "shared_chars")
    shared = holders.join(by_text, "t").select("rec", "n", "shared_chars")
    sizes = _texts(df, key, text, 1).select("rec", F.length("text").cast("long").alias("n_chars")).groupBy("rec").agg(F.max("n_chars").alias("n_chars"))
    out = sizes.join(shared.groupBy("rec").agg(F.max("n").alias("n"), F.max("shared_chars").alias("shared_chars")), "rec", "left")
    out = out.withColumn("shared_chars", F.when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)).cast("long")))
    return out.select("rec", "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 6).alias("shared_share"))


def cleaned(df: DataFrame, key: str, text: str, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """rec, text: each record without the stretches that a span of at least ``least`` code points covers which another, earlier record (lesser id) has too. A copy of an earlier record is empty."""
    texts, holders = _distinct(_texts(df, key, text, least))
    owners = cut(_owners(holders))
    cuts = _covered(texts, owners, least, True, hot).join(owners, "t").select(F.col("owner").alias("rec"), F.col("at").alias("cut"))
    copies = holders.join(owners.where("n > 1"), "t").where("owner < rec").select("rec", F.lit(True).alias("copy")).distinct()
    all_ = _texts(df, key, text, 0).dropDuplicates(["rec"]).join(cuts, "rec", "left").join(copies, "rec", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate("cut", start, lambda s, r: F.struct(F.greatest(s["at"], r["b"]).alias("at"), F.concat(s["out"], F.when(r["a"] > s["at"], F.col("text").substr(s["at"] + 1, r["a"] - s["at"])).otherwise("")).alias("out")), lambda s: F.concat(s["out"], F.col("text").substr(s["at"] + 1, F.length("text"))))
    return all_.select("rec", F.when(F.col("copy"), "").when(F.col("cut").isNull(), F.col("text")).otherwise(body).alias("text"))
