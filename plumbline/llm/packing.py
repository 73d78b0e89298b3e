"""Fill containers of a fixed capacity with items of varying length.

Method: exact-complement hashing over the histogram of lengths. Three indexes tell which sums single lengths, pairs and
triples of available lengths make, each one flag for each sum up to the capacity. For the largest length that is left,
the gap beside it is looked up: a single length that fills it exactly, else a pair, else a triple. What the index names
is found by its complement and checked against the counts, as lengths may have been used up since; after some misses
the index is made anew. A combination that fits is used as often as its counts allow, so the plan is a list of
(lengths, how often) and each step uses up a length. Lengths without an exact complement are filled by best fit. The
driver sees counts by length only, at most ``capacity`` of them, whatever the number of items, and refuses capacities
beyond ``MOST_CAPACITY``; items find their place by their rank among the items of their length.

Items longer than the capacity are split into full pieces and a rest; no other item is split. Defined results: items
of no length (null and empty texts) take no place and get a null container; repeated ids are items of their own;
capacities below 1 are refused.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ranking import cut, rank_within

MOST_CAPACITY = 1 << 20  # of all capacities together: bounds what the driver holds and how long it plans
MISSES = 16  # sums that the index named in vain before it is made anew


class Sums:
    """Which sums the available lengths make, as pairs and as triples. Lengths are only ever used up, so an old index names too many sums and never too few."""

    def __init__(self, there: np.ndarray) -> None:
        self.there, self.misses = there, MISSES

    def _make(self) -> None:
        size = len(self.there)
        flags = lambda n: np.unpackbits(np.frombuffer((n & mask).to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size].astype(bool)
        mask = (1 << size) - 1
        lengths = np.nonzero(self.there)[0].tolist()
        one = sum(1 << x for x in lengths) if len(lengths) < 64 else int.from_bytes(np.packbits(self.there, bitorder="little").tobytes(), "little")
        two = three = 0
        for x in lengths:
            two |= one << x
        two &= mask
        for x in lengths:
            three |= two << x
        self.two, self.three, self.misses = flags(two), flags(three), 0

    def names(self, gap: int, k: int) -> bool:
        if self.misses >= MISSES:
            self._make()
        return bool((self.two if k == 2 else self.three)[gap])

    def thirds(self, gap: int) -> list[int]:
        """Available lengths that leave the sum of a pair, the largest first."""
        x = np.arange(1, gap - 1)
        return x[self.there[1 : gap - 1] & self.two[gap - x]][::-1].tolist()


def _pair(counts: np.ndarray, there: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two available lengths that make ``gap``, the largest first, each looked up by the complement of the other. ``there``: which lengths are available."""
    if gap < 2:
        return None
    half = gap // 2
    ok = there[1 : half + 1] & there[gap - half : gap][::-1]  # lesser and larger length of each pair
    if gap % 2 == 0 and counts[half] < 2:
        ok[half - 1] = False
    i = int(np.argmax(ok))
    return (gap - i - 1, i + 1) if ok[i] else None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one container, number of such containers), for lengths of 1 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] += n
    there = counts > 0
    sums = Sums(there)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(size: int, n: int) -> None:
        counts[size] -= n
        there[size] = counts[size] > 0

    def pair(gap: int) -> tuple[int, ...] | None:
        if not sums.names(gap, 2):
            return None
        got = _pair(counts, there, gap)
        sums.misses += got is None
        return got

    def triple(gap: int) -> tuple[int, ...] | None:
        if not sums.names(gap, 3):
            return None
        for x in sums.thirds(gap):
            take(x, 1)
            got = _pair(counts, there, gap - x)
            take(x, -1)
            if got:
                return (x, *got)
        sums.misses += 1
        return None

    def best_fit(gap: int) -> tuple[int, ...]:
        """The largest that still fits, again and again."""
        got: list[int] = []
        while gap > 0 and len(left := np.nonzero(there[1 : gap + 1])[0]):
            x = int(left[-1]) + 1
            take(x, 1)
            got.append(x)
            gap -= x
        for x in got:
            take(x, -1)
        return tuple(got)

    for size in range(capacity, 0, -1):
        while counts[size]:
            take(size, 1)  # one is in hand
            gap = capacity - size
            if gap == 0:
                rest: tuple[int, ...] = ()
            elif there[gap]:
                rest = (gap,)
            else:
                rest = pair(gap) or triple(gap) or best_fit(gap)
            take(size, -1)
            lengths = (size, *rest)
            need: dict[int, int] = {}
            for x in lengths:
                need[x] = need.get(x, 0) + 1
            times = min(int(counts[x]) // k for x, k in need.items())
            for x, k in need.items():
                take(x, times * k)
            out.append((lengths, times))
    return out


def slots(plans: dict[str, list[tuple[tuple[int, ...], int]]]) -> dict[tuple[str, int], tuple[list[int], list[tuple[int, int, int, int]]]]:
    """(pack, length): the least rank of each slot, and its (least rank, first container, first place, items a container).

    A slot is one length of one combination. Combinations are at most as many as lengths, as each uses one up, and
    hold at most sqrt(2 x capacity) different ones, whatever the number of items; that bounds what is broadcast.
    """
    out: dict[tuple[str, int], tuple[list[int], list]] = {}
    for name, combinations in plans.items():
        first, used = 1, {}
        for lengths, times in combinations:
            base = 0
            for x, k in Counter(lengths).items():
                lows, rows = out.setdefault((name, x), ([], []))
                lows.append(used.get(x, 0))
                rows.append((used.get(x, 0), first, base, k))
                used[x] = used.get(x, 0) + times * k
                base += k
            first += times
    return out


def pack(items: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """pack_name, container (from 1), place (from 0), key, piece, n_tokens: one row for each piece of an item and capacity."""
    if not capacities or any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be at least 1")
    if sum(capacities.values()) > MOST_CAPACITY:
        raise ValueError(f"capacities are more than {MOST_CAPACITY} together")
    kinds = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(int(c)).cast("long").alias("capacity")) for n, c in sorted(capacities.items())])
    n = F.col("_size")
    rows = cut(items.select(F.col(key), F.col(size).cast("long").alias("_size")))
    whole = F.floor(n / F.col("capacity"))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(n / F.col("capacity")) - 1)), lambda i: F.struct(i.cast("int").alias("piece"), F.when(i < whole, F.col("capacity")).otherwise(n - whole * F.col("capacity")).alias("n_tokens")))
    each = rows.select(key, "_size", F.explode(kinds).alias("k")).select(key, "_size", "k.*").select("pack_name", key, F.explode(pieces).alias("p")).select("pack_name", key, "p.*").withColumn("_id", F.concat_ws("/", F.col(key).cast("string"), F.col("piece").cast("string")))
    fitting = each.where("n_tokens > 0")
    by_pack: dict[str, dict[int, int]] = {name: {} for name in capacities}
    for r in fitting.groupBy("pack_name", "n_tokens").agg(F.count("*").alias("n")).collect():  # at most the sum of the capacities
        by_pack[r["pack_name"]][r["n_tokens"]] = r["n"]
    shared = items.sparkSession.sparkContext.broadcast(slots({name: plan(h, capacities[name]) for name, h in by_pack.items()}))
    ranked = rank_within(fitting, ["pack_name", "n_tokens"], "_id").select("pack_name", "rank", key, "piece", "n_tokens")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, at = [], []
            for name, n, r in zip(b.column("pack_name").to_pylist(), b.column("n_tokens").to_pylist(), b.column("rank").to_pylist(), strict=True):
                lows, slot = shared.value[name, n]
                low, first, base, k = slot[bisect_right(lows, r) - 1]
                where.append(first + (r - low) // k)
                at.append(base + (r - low) % k)
            yield pa.RecordBatch.from_arrays([b.column("pack_name"), pa.array(where, pa.int64()), pa.array(at, pa.int32()), b.column(2), b.column("piece"), b.column("n_tokens")], names=["pack_name", "container", "place", key, "piece", "n_tokens"])

    empty = each.where("n_tokens = 0").select("pack_name", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"), key, "piece", "n_tokens")
    return ranked.mapInArrow(place, empty.schema).unionByName(empty)


def fills(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """pack_name, container, items, filled, room: the fill of each container."""
    capacity = F.create_map(*[x for n, c in sorted(capacities.items()) for x in (F.lit(n), F.lit(int(c)).cast("long"))])
    return packed.where("container is not null").groupBy("pack_name", "container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("filled")).withColumn("room", capacity[F.col("pack_name")] - F.col("filled"))


def summary(filled: DataFrame) -> DataFrame:
    """pack_name, containers, items, filled, room, fill_share."""
    return filled.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("filled").alias("filled"), F.sum("room").alias("room")).withColumn("fill_share", F.round(F.col("filled") / (F.col("filled") + F.col("room")), 6))
