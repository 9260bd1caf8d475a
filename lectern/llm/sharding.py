"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form an indivisible group. Groups enter shards from the largest to the
smallest, each into the tightest one with room, found in a balanced tree of remaining capacities.
Groups of one size class are interchangeable, so a histogram of classes stands for all groups: sizes
are rounded up to eleven significant bits, which bounds the classes (1024 for each power of two)
whatever the input's size. The least capacity that needs no more shards than asked for is found by
bisection; it keeps the shards' sizes near equal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_skewed, materialize, salted_rank

SHARDS = 24
PRECISION = 10
#: Capacities tried, as parts of the mean size above it.
TRIES = 24


class CapacityTree:
    """Ordered set of (remaining capacity, bin) as an AA tree: insert, remove and ceiling in O(log n)."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self, keys=()):
        self.root = None
        for k in keys:
            self.add(k)

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            left = t.left
            t.left, left.right = left.right, t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.level == t.right.right.level:
            right = t.right
            t.right, right.left = right.left, t
            right.level += 1
            return right
        return t

    def add(self, key) -> None:
        def put(t):
            if t is None:
                return self._Node(key)
            if key < t.key:
                t.left = put(t.left)
            elif key > t.key:
                t.right = put(t.right)
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def drop(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = drop(t.left, key)
            elif key > t.key:
                t.right = drop(t.right, key)
            elif t.left is None:
                return t.right
            elif t.right is None:
                return t.left
            else:
                least = t.right
                while least.left:
                    least = least.left
                t.key = least.key
                t.right = drop(t.right, least.key)
            floor = 1 + min(t.left.level if t.left else 0, t.right.level if t.right else 0)
            if floor < t.level:
                t.level = floor
                if t.right and t.right.level > floor:
                    t.right.level = floor
            t = self._skew(t)
            t.right = self._skew(t.right)
            if t.right:
                t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self.root = drop(self.root, key)

    def ceiling(self, key):
        """The least element not below key, or None."""
        t, found = self.root, None
        while t:
            if t.key >= key:
                found, t = t.key, t.left
            else:
                t = t.right
        return found


def best_fit(classes: list[tuple[int, int]], bins: int, capacity: int) -> list[tuple[int, int, int]] | None:
    """(size, count) from the largest -> (size, bin, how many), or None if some group fits nowhere.

    A run of equal sizes goes to the tightest bin as often as it fits, then to the next."""
    tree = CapacityTree((capacity, b) for b in range(bins))
    out = []
    for size, count in classes:
        while count:
            room = tree.ceiling((size, -1))
            if room is None:
                return None
            tree.remove(room)
            n = min(count, room[0] // size)
            out.append((size, room[1], n))
            count -= n
            tree.add((room[0] - n * size, room[1]))
    return out


def assign(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """The best-fit-decreasing packing of the least capacity found that needs no more than `bins` bins.

    A group above the mean of what is left stands alone in one of the last bins, so that it doesn't lift the
    capacity of the others; the rest is packed into the bins before."""
    classes = sorted(classes, reverse=True)
    total = sum(s * n for s, n in classes)
    alone: list[tuple[int, int, int]] = []
    while classes and classes[0][0] * bins > total:
        size, count = classes.pop(0)
        if count > 1:
            classes.insert(0, (size, count - 1))
        bins, total = bins - 1, total - size
        alone.append((size, bins, 1))
    if not classes:
        return alone
    low = max(-(-total // bins), classes[0][0])
    high, packed = low, best_fit(classes, bins, low)
    while packed is None:
        high += max(1, high // 1000)
        packed = best_fit(classes, bins, high)
    for _ in range(TRIES):
        if high - low <= 1:
            break
        middle = (low + high) // 2
        tried = best_fit(classes, bins, middle)
        low, high, packed = (middle, high, packed) if tried is None else (low, middle, tried)
    return alone + packed


def size_class(size) -> F.Column:
    """size rounded up to PRECISION + 1 significant bits, in whole numbers."""
    drop = F.greatest(F.length(F.bin(size)) - (PRECISION + 1), F.lit(0))
    unit = F.expr("1L").cast("long")
    step = F.call_function("shiftleft", unit, drop)
    return (F.ceil(size / step) * step).cast("long")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, shard, slot, a row for each row of docs.

    size: UTF-8 bytes and 8 for framing; null counts as the empty text. Equal texts share a shard; repeated rows
    are rows like any other. Other columns of docs are left out, whatever their names.
    slot numbers a shard's rows from 0 without gaps. A group above the mean of what remains fills a shard of
    its own, which then stands above the others (groups are never divided); the others' sizes stay near equal."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_group"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    groups = materialize(groups.select("_group", size_class(F.col("_bytes")).alias("_class"), "_n"), "groups")
    # A row for each class, of which there are 1024 for each power of two at most.
    classes = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("rows")).collect()
    histogram, total = [(r["_class"], r["n"]) for r in classes], sum(r["rows"] for r in classes)
    runs: dict[int, list[tuple[int, int]]] = {}
    for size, bin_, n in assign(histogram, shards):
        runs.setdefault(size, []).append((n, bin_))
    ends = {k: (np.cumsum([n for n, _ in v]), np.array([b for _, b in v])) for k, v in runs.items()}
    shared = docs.sparkSession.sparkContext.broadcast(ends)  # at most `shards` runs for each class

    @F.pandas_udf("int")
    def bin_of(size: pd.Series, rank: pd.Series) -> pd.Series:
        k, r = size.to_numpy(), rank.to_numpy()
        out = np.zeros(len(k), np.int32)
        for one in np.unique(k):
            at = np.flatnonzero(k == one)
            end, bins = shared.value[int(one)]
            out[at] = bins[np.searchsorted(end, r[at], "right")]
        return pd.Series(out)

    placed = salted_rank(groups, ["_class"], ["_group"], "_rank", sum(n for _, n in histogram))
    placed = materialize(placed.select("_group", "_n", bin_of("_class", "_rank").alias("shard")), "placed")
    # A text that very many rows share is not one task of the join.
    dealt = join_skewed(rows, placed, ["_group"], total).drop("_group")
    return salted_rank(dealt, ["shard"], ["_row"], "slot", total).select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
