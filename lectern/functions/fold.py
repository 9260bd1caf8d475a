"""Sequential semantics per key without Python: an ordered array and a fold over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "rows") -> DataFrame:
    """One row for each key with an array of (order..., columns...) structs in order. One exchange; a key is
    one recording, clip or episode, so the array is bounded by what one of those holds."""
    fields = [*order, *[c for c in columns if c not in order]]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def fold(rows: Column, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    return F.aggregate(rows, start, step, finish) if finish else F.aggregate(rows, start, step)


def made_once(df: DataFrame, name: str, made: Column) -> DataFrame:
    """df with a column that is computed once a row. A generator of one row keeps it apart from later steps: merged into
    them, what a lambda looks into would be computed again for each element."""
    return df.select("*", F.explode(F.array(made)).alias(name))


def running_max(values: Column) -> Column:
    """The largest value up to each position, in rounds that double how far back they reach."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    back = lambda acc, i, k: F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda x, i: F.greatest(x, back(acc, i, k))))


def rank_of(size: Column, at: Callable[[Column], Column], x: Column) -> Column:
    """How many of the positions 0 .. size - 1 hold at most x, where at(i) never falls with i: a search by halves."""
    powers = F.transform(F.sequence(F.ceil(F.log2(size + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))

    def step(low: Column, p: Column) -> Column:
        return F.when((low + p <= size) & (at(low + p - 1) <= x), low + p).otherwise(low)

    return F.aggregate(powers, F.lit(0), step)


def first_above(size: Column, at: Callable[[Column], Column], top: Callable[[Column], Column], i: Column, x: Column) -> Column:
    """The first position behind i that holds more than x, else size. top(i) is the maximum of at up to i. Where a
    position up to i holds more than x already, which sorted rows do not have, those behind i are looked through."""
    rest = F.when(i + 1 < size, F.sequence(i + 1, size - 1)).otherwise(F.array().cast("array<int>"))
    looked = F.coalesce(F.array_min(F.filter(rest, lambda j: at(j) > x)), size)
    return F.when(top(i) <= x, rank_of(size, top, x)).otherwise(looked)


def walk(jumps: Column, size: Column) -> Column:
    """The positions visited from 0 on, where jumps[i] > i is the one after i and size the end. Each round doubles the
    visited positions and the length of a jump, so the rounds grow with the logarithm of the walk."""
    empty = F.array().cast("array<int>")

    def step(acc: Column, _: Column) -> Column:
        over = F.element_at(acc["seen"], -1) >= size
        leap = lambda x: F.when(x >= size, size).otherwise(F.get(acc["jumps"], x))
        onward = F.struct(F.concat(acc["seen"], F.transform(acc["seen"], leap)).alias("seen"), F.transform(acc["jumps"], leap).alias("jumps"))
        return F.when(over, acc).otherwise(onward)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    start = F.struct(F.array(F.lit(0)).alias("seen"), F.transform(jumps, lambda x: x.cast("int")).alias("jumps"))
    found = F.aggregate(rounds, start, step, lambda acc: F.filter(acc["seen"], lambda x: x < size))
    return F.when(size > 0, found).otherwise(empty)
