"""Camera paths: how a crop window follows a face over one shot, as folds over the shot's arrays.

Positions are pixels, times milliseconds; the path has a point every GRID ms at most. A shot holds some hundred
samples, so its arrays are small; shots are the unit of work. Keyframes are found in rounds over a table of points."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import ordered, rank_of
from ..streaming.job_state import shared_folder

GRID = 100
FACE_SIGMA, PATH_SIGMA = 0.5, 0.3
SETTLE_STEPS, SETTLE_SHARE = 10, 0.03


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def _index(a: Column) -> Column:
    return F.sequence(F.lit(0), F.size(a) - 1)


def median(a: Column) -> Column:
    # Sorted once: an expression that is named twice is computed twice within a lambda.
    middle = lambda s: (_at(s, F.floor((F.size(s) - 1) / 2)) + _at(s, F.floor(F.size(s) / 2))) / 2
    return F.get(F.transform(F.array(F.array_sort(a)), middle), F.lit(0))


def running_median(a: Column, radius: Column) -> Column:
    """Median over up to radius neighbours to each side, as many as both sides have; at the ends of the value,
    its neighbour and the neighbour's mirror."""
    n = F.size(a)

    def value(i: Column) -> Column:
        m = F.least(radius, i, n - 1 - i)
        near = F.when(i == 0, _at(a, F.lit(1))).otherwise(_at(a, n - 2))
        far = F.when(i == 0, _at(a, F.lit(2))).otherwise(_at(a, n - 3))
        return F.when(m > 0, median(F.slice(a, i - m + 1, 2 * m + 1))).otherwise(median(F.array(_at(a, i), near, 2 * near - far)))

    return F.when((radius < 1) | (n < 3), a).otherwise(F.transform(_index(a), value))


def on_grid(times: Column, values: Column, start: Column, end: Column, steps: Column) -> Column:
    """Values at the ends of `steps` equal parts of start to end, linear between samples, held before the first and after
    the last of them."""
    n = F.size(times)

    def value(k: Column) -> Column:
        t = start + (end - start) * k.cast("double") / steps
        i = rank_of(n, lambda x: F.get(times, x).cast("double"), t)
        t0, t1, a, b = _at(times, i - 1), _at(times, i), _at(values, i - 1), _at(values, i)
        return F.when(i == 0, _at(values, F.lit(0))).when(i == n, F.element_at(values, -1)).otherwise(a + (b - a) * (t - t0) / (t1 - t0))

    return F.transform(F.sequence(F.lit(0), steps), value)


def gaussian(a: Column, sigma: float) -> Column:
    """Gaussian blur on the grid; beyond an end values are mirrored about it. The radius is cut to whole steps."""
    step = GRID / 1000
    radius = int(3 * sigma / step)
    weights = [math.exp(-0.5 * (k * step / sigma) ** 2) for k in range(-radius, radius + 1)]
    listed, n = F.array(*[F.lit(w / sum(weights)) for w in weights]), F.size(a)

    def value(i: Column) -> Column:
        low = 2 * _at(a, F.lit(0)) - _at(a, F.least(-i, n - 1))
        high = 2 * F.element_at(a, -1) - _at(a, F.greatest(2 * (n - 1) - i, F.lit(0)))
        return F.when(i < 0, low).when(i >= n, high).otherwise(_at(a, F.greatest(F.least(i, n - 1), F.lit(0))))

    def blurred(i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * radius)), F.lit(0.0), lambda acc, k: acc + _at(listed, k) * value(i + k - radius))

    return F.when(n < 2, a).otherwise(F.transform(_index(a), blurred))


def moves(a: Column, dead_zone: Column, still: Column) -> Column:
    """Where a camera moves: from when the face leaves the dead zone around where it settled until it has
    stayed within `still` for SETTLE_STEPS."""

    def step(acc: Column, i: Column) -> Column:
        x = _at(a, i)
        recent = F.slice(a, F.greatest(i - SETTLE_STEPS + 1, F.lit(1)), SETTLE_STEPS + 1)
        settled = acc["moving"] & (i >= SETTLE_STEPS) & (F.array_max(recent) - F.array_min(recent) <= still)
        moving = F.when(~acc["moving"], F.abs(x - acc["hold"]) > dead_zone).otherwise(~settled)
        return F.struct(F.when(settled, x).otherwise(acc["hold"]).alias("hold"), moving.alias("moving"), F.concat(acc["marks"], F.array(moving)).alias("marks"))

    start = F.struct(_at(a, F.lit(0)).alias("hold"), F.lit(False).alias("moving"), F.array().cast("array<boolean>").alias("marks"))
    return F.aggregate(_index(a), start, step, lambda acc: acc["marks"])


def last_moves(moving: Column) -> Column:
    """For each point the last one up to it at which the camera moves, or -1."""

    def step(acc: Column, i: Column) -> Column:
        last = F.when(_at(moving, i), i).otherwise(acc["last"])
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(last)).alias("out"))

    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(_index(moving), start, step, lambda acc: acc["out"])


def hold_between(a: Column, moving: Column, last: Column, last_back: Column) -> Column:
    """The face while the camera moves; in between a straight line from move to move. last and last_back:
    last_moves of moving and of its reverse, as columns."""
    n = F.size(a)

    def value(i: Column) -> Column:
        before, after = _at(last, i), n - 1 - _at(last_back, n - 1 - i)
        left = F.when(before >= 0, _at(a, F.greatest(before, F.lit(0)))).otherwise(_at(a, F.least(after, n - 1)))
        right = F.when(after < n, _at(a, F.least(after, n - 1))).otherwise(_at(a, F.greatest(before, F.lit(0))))
        line = left + (right - left) * (i - before) / (after - before)
        return F.when(_at(moving, i), _at(a, i)).when((before < 0) & (after == n), median(a)).otherwise(line)

    return F.transform(_index(a), value)


def camera_paths(track: DataFrame, width: float, frame_width: float, share: float = 0.25, keys=("clip_id",), bounds: DataFrame | None = None) -> DataFrame:
    """track (keys, t_ms, cx double) -> keys, start_ms, end_ms and path (array<double>: the ends of equal parts of start to
    end, of GRID ms at most) for shots that one still window does not fit: the face leaves the dead zone and the
    path is not pinned to an edge.

    bounds (keys, start_ms, end_ms): where each shot begins and ends; without it, its first and last sample. Shots of
    less than GRID ms have no path. Still shots go before anything is laid on the grid. Each step is computed
    once for a shot: a one-row generator stands between the steps."""
    keys = list(keys)
    rows = ordered(track.select(*keys, "t_ms", F.col("cx").cast("double").alias("cx")), keys, ["t_ms"], ["t_ms", "cx"])
    rows = rows.select(*keys, F.col("rows.t_ms").alias("ts"), F.col("rows.cx").alias("xs"))
    gap = median(F.transform(F.slice("ts", 2, F.greatest(F.size("ts") - 1, F.lit(0))), lambda t, i: (t - _at(F.col("ts"), i)).cast("double")))
    radius = F.bround(2000 / F.greatest(F.coalesce(gap, F.lit(1000.0)), F.lit(1.0)), 0).cast("int")

    def then(df: DataFrame, name: str, value: Column, *kept: str) -> DataFrame:
        return df.select(*keys, *kept, F.explode(F.array(value)).alias(name))

    dead, still = F.lit(share * width), F.lit(SETTLE_SHARE * width)
    rows = then(rows, "targets", running_median(F.col("xs"), radius), "ts")
    rows = rows.where((F.size("ts") > 1) & (F.array_max("targets") - F.array_min("targets") > dead))
    if bounds is None:
        rows = rows.withColumn("start_ms", _at(F.col("ts"), F.lit(0))).withColumn("end_ms", F.element_at("ts", -1))
    else:
        rows = rows.join(bounds.select(*keys, "start_ms", "end_ms").hint("merge"), keys)
    rows = rows.where(F.col("end_ms") - F.col("start_ms") >= GRID).withColumn("steps", F.ceil((F.col("end_ms") - F.col("start_ms")) / GRID).cast("int"))
    rows = then(rows, "raw", on_grid(F.col("ts"), F.col("targets"), F.col("start_ms"), F.col("end_ms"), F.col("steps")), "start_ms", "end_ms")
    rows = then(rows, "face", gaussian(F.col("raw"), FACE_SIGMA), "start_ms", "end_ms")
    rows = then(rows, "ahead", moves(F.col("face"), dead, still), "start_ms", "end_ms", "face")
    rows = then(rows, "back", F.reverse(moves(F.reverse("face"), dead, still)), "start_ms", "end_ms", "face", "ahead")
    rows = then(rows, "moving", F.zip_with("ahead", "back", lambda p, q: p | q), "start_ms", "end_ms", "face")
    rows = then(rows, "last", last_moves(F.col("moving")), "start_ms", "end_ms", "face", "moving")
    rows = then(rows, "last_back", last_moves(F.reverse("moving")), "start_ms", "end_ms", "face", "moving", "last")
    rows = then(rows, "held", hold_between(F.col("face"), F.col("moving"), F.col("last"), F.col("last_back")), "start_ms", "end_ms")
    low, high = width / 2, max(frame_width - width / 2, width / 2)
    rows = then(rows, "smooth", gaussian(F.col("held"), PATH_SIGMA), "start_ms", "end_ms")
    rows = then(rows, "path", F.transform("smooth", lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))), "start_ms", "end_ms")
    return rows.where(F.array_max("path") - F.array_min("path") >= 1)


def simplify(points: DataFrame, tolerance: float, keys=("clip_id",)) -> DataFrame:
    """Of points (keys, i from 0, t, x) those that a line through few of them needs to stay within tolerance of all.

    In rounds over a table: every open span of every line finds its farthest point (the earliest of equals) in one
    pass and is divided there while that lies beyond tolerance; points of spans that are done leave the table. A
    round is written to the shared folder before the next, which reads no more than its open spans."""
    keys = list(keys)
    spark, base = points.sparkSession, shared_folder(points.sparkSession)
    own = Window.partitionBy(*keys)
    at_end = lambda f: f(F.struct("i", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"))).over(own)
    rows = points.select(*keys, F.col("i").cast("long").alias("i"), "t", "x").withColumn("a", at_end(F.min)).withColumn("b", at_end(F.max))
    rows.write.parquet(f"{base}/open-0")
    rows = spark.read.parquet(f"{base}/open-0")
    kept = [rows.where("i = a.i or i = b.i").select(*keys, "i", "t", "x")]
    rows, done = rows.where("i > a.i and i < b.i"), 0
    while True:
        off = F.abs(F.col("x") - (F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))))
        far = F.max(F.struct("off", (-F.col("i")).alias("back"), F.struct("i", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")).alias("p"))).over(Window.partitionBy(*keys, "a.i"))
        split = rows.withColumn("off", off).withColumn("far", far).where(F.col("far.off") > tolerance)
        left = F.col("i") < F.col("far.p.i")
        done += 1
        split.select(*keys, "i", "t", "x", (F.col("i") == F.col("far.p.i")).alias("keep"), F.when(left, F.col("a")).otherwise(F.col("far.p")).alias("a"), F.when(left, F.col("far.p")).otherwise(F.col("b")).alias("b")).write.parquet(f"{base}/open-{done}")
        found = spark.read.parquet(f"{base}/open-{done}")
        if not found.head(1):
            break
        kept.append(found.where("keep").select(*keys, "i", "t", "x"))
        rows = found.where("not keep").drop("keep")
    return reduce(DataFrame.unionByName, kept)


def keyframes(paths: DataFrame, tolerance: float = 0.5, keys=("clip_id",)) -> DataFrame:
    """camera_paths -> keys and keyframes, an array of (t_ms, cx rounded to tenths): few points, straight lines between."""
    at = F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * F.col("i").cast("double") / (F.size("path") - 1)
    points = paths.select(*keys, "start_ms", "end_ms", "path", F.posexplode("path").alias("i", "x")).select(*keys, "i", at.alias("t"), "x")
    frame = F.struct(F.bround("t", 0).cast("long").alias("t_ms"), F.bround("x", 1).alias("cx"))
    return simplify(points, tolerance, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(frame)).alias("keyframes"))
