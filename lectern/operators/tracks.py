"""Face tracks: sampling, best box, smoothing, shots and crop windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec



def _clip() -> WindowSpec:
    return Window.partitionBy("clip_id")


def sample_grid(clips: DataFrame, step_ms: int = 1000, key: str = "video_id") -> DataFrame:
    """Times start + k * step up to the end of each clip."""
    return clips.select(key, "clip_no", F.explode(F.sequence("start_ms", "end_ms", F.lit(step_ms).cast("long"))).alias("t_ms"))


def best_faces(candidates: DataFrame, width: int, height: int, threshold_pm: int = 500) -> DataFrame:
    """The most confident box of each sample, clamped to the frame; conf_pm 0 without one at the threshold."""
    top = candidates.groupBy("clip_id", "n").agg(F.max(F.struct("conf_pm", (-F.col("x")).alias("back"), "y", "w", "h")).alias("b"))
    x = F.least(F.greatest(-F.col("b.back"), F.lit(0)), F.lit(width - 1))
    y = F.least(F.greatest(F.col("b.y"), F.lit(0)), F.lit(height - 1))
    ok = F.col("b.conf_pm") >= threshold_pm
    return top.select("clip_id", "n", x.alias("x"), y.alias("y"), F.least(F.col("b.w"), width - x).alias("w"), F.least(F.col("b.h"), height - y).alias("h"), F.when(ok, F.col("b.conf_pm")).otherwise(0).alias("conf_pm"))


def moving_average(detections: DataFrame, window: int = 5) -> DataFrame:
    """x, y, w, h averaged over a centred window, rounded down; clips of no more than window samples stay."""
    near = _clip().orderBy("n").rowsBetween(-(window // 2), window // 2)
    mean = lambda c: F.when(F.count(F.lit(1)).over(_clip()) > window, F.floor(F.sum(c).over(near) / F.count(c).over(near))).otherwise(F.col(c)).cast("long")
    return detections.select("clip_id", "n", *[mean(c).alias(c) for c in "xywh"], "conf_pm")


def shots(detections: DataFrame, size_ratio_pct: int = 135, jump_pct: int = 50) -> DataFrame:
    """detections with shot_no: a new shot where a face appears or goes, its size changes by more than
    size_ratio_pct or its centre jumps by more than jump_pct of the larger width."""
    w = _clip().orderBy("n")
    prev = lambda c: F.lag(c).over(w)
    seen, before = F.col("conf_pm") > 0, F.lag("conf_pm").over(w) > 0
    larger, smaller = F.greatest("w", prev("w")), F.least("w", prev("w"))
    jump = F.abs((2 * F.col("x") + F.col("w")) - (2 * prev("x") + prev("w")))
    cut = F.when(before.isNull(), False).when(seen != before, True).when(seen, (larger * 100 > smaller * size_ratio_pct) | (jump * 100 > 2 * jump_pct * larger)).otherwise(False)
    flagged = detections.withColumn("_cut", cut.cast("int"))
    return flagged.withColumn("shot_no", F.sum("_cut").over(w)).drop("_cut")


def shot_boxes(shot_rows: DataFrame) -> DataFrame:
    """Per shot: span of samples, and the median centre and width of its faces if they are half or more."""
    face = F.col("conf_pm") > 0
    middle = lambda c: F.percentile(F.when(face, c), F.lit(0.5))
    many = F.count_if(face) * 2 >= F.count(F.lit(1))
    has = many & (F.count_if(face) > 0)
    return shot_rows.groupBy("clip_id", "shot_no").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), has.alias("has_face"), F.when(has, middle(F.col("x") + F.col("w") / 2)).alias("cx"), F.when(has, middle(F.col("w"))).cast("double").alias("w"))


def fallback_flags(detections: DataFrame, limit_pm: int = 700) -> DataFrame:
    """Share of samples without a face; above the limit the whole clip is cropped to the centre."""
    share = F.floor(F.count_if(F.col("conf_pm") == 0) * 1000 / F.count(F.lit(1))).cast("long")
    return detections.groupBy("clip_id").agg(share.alias("no_face_pm"), (F.count_if(F.col("conf_pm") == 0) * 1000 > limit_pm * F.count(F.lit(1))).alias("fallback"))


def cuts_at_boundaries(shot_rows: DataFrame, cuts: DataFrame, half_ms: int = 500) -> DataFrame:
    """For each start of a shot the latest cut later than half a step before the sample before, up to half a
    step behind its first sample. cuts: clip_id, cut_ms."""
    first = shot_rows.groupBy("clip_id", "shot_no").agg(F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))
    before = F.lag("last_ms").over(_clip().orderBy("shot_no"))
    edges = first.withColumn("prev_ms", before).where("prev_ms is not null")
    e, c = edges.alias("e"), cuts.alias("c")
    on = (F.col("e.clip_id") == F.col("c.clip_id")) & (F.col("c.cut_ms") > F.col("e.prev_ms") - half_ms) & (F.col("c.cut_ms") <= F.col("e.first_ms") + half_ms)
    return e.join(c.hint("merge"), on, "left").groupBy("e.clip_id", "e.shot_no").agg(F.max("c.cut_ms").alias("cut_ms")).select("clip_id", "shot_no", "cut_ms")


def resample(track: DataFrame, step_ms: int = 100) -> DataFrame:
    """A clip's x on a grid of step_ms from its first sample on, linear between samples (rounded down): clip_id, t_ms, x.

    Each sample yields the grid times from it up to the next sample; the last only itself, if it is on the grid."""
    w = _clip().orderBy("t_ms")
    rows = track.select("clip_id", "t_ms", "x", F.lead("t_ms").over(w).alias("_t"), F.lead("x").over(w).alias("_x"), F.min("t_ms").over(_clip()).alias("_from"))
    place = lambda t: F.ceil((t - F.col("_from")) / step_ms)
    low, high = place(F.col("t_ms")), place(F.coalesce("_t", F.col("t_ms") + 1)) - 1
    rows = rows.withColumn("_k", F.explode(F.when(high >= low, F.sequence(low, high)))).withColumn("at", F.col("_from") + F.col("_k") * step_ms)
    between = F.col("x") + F.floor((F.col("_x") - F.col("x")) * (F.col("at") - F.col("t_ms")) / (F.col("_t") - F.col("t_ms")))
    return rows.select("clip_id", F.col("at").alias("t_ms"), F.coalesce(between, F.col("x")).cast("long").alias("x"))


def running_median(track: DataFrame, radius: int = 2) -> DataFrame:
    """x with the median over up to radius samples to each side, fewer near the ends, in halves (x2). An end takes the
    median of itself, its neighbour and the neighbour's mirror; clips of fewer than three samples stay."""
    w = _clip().orderBy("n")
    n, i = F.count(F.lit(1)).over(_clip()), F.row_number().over(w)
    sides = [c for k in (1, 2) for c in (F.lag("x", k).over(w).alias(f"_b{k}"), F.lead("x", k).over(w).alias(f"_a{k}"))]
    rows = track.select("clip_id", "n", "x", n.alias("_n"), F.least(F.lit(radius), i - 1, n - i).alias("_m"), *sides)
    near = lambda r: F.percentile("x", F.lit(0.5)).over(w.rowsBetween(-r, r))
    one, two = F.coalesce("_b1", "_a1"), F.coalesce("_b2", "_a2")
    value = F.when(F.col("_n") < 3, F.col("x")).when(F.col("_m") == 0, F.get(F.array_sort(F.array("x", one, 2 * one - two)), F.lit(1)))
    for r in range(1, radius + 1):
        value = value.when(F.col("_m") == r, near(r))
    return rows.select("clip_id", "n", (value * 2).cast("long").alias("x2"))


def crop_window(centres: DataFrame, width: int = 1920, height: int = 1080, out_width: int = 1080, out_height: int = 1920) -> DataFrame:
    """The widest window of the output's aspect around cx, kept inside the frame; centred without cx."""
    w = min(width, height * out_width // out_height)
    left = F.coalesce(F.floor(F.col("cx") - w / 2), F.lit((width - w) // 2))
    return centres.withColumn("crop_x", F.greatest(F.lit(0), F.least(F.lit(width - w), left)).cast("long")).withColumn("crop_w", F.lit(w).cast("long"))

