"""Track segments of a clip: groups of samples without short ones, neighbours of one framing joined, boundaries on
cuts, and the shots between cuts. Times in ms, boxes in pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import fold, ordered
from .camera import median


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def absorb_short(shot_rows: DataFrame, clips: DataFrame, min_ms: int = 2000) -> DataFrame:
    """shot_rows (clip_id, t_ms, shot_no), clips (clip_id, start_ms, end_ms) -> (clip_id, shot_no, group_no, start_ms): each
    shot's group, numbered from 0. While the shortest group (the earliest of equals) is shorter than min_ms it joins its
    longer neighbour, of equals the earlier. A group lasts from its first sample to the next one's; the first starts with the clip."""
    firsts = shot_rows.groupBy("clip_id", "shot_no").agg(F.min("t_ms").alias("at"))
    rows = ordered(firsts, ["clip_id"], ["shot_no"], ["shot_no", "at"]).join(clips.select("clip_id", "start_ms", "end_ms").hint("merge"), "clip_id")
    start = F.transform("rows", lambda r, i: F.struct(r["shot_no"].alias("shot_no"), F.when(i == 0, F.col("start_ms")).otherwise(r["at"]).alias("at")))

    def step(groups: Column, _: Column) -> Column:
        following = lambda i: F.coalesce(F.get(groups, i + 1)["at"], F.col("end_ms"))
        lasts = F.transform(groups, lambda g, i: following(i) - g["at"])

        def merged(d: Column) -> Column:
            def without_shortest(i: Column) -> Column:
                forward = (i == 0) | ((i < F.size(d) - 1) & (F.get(d, i - 1) < F.get(d, i + 1)))
                # Found once for a step: within the filter it would be searched for again at every group.
                return _let(F.when(forward, i + 1).otherwise(i), lambda gone: F.filter(groups, lambda _g, k: k != gone))

            shortest = lambda low: F.when(low >= min_ms, groups).otherwise(_let((F.array_position(d, low) - 1).cast("int"), without_shortest))
            return _let(F.array_min(d), shortest)

        return F.when(F.size(groups) < 2, groups).otherwise(_let(lasts, merged))

    rows = rows.select("clip_id", fold(F.col("rows"), start, step).alias("g"))
    groups = rows.select("clip_id", F.posexplode("g").alias("group_no", "g")).select("clip_id", F.col("group_no").cast("long").alias("group_no"), F.col("g.shot_no").alias("from_shot"), F.col("g.at").alias("start_ms"))
    until = F.lead("from_shot").over(Window.partitionBy("clip_id").orderBy("group_no"))
    groups = groups.withColumn("to_shot", until).alias("g")
    on = (F.col("f.clip_id") == F.col("g.clip_id")) & (F.col("f.shot_no") >= F.col("g.from_shot")) & (F.col("g.to_shot").isNull() | (F.col("f.shot_no") < F.col("g.to_shot")))
    return firsts.alias("f").join(groups.hint("merge"), on).select("f.clip_id", "f.shot_no", "g.group_no", "g.start_ms")


def _box(samples: Column) -> Column:
    """Median (cx, cy, w) of the faces among samples; null if they are fewer than half."""
    faces = F.filter(samples, lambda s: s["conf_pm"] > 0)
    middle = lambda f: median(F.transform(faces, f)).cast("double")
    box = F.struct(middle(lambda s: s["x"] + s["w"] / 2).alias("cx"), middle(lambda s: s["y"] + s["h"] / 2).alias("cy"), middle(lambda s: s["w"].cast("double")).alias("w"))
    return F.when((F.size(faces) > 0) & (F.size(faces) * 2 >= F.size(samples)), box)


def join_same(samples: DataFrame, size_ratio: float = 1.35, jump: float = 0.5) -> DataFrame:
    """samples (clip_id, n, group_no, x, y, w, h, conf_pm) -> the same with part_no: from the first group on, a group joins
    all that has been joined before it if both lack a face or their median boxes are of one size and place."""
    keys = ["clip_id", "group_no"]
    groups = ordered(samples, keys, ["n"], ["n", "x", "y", "w", "h", "conf_pm"], "samples")
    rows = ordered(groups, ["clip_id"], ["group_no"], ["group_no", "samples"])

    def same(a: Column, b: Column) -> Column:
        wa, wb = F.greatest(a["w"], F.lit(1.0)), F.greatest(b["w"], F.lit(1.0))
        alike = (F.greatest(wa, wb) / F.least(wa, wb) <= size_ratio) & (F.abs(a["cx"] - b["cx"]) / F.greatest(wa, wb) <= jump)
        return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(alike, F.lit(False)))

    def step(acc: Column, e: Column) -> Column:
        boxes = F.struct(_box(acc["now"]).alias("a"), _box(e["samples"]).alias("b"))
        goes_on = (F.size(acc["now"]) > 0) & _let(boxes, lambda x: same(x["a"], x["b"]))

        def taken(on: Column) -> Column:
            part = F.when(on, acc["part"]).otherwise(acc["part"] + 1).cast("long")
            now = F.when(on, F.concat(acc["now"], e["samples"])).otherwise(e["samples"])
            return F.struct(part.alias("part"), now.alias("now"), F.concat(acc["out"], F.array(F.struct(e["group_no"].alias("group_no"), part.alias("part_no")))).alias("out"))

        return _let(goes_on, taken)

    none = F.slice(F.get(F.col("rows"), F.lit(0))["samples"], 1, 0)
    start = F.struct(F.lit(-1).cast("long").alias("part"), none.alias("now"), F.array().cast("array<struct<group_no:bigint,part_no:bigint>>").alias("out"))
    parts = rows.select("clip_id", F.inline(fold(F.col("rows"), start, step, lambda acc: acc["out"])))
    return samples.join(parts.hint("merge"), keys)


def track_segments(shot_rows: DataFrame, clips: DataFrame, cuts: DataFrame | None = None, min_ms: int = 2000, size_ratio: float = 1.35, jump: float = 0.5) -> DataFrame:
    """(clip_id, segment_no, start_ms, end_ms, has_face, cx, cy) for each clip: what one window shows.

    shot_rows: detections with shot_no (tracks.shots). Boundaries move to the latest cut (clip_id, cut_ms) around them; parts
    without a cut between them are one segment unless the face's size changes. Without cuts each part is a segment. A clip
    without samples is one segment without a face."""
    groups = absorb_short(shot_rows, clips, min_ms)
    placed = shot_rows.select("clip_id", "n", "t_ms", "shot_no", "x", "y", "w", "h", "conf_pm").join(groups.hint("merge"), ["clip_id", "shot_no"])
    joined = join_same(placed, size_ratio, jump)
    part = joined.groupBy("clip_id", "part_no").agg(F.min("start_ms").alias("start_ms"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), _box(F.array_sort(F.collect_list(F.struct("n", "x", "y", "w", "h", "conf_pm")))).alias("box"))
    clip = Window.partitionBy("clip_id").orderBy("part_no")
    part = part.withColumn("prev_ms", F.lag("last_ms").over(clip))
    if cuts is None:
        part = part.withColumn("cut_ms", F.col("start_ms"))
    else:
        p, c = part.alias("p"), cuts.select("clip_id", "cut_ms").alias("c")
        gap = F.col("p.first_ms") - F.col("p.prev_ms")
        on = (F.col("p.clip_id") == F.col("c.clip_id")) & (2 * F.col("c.cut_ms") > 2 * F.col("p.prev_ms") - gap) & (2 * F.col("c.cut_ms") <= 2 * F.col("p.first_ms") + gap)
        latest = p.join(c.hint("merge"), on).groupBy("p.clip_id", "p.part_no").agg(F.max("c.cut_ms").alias("cut_ms"))
        part = part.join(latest.hint("merge"), ["clip_id", "part_no"], "left")
    first = F.col("prev_ms").isNull()
    part = part.withColumn("from_ms", F.when(first, F.col("start_ms")).otherwise(F.coalesce("cut_ms", "start_ms"))).withColumn("_new", first | F.col("cut_ms").isNotNull())
    part = part.withColumn("_run", F.sum(F.col("_new").cast("int")).over(clip))
    before = F.last(F.col("box")["w"], ignorenulls=True).over(Window.partitionBy("clip_id", "_run").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1))
    resized = F.coalesce(F.greatest("box.w", "_w") / F.greatest(F.least("box.w", "_w"), F.lit(1.0)) > size_ratio, F.lit(False))
    part = part.withColumn("_w", F.when(F.col("box").isNotNull(), before)).withColumn("_new", F.col("_new") | resized)
    part = part.withColumn("segment_no", (F.sum(F.col("_new").cast("int")).over(clip) - 1).cast("long"))
    spans = part.groupBy("clip_id", "segment_no").agg(F.min("from_ms").alias("start_ms"))
    faces = joined.join(part.where("box is not null").select("clip_id", "part_no", "segment_no").hint("merge"), ["clip_id", "part_no"]).where("conf_pm > 0")
    middle = lambda c: F.bround(F.percentile(c, F.lit(0.5)), 1)
    centres = faces.groupBy("clip_id", "segment_no").agg(middle(F.col("x") + F.col("w") / 2).alias("cx"), middle(F.col("y") + F.col("h") / 2).alias("cy"))
    found = spans.join(centres.hint("merge"), ["clip_id", "segment_no"], "left")
    whole = clips.select("clip_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")).join(found.hint("merge"), "clip_id", "left")
    following = F.lead("start_ms").over(Window.partitionBy("clip_id").orderBy("segment_no"))
    return whole.select("clip_id", F.coalesce("segment_no", F.lit(0).cast("long")).alias("segment_no"), F.coalesce("start_ms", "_s").alias("start_ms"), F.coalesce(following, F.col("_e")).alias("end_ms"), F.col("cx").isNotNull().alias("has_face"), "cx", "cy")
