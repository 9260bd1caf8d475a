"""Results against reference cuts: coverage and IoU joins, hits, precision, comparison of runs, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import fold, ordered


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def iou_pm(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union in thousandths, rounded down; 0 without a union."""
    both = overlap_ms(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, F.floor(both * 1000 / union)).otherwise(0).cast("long")


#: Length of the bins of time over which intervals are dealt before they are compared.
BIN_MS = 60_000


def _overlapping(a: DataFrame, b: DataFrame, key: str, begin: str = "start_ms", end: str = "end_ms", bin_ms: int = BIN_MS) -> DataFrame:
    """a (alias a) and b (alias b) where intervals of one key overlap; b's interval is begin to end.

    Each interval stands in every bin of time that it touches; a pair meets in the first bin that both touch, so that
    a long recording is not one group in which all are compared with all."""

    def dealt(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
        low, high = F.floor(F.col(x) / bin_ms), F.floor(F.greatest(x, y) / bin_ms)
        return df.withColumn("_first", low).withColumn("_bin", F.explode(F.sequence(low, high))).alias(name)

    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._bin") == F.col("b._bin")) & (F.col(f"b.{end}") > F.col("a.start_ms")) & (F.col(f"b.{begin}") < F.col("a.end_ms"))
    left, right = dealt(a, "start_ms", "end_ms", "a"), dealt(b, begin, end, "b")
    return left.join(right.hint("merge"), on).where(F.col("a._bin") == F.greatest("a._first", "b._first"))


def overlapping_segments(clips: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Segments that overlap a clip, compared within bins of time."""
    rows = _overlapping(clips, segments, key)
    return rows.select(f"a.{key}", "a.clip_no", F.col("a.start_ms").alias("clip_start_ms"), F.col("a.end_ms").alias("clip_end_ms"), "b.ord", "b.start_ms", "b.end_ms", "b.text")


def coverage(clips: DataFrame, pieces: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, clip_no, short_no, covered_ms, total_ms, covered_pm): how much of a short's pieces lies in the clip, for pairs
    that overlap at all; covered_pm is the share in thousandths, rounded down, 0 of a short without length. A short's
    length is summed over all its pieces, before the join."""
    length = F.col("source_end_ms") - F.col("source_start_ms")
    total = pieces.groupBy(key, "short_no").agg(F.sum(length).alias("total_ms"))
    both = overlap_ms(F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.source_start_ms"), F.col("b.source_end_ms"))
    pairs = _overlapping(clips, pieces, key, "source_start_ms", "source_end_ms").groupBy(f"a.{key}", "clip_no", "short_no").agg(F.sum(both).alias("covered_ms"))
    share = F.when(F.col("total_ms") > 0, F.floor(F.col("covered_ms") * 1000 / F.col("total_ms"))).otherwise(0).cast("long")
    return pairs.join(total.hint("merge"), [key, "short_no"]).select(key, "clip_no", "short_no", "covered_ms", "total_ms", share.alias("covered_pm"))


def label_matches(clips: DataFrame, labels: DataFrame, iou: int = 500, key: str = "video_id") -> DataFrame:
    """Clips and rated intervals that overlap with an IoU of iou thousandths or more."""
    value = iou_pm(F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.start_ms"), F.col("b.end_ms"))
    return _overlapping(clips, labels, key).select(f"a.{key}", "a.clip_no", "b.label", value.alias("iou_pm")).where(F.col("iou_pm") >= iou)


def best_covering_clip(covered: DataFrame, shorts: DataFrame, key: str = "video_id") -> DataFrame:
    """For each short the clip that covers most, to the millisecond, the first on ties; a null clip and 0 if nothing covers
    it, so also for recordings without clips and for shorts without length."""
    best = F.max(F.struct("covered_ms", (-F.col("clip_no")).alias("back"), "covered_pm")).alias("b")
    rows = covered.where("covered_ms > 0 and total_ms > 0").groupBy(key, "short_no").agg(best)
    rows = shorts.select(key, "short_no").join(rows.hint("merge"), [key, "short_no"], "left")
    return rows.select(key, "short_no", (-F.col("b.back")).alias("clip_no"), F.coalesce("b.covered_pm", F.lit(0)).cast("long").alias("covered_pm"))


def find_shorts(best: DataFrame, hit: int = 700) -> DataFrame:
    return best.withColumn("found", F.col("clip_no").isNotNull() & (F.col("covered_pm") >= hit))


def hook_checks(found: DataFrame, clips: DataFrame, shorts: DataFrame, pieces: DataFrame, hook_ms: int = 3000, key: str = "video_id") -> DataFrame:
    """For shorts that were found: does the clip begin with the short's opening piece (first in the short), or for reordered
    shorts with the source span? The latter is null for others and where there is no span."""
    opening = pieces.groupBy(key, "short_no").agg(F.min_by("source_start_ms", F.struct("short_start_ms", "piece")).alias("opening_ms"))
    rows = found.where("found").join(opening.hint("merge"), [key, "short_no"], "left").join(shorts.select(key, "short_no", "reordered", "span_start_ms").hint("merge"), [key, "short_no"])
    rows = rows.join(clips.select(key, "clip_no", "start_ms").hint("merge"), [key, "clip_no"])
    near = lambda c: F.abs(F.col("start_ms") - F.col(c)) <= hook_ms
    return rows.select(key, "short_no", "clip_no", near("opening_ms").alias("hook_ok"), F.when(F.col("reordered"), near("span_start_ms")).alias("span_ok"))


def precision_members(clips: DataFrame, covered: DataFrame, matches: DataFrame, hit: int = 700, key: str = "video_id") -> DataFrame:
    """Clips that find a short or match an interval rated keep or edit. covered: of the shorts that count, so without
    those of montages."""
    on = [key, "clip_no"]
    by_short = clips.join(covered.where(F.col("covered_pm") >= hit).hint("merge"), on, "left_semi")
    by_label = clips.join(matches.where(F.col("label").isin("keep", "edit")).hint("merge"), on, "left_semi")
    return by_short.union(by_label).select(*on).distinct()


def metrics(found: DataFrame, clips: DataFrame, precise: DataFrame, episodes: DataFrame, key: str = "video_id") -> DataFrame:
    """Per key and in total (null key): shorts, hits, clips, precise clips; shares in thousandths, rounded down.

    episodes (key): those of the run. Only they count, so a run of a part of the set misses nothing of the rest;
    one without clips and shorts has a row of zeros."""
    zero = {c: F.lit(0) for c in ("s", "h", "c", "p")}
    row = lambda df, **k: df.select(key, *[v.alias(c) for c, v in (zero | k).items()])
    parts = [row(found, s=F.lit(1), h=F.col("found").cast("int")), row(clips, c=F.lit(1)), row(precise, p=F.lit(1))]
    of_run = episodes.select(key).distinct()
    rows = parts[0].union(parts[1]).union(parts[2]).join(of_run.hint("merge"), key, "left_semi").union(row(of_run))
    sums = rows.rollup(key).agg(*[F.sum(x).alias(n) for x, n in (("s", "shorts"), ("h", "hits"), ("c", "clips"), ("p", "precise"))])
    share = lambda a, b: F.floor(F.col(a) * 1000 / F.nullif(F.col(b), F.lit(0))).cast("long")
    return sums.withColumn("hit_pm", share("hits", "shorts")).withColumn("precision_pm", share("precise", "clips"))


def compare_metrics(before: DataFrame, after: DataFrame, key: str = "video_id") -> DataFrame:
    """The change from one run's metrics to another's, per key and in total (null key): hits, precision, clips, as (key,
    hits_before, hits_after, ...). What one run lacks is null there, and so is the change."""
    names = ["hits", "shorts", "precise", "clips", "precision_pm"]
    a, b = (m.select(F.col(key).alias(f"_k{i}"), *[F.col(n).alias(f"{n}_{side}") for n in names]) for i, (m, side) in enumerate(((before, "before"), (after, "after"))))
    rows = a.join(b.hint("merge"), F.col("_k0").eqNullSafe(F.col("_k1")) & F.col("clips_before").isNotNull() & F.col("clips_after").isNotNull(), "full_outer")
    change = [(F.col(f"{n}_after") - F.col(f"{n}_before")).alias(f"{n}_change") for n in ("hits", "precision_pm", "clips")]
    return rows.select(F.coalesce("_k0", "_k1").alias(key), *[f"{n}_{side}" for n in names for side in ("before", "after")], *change)


def review_counts(reviews: DataFrame, key: str | None = None) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("keep", "edit", "reject", "pending")]
    rows = (reviews.groupBy(key) if key else reviews.groupBy()).agg(*counts)
    rated = F.col("keep") + F.col("edit") + F.col("reject")
    return rows.withColumn("rated", rated).withColumn("keep_pm", F.floor(F.col("keep") * 1000 / F.nullif(F.col("rated"), F.lit(0))).cast("long"))


def median_duration(clips: DataFrame, key: str = "video_id") -> DataFrame:
    return clips.groupBy(key).agg(F.median(F.col("end_ms") - F.col("start_ms")).alias("median_ms"))


def clips_by_label(matches: DataFrame, key: str = "video_id") -> DataFrame:
    return matches.groupBy(key, "label").agg(F.array_join(F.transform(F.array_sort(F.collect_set("clip_no")), lambda x: x.cast("string")), ",").alias("clips"))


def plain_shorts(shorts: DataFrame) -> DataFrame:
    """Shorts that are no montage; without a word on that they count as plain."""
    return shorts.where(~F.coalesce("montage", F.lit(False)))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "video_id") -> DataFrame:
    """Best coverage of each short in two runs; a short that one lacks counts as 0 there."""
    left, right = a.select(key, "short_no", F.col("covered_pm").alias("a")), b.select(key, "short_no", F.col("covered_pm").alias("b"))
    rows = left.join(right.hint("merge"), [key, "short_no"], "full_outer").select(key, "short_no", F.coalesce("a", F.lit(0)).alias("before_pm"), F.coalesce("b", F.lit(0)).alias("after_pm"))
    return rows.withColumn("delta_pm", F.col("after_pm") - F.col("before_pm"))


def greedy_iou_matching(pending: DataFrame, rated: DataFrame, iou: int = 500, key: str = "video_id") -> DataFrame:
    """Pending clips in order take the best free rated one of the same key with enough IoU; the first on
    ties; each rated one is used once. Candidate pairs come from a join, a fold per key carries what is used.
    IoUs are compared as fractions, to 18 digits; iou_pm is rounded down."""
    both = overlap_ms(F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.start_ms"), F.col("b.end_ms"))
    union = (F.col("a.end_ms") - F.col("a.start_ms")) + (F.col("b.end_ms") - F.col("b.start_ms")) - both
    pairs = _overlapping(pending, rated, key).select(f"a.{key}", F.col("a.clip_no").alias("pending_no"), F.col("b.clip_no").alias("rated_no"), both.alias("_both"), union.alias("_union"))
    fine = F.expr("(cast(_both as decimal(18,0)) * cast(1000000000000000000 as decimal(19,0))) div _union")
    pairs = pairs.where("_union > 0").withColumn("fine", fine).withColumn("iou_pm", F.floor(F.col("_both") * 1000 / F.col("_union")).cast("long")).where(F.col("iou_pm") >= iou)
    by_clip = pairs.groupBy(key, "pending_no").agg(F.array_sort(F.collect_list(F.struct((-F.col("fine")).alias("back"), "rated_no", "iou_pm"))).alias("choices"))
    rows = ordered(by_clip, [key], ["pending_no"], ["pending_no", "choices"])

    def step(acc: Column, e: Column) -> Column:
        free = F.get(F.filter(e["choices"], lambda c: ~F.array_contains(acc["used"], c["rated_no"])), F.lit(0))
        return F.when(free.isNull(), acc).otherwise(F.struct(F.concat(acc["used"], F.array(free["rated_no"])).alias("used"), F.concat(acc["out"], F.array(F.struct(e["pending_no"].alias("pending_no"), free["rated_no"].alias("rated_no"), free["iou_pm"].alias("iou_pm")))).alias("out")))

    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<pending_no:bigint,rated_no:bigint,iou_pm:bigint>>").alias("out"))
    return rows.select(key, F.inline(fold(F.col("rows"), start, step, lambda acc: acc["out"])))


def carry_over(pending: DataFrame, rated: DataFrame, iou: int = 500, key: str = "video_id") -> DataFrame:
    """Ratings of an earlier run for pending clips of a new one, with a note on the match."""
    matched = greedy_iou_matching(pending, rated, iou, key)
    old = rated.select(F.col(key).alias("_k"), F.col("clip_no").alias("_c"), "status")
    note = F.concat(F.lit("carried over, IoU "), F.lpad(F.floor(F.col("iou_pm") / 1000).cast("string"), 1, "0"), F.lit("."), F.lpad((F.floor(F.col("iou_pm") / 10) % 100).cast("string"), 2, "0"))
    return matched.join(old.hint("merge"), (F.col(key) == F.col("_k")) & (F.col("rated_no") == F.col("_c"))).select(key, F.col("pending_no").alias("clip_no"), "status", note.alias("notes"))


def missing_episodes(wanted: DataFrame, run: DataFrame, key: str = "video_id") -> DataFrame:
    return wanted.join(run.select(key).distinct().hint("merge"), key, "left_anti")


def missing_shorts(found: DataFrame, key: str = "video_id") -> DataFrame:
    """Shorts that no clip hits, least covered first within the key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("covered_pm", "short_no"))
    return found.where(~F.col("found")).select(key, "short_no", "covered_pm", rank.alias("rank"))
