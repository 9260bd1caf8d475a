"""Chapters and b-roll: block packing, snapping to segment starts, even splits and thinning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fold import ordered, rank_of, walk
from ..streaming.job_state import shared_folder


def pack_blocks(segments: DataFrame, max_chars: int = 4000, key: str = "video_id") -> DataFrame:
    """(key, block_no from 0, first_ord, last_ord): segments until their stripped texts, nine characters
    more for each, exceed the budget; at least one to a block. Sums up to each segment give where a block that
    begins there ends, and the blocks are a walk along these ends."""
    used = F.sum(F.length(F.trim("text")) + 9).over(Window.partitionBy(key).orderBy("ord"))
    sized = segments.select(key, "ord", used.alias("used"), (F.length(F.trim("text")) + 9).alias("size"))
    rows = ordered(sized, [key], ["ord"], ["ord", "used", "size"]).withColumn("n", F.size("rows"))
    upto = lambda i: F.get("rows", i)["used"]
    ends = F.transform("rows", lambda e, i: F.greatest(i + 1, rank_of(F.col("n"), upto, e["used"] - e["size"] + max_chars)))
    rows = rows.withColumn("starts", walk(ends, F.col("n")))
    out = rows.select(key, "rows", "n", "starts", F.posexplode("starts").alias("_i", "_s"))
    last = F.coalesce(F.get("starts", F.col("_i") + 1), F.col("n")) - 1
    return out.select(key, F.col("_i").cast("long").alias("block_no"), F.get("rows", F.col("_s"))["ord"].alias("first_ord"), F.get("rows", last)["ord"].alias("last_ord"))


def chapters_in_blocks(segments: DataFrame, find: Callable[[DataFrame], DataFrame], max_chars: int = 4000, key: str = "video_id") -> DataFrame:
    """(key, block_no, chapter_no, start_ms, title): chapters of transcripts that are asked for block by block.

    find takes the segments of one block of every recording (key, block_no, ord, start_ms, end_ms, text, is_final) and returns
    its answers (key, block_no, point_no, at_ms, title). The last of several chapters of a block that is not the
    final one may go on behind it, so it is dropped and the next block begins at its first segment; a block of one chapter
    is followed by what comes after it. A recording with a block without a usable chapter has no rows.

    All recordings advance together, a round for each block of the longest, as a block begins where the answer
    to the one before says. Each round is written to the shared folder with the segments that are still to be asked for: a
    block is a filter of that table, and only the rest of recordings that go on is shuffled to the next one."""
    spark, base = segments.sparkSession, shared_folder(segments.sparkSession)
    own = Window.partitionBy(key)
    order = own.orderBy("ord")
    size = F.length(F.trim("text")) + 9
    sized = segments.select(key, "ord", "start_ms", "end_ms", "text", (F.row_number().over(order) - 1).alias("pos"), size.alias("size"), F.sum(size).over(order).alias("used"))
    # How far a block goes that begins at a segment: what stands up to there, by a frame over the running sums.
    span = own.orderBy("begun").rangeBetween(Window.unboundedPreceding, max_chars)
    n = F.count(F.lit(1)).over(own)
    whole = F.max("used").over(own) <= F.col("begun") + max_chars
    sized = sized.withColumn("begun", F.col("used") - F.col("size")).withColumn("n", n)
    sized = sized.withColumn("stop", F.when(whole, F.col("n")).otherwise(F.greatest(F.col("pos") + 1, F.count(F.lit(1)).over(span) - 1)))
    rest = sized.select(key, "ord", "start_ms", "end_ms", "text", "pos", "n", "stop", F.lit(0).alias("first"))
    rounds, failed = 0, None
    while True:
        rest.withColumn("_stop", F.max(F.when(F.col("pos") == F.col("first"), F.col("stop"))).over(own)).write.parquet(f"{base}/rest-{rounds}")
        rest = spark.read.parquet(f"{base}/rest-{rounds}")
        if not rest.head(1):
            break
        inside = rest.where("pos < _stop").select(key, F.lit(rounds).alias("block_no"), "ord", "start_ms", "end_ms", "text", (F.col("_stop") >= F.col("n")).alias("is_final"), "pos", "first", "_stop")
        answers = find(inside.drop("pos", "first", "_stop")).select(key, "point_no", "at_ms", "title")
        made = normalise_chapters(answers, inside, key)
        back = F.row_number().over(own.orderBy(F.desc("chapter_no")))
        made = made.withColumn("_back", back).withColumn("_last", F.max("start_ms").over(own))
        made.write.parquet(f"{base}/made-{rounds}")
        made = spark.read.parquet(f"{base}/made-{rounds}")
        ends = inside.where("pos = first").select(key, "first", "_stop", "is_final")
        at = inside.select(key, "start_ms", "pos").join(made.select(key, "_last").distinct().hint("merge"), key).where("start_ms >= _last").groupBy(key).agg(F.min("pos").alias("carried"))
        ends = ends.join(at.hint("merge"), key, "left")
        again = ~F.col("is_final") & (F.col("carried") > F.col("first"))
        ends = ends.withColumn("again", F.coalesce(again, F.lit(False))).withColumn("next", F.when(F.col("carried").isNull(), -1).when(F.col("is_final"), -2).when(F.col("again"), F.col("carried")).otherwise(F.col("_stop")))
        ends.write.parquet(f"{base}/ends-{rounds}")
        ends = spark.read.parquet(f"{base}/ends-{rounds}")
        kept = made.join(ends.select(key, "again").hint("merge"), key).where(~F.col("again") | (F.col("_back") > 1))
        kept.select(key, F.lit(rounds).alias("block_no"), "chapter_no", "start_ms", "title").write.parquet(f"{base}/chapters/{rounds}")
        none = ends.where("next = -1").select(key)
        failed = none if failed is None else failed.union(none)
        goes_on = ends.where("next >= 0").select(F.col(key).alias("_k"), F.col("next").alias("_next"))
        open_ = rest.where("_stop < n and pos > first").drop("_stop", "first")
        rest = open_.join(goes_on.hint("merge"), (F.col(key) == F.col("_k")) & (F.col("pos") >= F.col("_next"))).select(*open_.columns, F.col("_next").alias("first"))
        rounds += 1
    if not rounds:
        return normalise_chapters(find(segments.limit(0).select(key, F.lit(0).alias("block_no"), "ord", "start_ms", "end_ms", "text", F.lit(True).alias("is_final"))), segments.limit(0), key).select(key, F.lit(0).alias("block_no"), "chapter_no", "start_ms", "title")
    found = reduce(DataFrame.unionByName, [spark.read.parquet(f"{base}/chapters/{k}") for k in range(rounds)])
    whole = found.join(failed.hint("merge"), key, "left_anti")
    number = F.row_number().over(Window.partitionBy(key).orderBy("block_no", "chapter_no")) - 1
    return whole.select(key, "block_no", number.cast("long").alias("chapter_no"), "start_ms", "title")


def snap_to_segments(points: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """points (key, point_no, at_ms) with start_ms, the nearest segment start; the earlier one on ties.

    One pass over points and starts in order of time: the last start before and the first one after."""
    starts = segments.select(key, F.lit(None).cast("long").alias("point_no"), F.col("start_ms").alias("at_ms"), F.col("start_ms").alias("s"))
    both = points.select(key, "point_no", "at_ms", F.lit(None).cast("long").alias("s")).union(starts)
    w = Window.partitionBy(key).orderBy("at_ms", F.col("s").isNull())
    before = F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("_b", before).withColumn("_a", after).where("point_no is not null")
    nearer = F.when(F.col("_a").isNull() | (F.col("at_ms") - F.col("_b") <= F.col("_a") - F.col("at_ms")), F.col("_b")).otherwise(F.col("_a"))
    return rows.select(key, "point_no", "at_ms", nearer.alias("start_ms"))


def normalise_chapters(answers: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """answers (key, point_no, at_ms, title): titles stripped, empty ones dropped, starts snapped, the first
    pinned to the first segment, then only those later than all kept before."""
    named = answers.withColumn("title", F.trim("title")).where("title <> ''")
    snapped = snap_to_segments(named, segments, key).drop("at_ms")
    rows = snapped.join(named.select(key, "point_no", "title").hint("merge"), [key, "point_no"])
    first = segments.groupBy(key).agg(F.min_by("start_ms", "ord").alias("_first"))
    w = Window.partitionBy(key).orderBy("point_no")
    rows = rows.join(first.hint("merge"), key).withColumn("start_ms", F.when(F.row_number().over(w) == 1, F.col("_first")).otherwise(F.col("start_ms")))
    latest = F.max("start_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_latest", latest).where("_latest is null or start_ms > _latest")
    return rows.select(key, (F.row_number().over(w) - 1).cast("long").alias("chapter_no"), "start_ms", "title")


def even_chapters(media: DataFrame, min_minutes: int = 2, max_minutes: int = 6, key: str = "video_id") -> DataFrame:
    """Parts of equal length where no model answered: as many as the middle of the limits goes into the duration."""
    target = (min_minutes + max_minutes) * 30_000
    n = F.greatest(F.lit(1), F.floor(F.col("duration_ms") / target)).cast("long")
    rows = media.withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.floor(F.col("i") * F.col("duration_ms") / F.col("_n"))
    return rows.select(key, F.col("i").alias("chapter_no"), start.cast("long").alias("start_ms"), F.concat(F.lit("Part "), F.col("i") + 1).alias("title"), F.concat(F.lit("Segment "), F.col("i") + 1, F.lit(" of "), F.col("_n")).alias("summary"))


def chapter_text(chapters: DataFrame, media: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, text): a line "clock title" for each chapter, hours only in recordings of an hour or more."""
    rows = chapters.join(media.hint("merge"), key)
    line = F.concat(T.clock(F.col("start_ms"), F.col("duration_ms") >= 3_600_000), F.lit(" "), F.col("title"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "chapter_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def thin_evenly(rows: DataFrame, cap: int, key: str = "video_id", order=("start_ms",)) -> DataFrame:
    """At most cap rows of each key, spread evenly: those at floor(i * n / cap)."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("_r", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    i = F.ceil(F.col("_r") * cap / F.col("_n"))  # the only i that can lead to this row
    chosen = (F.col("_n") <= cap) | ((F.floor(i * F.col("_n") / cap) == F.col("_r")) & (i < cap))
    return numbered.where(chosen).drop("_r", "_n")


def leading_suggestions(segments: DataFrame, cap: int = 10, key: str = "video_id") -> DataFrame:
    """Every (n div cap)-th segment, cap at most: its first six words and three keywords."""
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    step = F.greatest(F.lit(1), F.floor(n / cap))
    rows = segments.withColumn("_step", step).where((F.col("ord") % F.col("_step") == 0) & (F.col("ord") < F.col("_step") * cap))
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    text = F.when(F.size(words) > 0, F.concat(F.lit('Illustrative footage for: "'), F.array_join(F.slice(words, 1, 6), " "), F.lit('"'))).otherwise("Illustrative footage")
    return rows.select(key, "ord", "start_ms", text.alias("suggestion"), F.array_join(F.slice(words, 1, 3), ", ").alias("keywords"))


def block_quota(blocks: DataFrame, cap: int, key: str = "video_id") -> DataFrame:
    """Suggestions to ask of each block: its share of the cap, rounded up, at least one."""
    n = F.col("last_ord") - F.col("first_ord") + 1
    total = F.sum(n).over(Window.partitionBy(key))
    return blocks.select(key, "block_no", F.greatest(F.lit(1), F.floor((n * cap + total - 1) / total)).cast("long").alias("quota"))


def span_quota(blocks: DataFrame, key: str = "video_id") -> DataFrame:
    """Without a cap: one suggestion for each minute of a block (halves to even), at least one."""
    minutes = F.bround((F.col("end_ms") - F.col("start_ms")) / 60_000, 0)
    return blocks.select(key, "block_no", F.greatest(F.lit(1), minutes).cast("long").alias("quota"))


def suggestions_in_bounds(points: DataFrame, media: DataFrame, key: str = "video_id") -> DataFrame:
    """Points (at_ms, title) that lie within their recording and say something."""
    ends = media.select(key, F.col("duration_ms").alias("_d"))
    return points.join(ends.hint("merge"), key).where(F.col("at_ms").between(F.lit(0), F.col("_d")) & (F.trim("title") != "")).drop("_d")


def expected_chapters(media: DataFrame, min_minutes: int = 2, max_minutes: int = 6, key: str = "video_id") -> DataFrame:
    """How many chapters a span should have, where it lasts min_minutes or more."""
    d = F.col("duration_ms")
    low = F.greatest(F.lit(1), F.floor(d / (max_minutes * 60_000)))
    rows = media.where(d >= min_minutes * 60_000)
    return rows.select(key, low.cast("long").alias("low"), F.greatest(low, F.ceil(d / (min_minutes * 60_000))).cast("long").alias("high"))
