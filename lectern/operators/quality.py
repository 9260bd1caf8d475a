"""Rules on artifacts, and what has to be computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transcript_reaches_end(segments: DataFrame, media: DataFrame, key: str = "video_id") -> DataFrame:
    """Does the last segment end near the end: not before duration - min(60 s, max(10 s, a tenth)), and not
    later than 2 % and a second behind it? media: key, duration_ms."""
    last = segments.groupBy(key).agg(F.max("end_ms").alias("end_ms"))
    d = F.col("duration_ms")
    slack = F.least(F.lit(60_000), F.greatest(F.lit(10_000), F.floor(d / 10)))
    ok = (F.col("end_ms") >= d - slack) & (F.col("end_ms") * 100 <= d * 102 + 100_000)
    return media.join(last.hint("merge"), key, "left").select(key, F.coalesce(ok, F.lit(False)).alias("complete"))


def valid_chapters(chapters: DataFrame, media: DataFrame, key: str = "video_id") -> DataFrame:
    """First chapter at 0, all within the duration, starts strictly increasing in their order."""
    before = F.lag("start_ms").over(Window.partitionBy(key).orderBy("chapter_no"))
    rows = chapters.withColumn("_before", before).join(media.hint("merge"), key)
    fine = F.when(F.col("_before").isNull(), F.col("start_ms") == 0).otherwise(F.col("start_ms") > F.col("_before")) & (F.col("start_ms") <= F.col("duration_ms"))
    return rows.groupBy(key).agg(F.bool_and(fine).alias("valid"))


#: Required keys of each kind of artifact; lists are judged by their first entry.
REQUIRED = {
    "meta": ["source", "duration_sec", "resolution", "fps"],
    "transcript": ["start", "end", "text"],
    "scored": ["id", "start", "end", "score"],
    "crop": ["clip_id", "start", "end", "frames", "fallback"],
    "manifest": ["total_clips", "clips"],
}
LISTS = ["transcript", "scored", "crop"]


def artifact_rules(artifacts: DataFrame) -> DataFrame:
    """(video_id, artifact, rule, ok) for the raw JSON texts of the kinds in REQUIRED: not_empty, parses, shape (an object,
    or a list that begins with one), has_keys, values (types and ranges: a duration above 0 and a resolution of two; a
    number as score; a list of frames; a whole number of clips from 0 on and a list of them). A rule holds only if those
    before it do; a text of another kind has no shape."""
    kind, body = F.col("artifact"), F.trim(F.coalesce("body", F.lit("")))
    parsed = F.try_parse_json(body)
    head = F.when(kind.isin(LISTS), F.try_variant_get(parsed, "$[0]", "variant")).otherwise(parsed)
    rows = artifacts.select("video_id", "artifact", body.alias("_body"), parsed.alias("_all"), head.alias("_head"))

    def typed(path: str, *names: str) -> Column:
        shape = F.schema_of_variant(F.try_variant_get("_head", path, "variant"))
        return F.coalesce(shape.rlike("^(" + "|".join(names) + ")"), F.lit(False))

    number = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    is_list = F.schema_of_variant("_all").startswith("ARRAY")
    shape = F.coalesce(F.when(kind.isin(LISTS), is_list).otherwise(F.lit(True)) & kind.isin(list(REQUIRED)) & F.schema_of_variant("_head").startswith("OBJECT"), F.lit(False))
    # A key is there even if its value is null: that value is a variant, not nothing.
    there = [F.when(kind == k, F.array(*[F.try_variant_get("_head", f"$.{x}", "variant").isNotNull() for x in v])) for k, v in REQUIRED.items()]
    has = F.forall(F.coalesce(*there, F.array(F.lit(False))), lambda x: x)
    first = lambda path, to: F.try_variant_get("_head", path, to)
    values = (
        F.when(kind == "meta", typed("$.duration_sec", *number) & (first("$.duration_sec", "double") > 0) & typed("$.resolution", "ARRAY") & (F.size(first("$.resolution", "array<variant>")) == 2))
        .when(kind == "scored", typed("$.score", *number))
        .when(kind == "crop", typed("$.frames", "ARRAY"))
        .when(kind == "manifest", typed("$.total_clips", "BIGINT") & (first("$.total_clips", "bigint") >= 0) & typed("$.clips", "ARRAY"))
        .otherwise(F.lit(True))
    )
    found = [("not_empty", F.col("_body") != ""), ("parses", F.col("_all").isNotNull()), ("shape", shape), ("has_keys", has), ("values", F.coalesce(values, F.lit(False)))]
    out, so_far = [], F.lit(True)
    for rule, ok in found:
        so_far = so_far & ok
        out.append(F.struct(F.lit(rule).alias("rule"), so_far.alias("ok")))
    return rows.select("video_id", "artifact", F.inline(F.array(*out)))


def resume_plan(stages: list[tuple[int, str]], rules: DataFrame, videos: DataFrame | None = None, key: str = "video_id", force: bool = False) -> DataFrame:
    """The first stage (number, artifact) of each video whose artifact is absent or breaks a rule.

    videos (key): all there are, so that one without any artifact begins with the first stage; without it, those that rules
    names. force: every video begins with the first stage."""
    each = rules.groupBy(key, "artifact").agg(F.bool_and("ok").alias("good"))
    good = each.groupBy(key).agg(F.collect_set(F.when(F.col("good"), F.col("artifact"))).alias("_good"))
    good = good if videos is None else videos.select(key).distinct().join(good.hint("merge"), key, "left")
    none = F.array().cast("array<string>")
    listed = F.array(*[F.struct(F.lit(n).alias("no"), F.lit(a).alias("artifact")) for n, a in sorted(stages)])
    usable = none if force else F.coalesce("_good", none)
    resume = F.get(F.filter(listed, lambda s: ~F.array_contains(usable, s["artifact"])), F.lit(0))["no"]
    return good.select(key, resume.alias("resume_from")).where("resume_from is not null")


def content_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def cache_plan(items: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Items with whether their content key is in the cache: what is computed again and what is reused."""
    have = cache.select(key).distinct().withColumn("_hit", F.lit(True))
    return items.join(have.hint("merge"), key, "left").select(*items.columns, F.coalesce("_hit", F.lit(False)).alias("reuse"))


def terms_of_tags(clips: DataFrame) -> DataFrame:
    """Clips with the terms of their terms: tag as an array."""
    tag = F.get(F.filter("tags", lambda t: t.startswith("terms:")), F.lit(0))
    return clips.withColumn("terms", F.coalesce(F.split(F.regexp_replace(tag, "^terms:", ""), ","), F.array().cast("array<string>")))
