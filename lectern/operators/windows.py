"""Transcript windows, candidates from model answers, boundary fitting, padding and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fold import first_above, fold, ordered, walk
from .scoring import last_answers

SNAP_LINES = 4


def _long(c) -> Column:
    return c.cast("long")


def build_windows(segments: DataFrame, window_ms: int = 150_000, step_ms: int = 75_000, key: str = "video_id") -> DataFrame:
    """(key, window_no from 1, first_ord, last_ord): overlapping runs of whole segments.

    A window takes segments while they end within window_ms of its start; the next one starts at the first
    segment step_ms later, but never past this one's end; the last one reaches the end of the transcript."""
    upto = Window.partitionBy(key).orderBy("ord")
    tops = segments.select(key, "ord", "start_ms", "end_ms", F.max("start_ms").over(upto).alias("top_start"), F.max("end_ms").over(upto).alias("top_end"))
    rows = ordered(tops, [key], ["ord"], ["ord", "start_ms", "end_ms", "top_start", "top_end"]).withColumn("n", F.size("rows"))
    n, at = F.col("n"), lambda c: lambda i: F.get("rows", i)[c]

    def window(e: Column, i: Column) -> Column:
        beyond = first_above(n, at("end_ms"), at("top_end"), i, e["start_ms"] + window_ms)
        later = first_above(n, at("start_ms"), at("top_start"), i, e["start_ms"] + step_ms - 1)
        return F.struct((beyond - 1).alias("last"), F.when(beyond >= n, n).otherwise(F.least(later, beyond)).alias("next"))

    rows = rows.withColumn("made", F.transform("rows", window))
    rows = rows.withColumn("starts", walk(F.transform("made", lambda m: m["next"]), n))
    out = rows.select(key, "rows", "made", F.posexplode("starts").alias("_i", "_s"))
    return out.select(key, _long(F.col("_i") + 1).alias("window_no"), F.get("rows", F.col("_s"))["ord"].alias("first_ord"), F.get("rows", F.get("made", F.col("_s"))["last"])["ord"].alias("last_ord"))


def score_pm(hook: Column, complete: Column, value: Column) -> Column:
    return F.floor((2 * (40 * hook + 35 * complete + 25 * value) + 100) / 200).cast("long")


def _integer(c: str) -> Column:
    """Whole numbers and their texts; a fraction is cut off a number but not taken from a text."""
    return F.expr(f"CASE WHEN {c} RLIKE '^\\\\s*[+-]?[0-9]+\\\\s*$' THEN try_cast({c} AS BIGINT) END")


def candidates(answers: DataFrame, windows: DataFrame, key: str = "video_id") -> DataFrame:
    """Answers (key, window_no, start_line, end_line as text; hook, complete, value in thousandths) placed in
    their windows: lines are clamped to the window, unusable or reversed ones and unknown windows are
    dropped, ratings are clamped to 0..1000 and missing ones count 0."""
    unit = lambda c: F.least(F.lit(1000), F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))).cast("long")
    rows = answers.join(windows.hint("merge"), [key, "window_no"]).withColumn("_n", F.col("last_ord") - F.col("first_ord"))
    clamp = lambda c: F.least(F.greatest(_integer(c), F.lit(0)), F.col("_n"))
    rows = rows.withColumn("_a", clamp("start_line")).withColumn("_b", clamp("end_line"))
    rows = rows.where(_integer("start_line").isNotNull() & _integer("end_line").isNotNull() & (F.col("_b") >= F.col("_a")))
    h, c, v = unit(F.col("hook_pm")), unit(F.col("complete_pm")), unit(F.col("value_pm"))
    return rows.select(key, "window_no", (F.col("first_ord") + F.col("_a")).alias("first"), (F.col("first_ord") + F.col("_b")).alias("last"), h.alias("hook_pm"), c.alias("complete_pm"), v.alias("value_pm"), score_pm(h, c, v).alias("score_pm"))


def fit_boundaries(cands: DataFrame, segments: DataFrame, min_ms: int = 45_000, max_ms: int = 90_000, key: str = "video_id") -> DataFrame:
    """Candidates moved to whole sentences and into the limits, with what was done as `tags`.

    Per candidate over the flags of the lines that its rules can reach, from SNAP_LINES before it to SNAP_LINES behind where
    max_ms ends, cut from its video's array where both meet once; loops of the rules become searches over short index ranges."""
    t = F.col("text")
    flags = segments.select(key, "ord", "start_ms", "end_ms", T.starts_sentence(t).alias("s"), T.ends_sentence(t).alias("e"), F.rtrim(t).endswith("?").alias("q"), T.is_continuation(t).alias("c"), F.max("end_ms").over(Window.partitionBy(key).orderBy("ord")).alias("top"))
    lines = ordered(flags, [key], ["ord"], ["ord", "start_ms", "end_ms", "s", "e", "q", "c", "top"], "lines").withColumn("n", F.size("lines"))
    own = [c for c in cands.columns if c != key]
    listed = cands.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("_cands"))

    def reached(c: Column) -> Column:
        low, at = F.greatest(c["first"] - SNAP_LINES, F.lit(0)).cast("int"), lambda f: lambda i: F.get("lines", i)[f]
        latest = F.array_max(F.transform(F.slice("lines", low + 1, F.greatest(c["first"].cast("int") - low + 1, F.lit(0))), lambda x: x["start_ms"]))
        beyond = first_above(F.col("n"), at("end_ms"), at("top"), c["last"].cast("int"), latest + max_ms)
        size = F.least(F.col("n") - 1, beyond + SNAP_LINES + 1) - low + 1
        return F.struct(c.alias("c"), low.alias("low"), F.slice("lines", low + 1, F.greatest(size, F.lit(0))).alias("lines"))

    met = listed.join(lines.hint("merge"), key)
    rows = met.select(key, "n", F.explode(F.transform("_cands", reached)).alias("_r")).select(key, "n", "_r.c.*", "_r.low", "_r.lines")
    line = lambda i: F.get(F.col("lines"), (i - F.col("low")).cast("int"))
    span = lambda a, b: line(b)["end_ms"] - line(a)["start_ms"]

    def upto(a: Column, b: Column) -> Column:
        return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    n = _long(F.col("n"))
    back = F.greatest(F.col("first") - SNAP_LINES, F.lit(0))
    rows = rows.withColumn("_f", F.coalesce(F.array_max(F.filter(upto(back, F.col("first")), lambda i: line(i)["s"])), back))
    f, last = F.col("_f"), F.col("last")

    def sentence_end(i: Column) -> Column:
        stop = F.array_min(F.filter(upto(i, F.least(n - 1, i + SNAP_LINES)), lambda j: (span(f, j) > max_ms) | line(j)["e"]))
        return F.when(span(f, stop) <= max_ms, stop)

    rows = rows.withColumn("_span", span(f, last))
    fits = F.filter(upto(f, last - 1), lambda j: span(f, j) <= max_ms)
    trimmed = F.coalesce(F.array_max(F.filter(fits, lambda j: line(j)["e"])), F.array_max(fits), f)
    rows = rows.withColumn("_grown", F.array_min(F.filter(upto(last, n - 1), lambda j: (j == n - 1) | (span(f, j) >= min_ms) | (span(f, j + 1) > max_ms))))
    grown = F.coalesce(sentence_end(F.col("_grown")), F.array_max(F.filter(upto(last, F.col("_grown")), lambda j: line(j)["e"])), F.col("_grown"))
    rows = rows.withColumn("_kind", F.when(F.col("_span") > max_ms, "max").when(F.col("_span") < min_ms, "min").when(~line(last)["e"], "end"))
    rows = rows.withColumn("_l", F.when(F.col("_kind") == "max", trimmed).when(F.col("_kind") == "min", grown).when(F.col("_kind") == "end", F.coalesce(sentence_end(last), last)).otherwise(last))
    cut = lambda j: (j > f) & line(j)["q"] & (span(f, j - 1) * 10 >= 8 * min_ms) & line(j - 1)["e"]
    rows = rows.withColumn("_t", F.array_max(F.filter(upto(f, F.col("_l")), lambda j: ~cut(j))))
    loose = ~line(f)["s"] | line(f)["c"]
    less = lambda c: F.when(loose, F.greatest(F.lit(0), F.col(c) - 250)).otherwise(F.col(c)).cast("long")
    moved = F.col("_l") != last
    tags = F.array_compact(F.array(
        F.when(f < F.col("first"), "start_to_sentence"), F.when(F.col("_kind") == "max", "trimmed_to_max").when((F.col("_kind") == "min") & moved, "extended_to_min").when((F.col("_kind") == "end") & moved, "end_to_sentence"),
        F.when(F.col("_t") < F.col("_l"), "question_end_trimmed"), F.when(loose, "continuation_start"),
    ))
    hook, complete = less("hook_pm"), less("complete_pm")
    score = F.when(loose, score_pm(hook, complete, F.col("value_pm"))).otherwise(F.col("score_pm"))
    return rows.select(key, "window_no", f.alias("first"), F.col("_t").alias("last"), line(f)["start_ms"].alias("start_ms"), line(F.col("_t"))["end_ms"].alias("end_ms"), hook.alias("hook_pm"), complete.alias("complete_pm"), "value_pm", score.alias("score_pm"), tags.alias("tags"))


def pad_bounds(fitted: DataFrame, segments: DataFrame, before_ms: int = 250, after_ms: int = 400, key: str = "video_id") -> DataFrame:
    """Clips widened a little, not into the neighbouring lines and never narrowed."""
    w = Window.partitionBy(key).orderBy("ord")
    sides = segments.select(key, "ord", F.lag("end_ms").over(w).alias("prev_end"), F.lead("start_ms").over(w).alias("next_start"))
    left = sides.select(F.col(key).alias("_k1"), F.col("ord").alias("_o1"), "prev_end")
    right = sides.select(F.col(key).alias("_k2"), F.col("ord").alias("_o2"), "next_start")
    rows = fitted.join(left.hint("merge"), (F.col(key) == F.col("_k1")) & (F.col("first") == F.col("_o1"))).join(right.hint("merge"), (F.col(key) == F.col("_k2")) & (F.col("last") == F.col("_o2")))
    start = F.greatest(F.col("start_ms") - before_ms, F.coalesce("prev_end", F.lit(0)), F.lit(0))
    end = F.least(F.col("end_ms") + after_ms, F.coalesce("next_start", F.col("end_ms") + after_ms))
    return rows.withColumn("_s", F.least(start, "start_ms")).withColumn("_e", F.greatest(end, "end_ms")).withColumn("start_ms", F.col("_s")).withColumn("end_ms", F.col("_e")).select(*fitted.columns)


def select_clips(cands: DataFrame, max_clips: int = 12, min_pm: int = 450, max_overlap_ms: int = 2000, key: str = "video_id", tie: str = "window_no") -> DataFrame:
    """The best candidates that overlap no better one by more than max_overlap_ms, with their rank."""
    columns = [c for c in cands.columns if c != key]
    rows = ordered(cands.where(F.col("score_pm") >= min_pm).withColumn("_back", -F.col("score_pm")), [key], ["_back", "start_ms", tie], ["_back", "start_ms", tie, *columns])

    def step(acc: Column, e: Column) -> Column:
        clash = F.exists(acc, lambda s: F.least(e["end_ms"], s["end_ms"]) - F.greatest(e["start_ms"], s["start_ms"]) > max_overlap_ms)
        return F.when(clash | (F.size(acc) >= max_clips), acc).otherwise(F.concat(acc, F.array(e)))

    chosen = rows.select(key, F.posexplode(fold(F.col("rows"), F.slice("rows", 1, 0), step)).alias("_i", "_c"))
    return chosen.select(key, _long(F.col("_i") + 1).alias("rank"), *[F.col("_c")[c].alias(c) for c in columns])


def window_strategy(segments: DataFrame, answers: DataFrame, **limits) -> DataFrame:
    """The whole strategy: windows, candidates, boundaries, padding, selection."""
    last = last_answers(answers, ["video_id", "window_no"], "answer_no")
    fitted = fit_boundaries(candidates(last, build_windows(segments)), segments)
    chosen = select_clips(pad_bounds(fitted, segments), **limits)
    tags = F.concat(F.array(F.lit("llm_window")), "tags")
    return chosen.withColumn("clip_id", F.format_string("clip_%03d", "rank")).withColumn("self_contained", F.col("complete_pm") >= 600).withColumn("tags", tags)


def with_fallback(chosen: DataFrame, heuristic: DataFrame, verdicts: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """Clips of the strategy; for videos without any, and for those whose run of the model was not valid (verdicts: as of
    batch_verdict; a video without a verdict counts as valid), the heuristic ones."""
    columns = [key, "clip_id", "start_ms", "end_ms", "score_pm"]
    if verdicts is not None:
        chosen = chosen.join(verdicts.where(~F.col("valid")).select(key).hint("merge"), key, "left_anti")
    rest = heuristic.join(chosen.select(key).distinct().hint("merge"), key, "left_anti")
    return chosen.select(*columns, F.lit("windows").alias("origin")).union(rest.select(*columns, F.lit("heuristic").alias("origin")))


def prompt_batches(prompts: DataFrame, template: str, size: int = 4, min_ms: int = 45_000, max_ms: int = 90_000, key: str = "video_id") -> DataFrame:
    """(key, batch from 0, prompt): window_prompts in batches of `size`, parted by empty lines and filled into the template at
    {{WINDOWS}}, with {{MIN_DURATION}} and {{MAX_DURATION}} in whole seconds."""
    order = Window.partitionBy(key).orderBy("window_no")
    rows = prompts.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("window_no", "prompt"))), lambda x: x["prompt"])
    whole = rows.groupBy(key, "batch").agg(F.array_join(listed, "\n\n").alias("_w"))
    filled = F.replace(F.lit(template), F.lit("{{WINDOWS}}"), F.col("_w"))
    for name, ms in (("MIN", min_ms), ("MAX", max_ms)):
        filled = F.replace(filled, F.lit("{{" + name + "_DURATION}}"), F.lit(str(ms // 1000)))
    return whole.select(key, "batch", filled.alias("prompt"))


def window_prompts(windows: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, window_no, prompt): a heading and a numbered line with its offset for each segment."""
    rows = windows.join(segments.hint("merge"), key).where(F.col("ord").between(F.col("first_ord"), F.col("last_ord")))
    base = F.first_value("start_ms").over(Window.partitionBy(key, "window_no").orderBy("ord"))
    rows = rows.withColumn("_offset", F.bround((F.col("start_ms") - base) / 1000, 0).cast("long"))
    line = F.concat(F.lit("["), F.col("ord") - F.col("first_ord"), F.lit(" | "), F.col("_offset"), F.lit("s] "), F.trim("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "window_no").agg(body.alias("_b")).select(key, "window_no", F.concat(F.lit("### Window w_"), F.lpad(F.col("window_no").cast("string"), 3, "0"), F.lit("\n"), "_b").alias("prompt"))

