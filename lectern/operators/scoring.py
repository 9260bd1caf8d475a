"""Transcript scoring: terms, segment scores, blending with model ratings, merging and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fold import first_above, fold, made_once, ordered, rank_of, running_max, walk

#: What an answer to a segment holds besides its key and ord.
ANSWER = ["answer_no", "llm_pm", "content_type", "virality_pm"]
MEASURES = ["term_pm", "definition_pm", "rhetorical_pm", "self_pm"]


def _wanted(w: Column) -> Column:
    return (F.length(w) > 3) & ~w.isin([x for x in T.STOP_WORDS if len(x) > 3])


def extract_terms(segments: DataFrame, top_n: int = 50, key: str = "video_id") -> DataFrame:
    """(key, term, weight, rank): words of more than three letters that are no stop words, by count times
    length; ties by first occurrence. Long videos are combined before the shuffle."""
    words = segments.select(key, "ord", F.posexplode(F.filter(T.tokens(F.col("text")), _wanted)).alias("pos", "term"))
    # One number for the place, so that counts and places are kept in a hash table and nothing is sorted by term.
    place = F.shiftleft(F.col("ord").cast("long"), 31) + F.col("pos")
    counted = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    counted = counted.select(key, "term", (F.col("n") * F.length("term")).alias("weight"), "first")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top_n).select(key, "term", "weight", "rank")


def _counts(text: Column, lower: Column, words: Column, russian: Column, terms: Column) -> list[Column]:
    """What the scores of a segment are made of. lower, words and russian: of its text, each computed once."""
    found = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.contains(lower, x))
    return [
        found.alias("_found"), T.word_count(text).cast("long").alias("_w"), T.definition_quarters(lower, words, russian).cast("long").alias("_d"),
        T.rhetorical_hundredths(lower, words, russian).cast("long").alias("_r"), T.pronoun_count(words, russian).cast("long").alias("_p"),
    ]


def _scores(c: Callable[[str], Column]) -> list[Column]:
    """The scores by what c gives of _counts."""
    w, p, d, r = c("_w"), c("_p"), c("_d"), c("_r")
    hits = F.least(w, 10 * F.size(c("_found")).cast("long"))
    self600 = F.when(p * 20 < w, 1200 * w).when(p * 5 > w, 0).otherwise(1600 * (w - 5 * p))  # 1200 w stands for 1
    total = 1800 * hits + 525 * w * d + 9 * w * r + self600
    some = w > 0
    half = lambda top, bottom: F.when(some, F.floor((2 * top + bottom) / (2 * bottom))).otherwise(0).cast("long")
    contained = some & (p * 100 < 15 * w)
    return [
        contained.alias("self_contained"), half(1000 * hits, w).alias("term_pm"), F.when(some, d * 250).otherwise(0).cast("long").alias("definition_pm"),
        F.when(some, r * 10).otherwise(0).cast("long").alias("rhetorical_pm"), half(1000 * self600, 1200 * w).alias("self_pm"), half(total, 6 * w).alias("score_pm"),
    ]


def _tags(c: Callable[[str], Column]) -> Column:
    """The tags by what c gives of _scores, and by _found."""
    return F.array_compact(F.array(
        F.when(c("definition_pm") >= 500, "definition"), F.when(c("rhetorical_pm") >= 500, "engaging"), F.when(c("term_pm") >= 500, "high_term_density"),
        F.when(c("self_contained"), "self_contained"), F.when(F.size(c("_found")) > 0, F.concat(F.lit("terms:"), F.array_join(F.slice(c("_found"), 1, 3), ","))),
    ))


def score_segments(segments: DataFrame, terms: DataFrame, key: str = "video_id") -> DataFrame:
    """segments with term_pm, definition_pm, rhetorical_pm, self_pm, score_pm, tags and self_contained.

    Weights 30, 35, 15 and 20 percent. Terms count where they occur as part of the text."""
    listed = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t")).select(F.col(key).alias("_k"), F.col("_t.term").alias("_terms"))
    rows = segments.join(listed.hint("merge"), F.col(key) == F.col("_k"), "left")
    t = F.col("text")
    # What several measures need is one column, made once for a segment: a projection that is used twice is not merged away.
    rows = rows.withColumn("_lower", F.lower(t)).withColumn("_words", T.words(F.col("_lower"))).withColumn("_russian", T.is_russian(t))
    rows = rows.select(*segments.columns, *_counts(t, F.col("_lower"), F.col("_words"), F.col("_russian"), F.col("_terms")))
    rows = rows.select(*segments.columns, "_found", *_scores(F.col))
    return rows.withColumn("tags", _tags(F.col)).drop("_found")


def last_answers(answers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several answers to one thing the last counts."""
    rest = [c for c in answers.columns if c not in keys]
    return answers.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_a")).select(*keys, "_a.*")


def blend_answers(scored: DataFrame, answers: DataFrame, weight_pm: int = 400, keys=("video_id", "ord")) -> DataFrame:
    """scored with score_pm moved towards the model's rating and its tags added; ratings that are no numbers
    change nothing. The bare content type is compared with the tags, its tag is written llm:<type>."""
    last = last_answers(answers, list(keys), "answer_no").select(*[F.col(k).alias(f"_{k}") for k in keys], F.expr("try_cast(llm_pm AS BIGINT)").alias("_llm"), "content_type", "virality_pm")
    rows = scored.join(last.hint("merge"), [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    score, tags = _blended(F.col("score_pm"), F.col("tags"), F.col, weight_pm)
    return rows.withColumn("_tags", tags).withColumn("score_pm", score).withColumn("tags", F.col("_tags")).select(*scored.columns)


def _blended(score: Column, tags: Column, answer: Callable[[str], Column], weight_pm: int) -> tuple[Column, Column]:
    """Score and tags with those of an answer: _llm (its rating, null if that is no number), content_type, virality_pm."""
    llm, content = answer("_llm"), answer("content_type")
    rated = llm.isNotNull()
    mixed = F.floor((2 * (score * (1000 - weight_pm) + llm * weight_pm) + 1000) / 2000).cast("long")
    kind = F.when(rated & (content != "") & ~F.array_contains(tags, content), F.concat(F.lit("llm:"), content))
    viral = F.when(rated & (answer("virality_pm") >= 700) & ~F.array_contains(tags, "viral_potential"), "viral_potential")
    return F.when(rated, mixed).otherwise(score), F.array_compact(F.concat(tags, F.array(kind, viral)))


def _half_even(a: Column, b: Column) -> Column:
    s = a + b
    low = F.floor(s / 2)
    return (low + F.when((s % 2 == 1) & (low % 2 == 1), 1).otherwise(0)).cast("long")


def merge_clips(scored: DataFrame, max_ms: int = 90_000, key: str = "video_id") -> DataFrame:
    """Neighbouring segments joined greedily while the clip stays within max_ms: the score is the largest,
    sub-scores are halved pair by pair (half to even), tags united in order, self_contained only if all are. Where the clip that begins at a segment would end is found by
    a search; the clips are a walk along these ends, so that a recording takes time in proportion (but for a logarithm)."""
    columns = ["start_ms", "ord", "end_ms", "score_pm", *MEASURES, "self_contained", "tags"]
    top = F.max("end_ms").over(Window.partitionBy(key).orderBy("start_ms", "ord"))
    rows = ordered(scored.select(key, *columns, top.alias("top")), [key], ["start_ms", "ord"], [*columns, "top"])
    return _merged(made_once(rows, "top", F.transform("rows", lambda x: x["top"])), max_ms).select(key, F.inline("clips"))


def _merged(rows: DataFrame, max_ms: int) -> DataFrame:
    """rows (with `rows`, an array of segments in order, and `top`, the largest end up to each) with the array `clips`."""
    rows = rows.withColumn("n", F.size("rows"))
    n, at = F.col("n"), lambda i: F.get("rows", i)["end_ms"]

    def following(e: Column, i: Column) -> Column:
        latest = e["start_ms"] + max_ms
        return F.when(e["end_ms"] > latest, i + 1).otherwise(first_above(n, at, lambda i: F.get("top", i), i, latest))

    rows = made_once(rows, "starts", walk(F.transform("rows", following), n))
    parts = F.transform("starts", lambda s, i: F.slice("rows", s + 1, F.coalesce(F.get("starts", i + 1), n) - s))

    def halved(g: Column) -> Column:
        one = F.get(g, F.lit(0))
        start = F.struct(*[one[m].alias(m) for m in MEASURES])
        return fold(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), start, lambda a, e: F.struct(*[_half_even(a[m], e[m]).alias(m) for m in MEASURES]))

    def clip(x: Column, i: Column) -> Column:
        g, most = x["g"], lambda c: F.array_max(F.transform(x["g"], lambda e: e[c]))
        return F.struct(
            F.format_string("clip_%03d", i + 1).alias("clip_id"), F.get(g, F.lit(0))["start_ms"].alias("start_ms"), most("end_ms").alias("end_ms"), most("score_pm").alias("score_pm"), *[x["h"][m].alias(m) for m in MEASURES],
            F.forall(g, lambda e: e["self_contained"]).alias("self_contained"), F.array_distinct(F.flatten(F.transform(g, lambda e: e["tags"]))).alias("tags"), F.size(g).cast("long").alias("n_segments"),
        )

    return rows.withColumn("clips", F.transform(F.transform(parts, lambda g: F.struct(g.alias("g"), halved(g).alias("h"))), clip)).drop("rows", "top", "n", "starts")


def duration_filter(clips: DataFrame, min_ms: int = 45_000, max_ms: int = 90_000) -> DataFrame:
    return clips.where((F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms))


def duration_filter_or_all(clips: DataFrame, min_ms: int = 45_000, max_ms: int = 90_000, key: str = "video_id") -> DataFrame:
    """As duration_filter, but a video that would lose all its clips keeps all of them."""
    fits = (F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms)
    any_fits = F.max(fits).over(Window.partitionBy(key))
    return clips.withColumn("_fits", fits).withColumn("_any", any_fits).where("_fits or not _any").drop("_fits", "_any")


def score_filter(clips: DataFrame, min_pm: int = 450) -> DataFrame:
    return clips.where(F.col("score_pm") >= min_pm)


def counted_score_filter(clips: DataFrame, min_pm: int = 450) -> tuple[DataFrame, Observation]:
    """score_filter and an Observation, which holds the counts `before` and `after` once the result has been written or
    counted; it costs no scan of its own."""
    seen = Observation()
    kept = F.count_if(F.coalesce(F.col("score_pm") >= min_pm, F.lit(False)))
    return clips.observe(seen, F.count(F.lit(1)).alias("before"), kept.alias("after")).where(F.col("score_pm") >= min_pm), seen


def top_clips(clips: DataFrame, n: int = 12, key: str = "video_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score_pm"), "start_ms"))
    return clips.withColumn("rank", rank).where(F.col("rank") <= n)


def score_transcript(segments: DataFrame, answers: DataFrame | None = None, max_ms: int = 90_000, min_ms: int = 45_000, min_pm: int = 450, top_n: int = 12, key: str = "video_id") -> DataFrame:
    """The whole job: terms, scores, model ratings, merging, filters, the best clips of each video. Segments and answers are
    dealt once, by key; the rest is score_recordings."""
    line, answer = F.struct("ord", "start_ms", "end_ms", "text"), F.struct("ord", *ANSWER)
    if answers is None:
        return score_recordings(segments.groupBy(key).agg(F.collect_list(line).alias("segments")), max_ms, min_ms, min_pm, top_n, key)
    rows = segments.select(key, line.alias("_s")).unionByName(answers.select(key, answer.alias("_a")), allowMissingColumns=True)
    return score_recordings(rows.groupBy(key).agg(F.collect_list("_s").alias("segments"), F.collect_list("_a").alias("answers")), max_ms, min_ms, min_pm, top_n, key)


def score_recordings(recordings: DataFrame, max_ms: int = 90_000, min_ms: int = 45_000, min_pm: int = 450, top_n: int = 12, key: str = "video_id") -> DataFrame:
    """score_transcript where each recording lies in a row: key, segments (an array of ord, start_ms, end_ms, text) and answers (an
    array of ord and ANSWER; it may be absent). All is done in that row; no word, segment or clip is shuffled."""
    rows = _merged(_in_order(_answered(_scored_lines(recordings, key), key), key), max_ms)
    fits = lambda c: (c["end_ms"] - c["start_ms"]).between(min_ms, max_ms)
    any_fits = F.array_max(F.transform("clips", fits))
    rows = rows.withColumn("_c", F.when(any_fits, F.filter("clips", fits)).when(~any_fits, F.col("clips")))
    best = F.sort_array(F.transform(F.filter("_c", lambda c: c["score_pm"] >= min_pm), lambda c, i: F.struct((-c["score_pm"]).alias("s"), c["start_ms"].alias("t"), i.alias("i"), c.alias("c"))))
    rows = rows.select(key, F.posexplode(F.slice(best, 1, top_n)).alias("_i", "_b"))
    return rows.select(key, "_b.c.*", (F.col("_i") + 1).alias("rank"))


def _terms_of(words: Column, rows: DataFrame, top_n: int = 50) -> DataFrame:
    """rows with _terms, the terms of extract_terms by rank, found in the row among its words in their order: equal words come
    together when sorted, so that no term is shuffled."""
    rows = made_once(rows, "_sorted", F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("first")))))
    n, at = F.size("_sorted"), lambda i: F.get("_sorted", i)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = made_once(rows, "_heads", F.filter(places, lambda i: (i == 0) | (at(i)["term"] != at(i - 1)["term"])))
    weight = lambda h, j: (F.coalesce(F.get("_heads", j + 1), n) - h).cast("long") * F.length(at(h)["term"])
    best = F.sort_array(F.transform("_heads", lambda h, j: F.struct((-weight(h, j)).alias("less"), at(h)["first"].alias("first"), at(h)["term"].alias("term"))))
    return made_once(rows, "_terms", F.transform(F.slice(best, 1, top_n), lambda x: x["term"])).drop("_sorted", "_heads")


def _scored_lines(recordings: DataFrame, key: str) -> DataFrame:
    """recordings with _lines in place of segments: ord, start_ms, end_ms and what score_segments adds, by ord."""
    rest = [c for c in recordings.columns if c != "segments"]
    lines = F.sort_array(F.transform("segments", lambda s: F.struct(s["ord"].alias("ord"), s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), s["text"].alias("text"))))
    lowered = F.transform(lines, lambda s: F.struct(s.alias("s"), F.lower(s["text"]).alias("lower"), T.is_russian(s["text"]).alias("russian")))
    read = F.transform(lowered, lambda x: F.struct(x["s"].alias("s"), x["lower"].alias("lower"), x["russian"].alias("russian"), T.words(x["lower"]).alias("words")))
    rows = made_once(recordings, "_read", read).select(*rest, "_read")
    rows = _terms_of(F.flatten(F.transform("_read", lambda x: F.filter(F.coalesce(x["words"], F.array().cast("array<string>")), _wanted))), rows)
    times = lambda x: [x["s"][c].alias(c) for c in ("ord", "start_ms", "end_ms")]
    counted = F.transform("_read", lambda x: F.struct(*times(x), *_counts(x["s"]["text"], x["lower"], x["words"], x["russian"], F.col("_terms"))))
    held = lambda x, made: F.struct(*[x[c].alias(c) for c in ("ord", "start_ms", "end_ms", "_found")], *made)
    scored = F.transform(counted, lambda x: held(x, _scores(lambda c: x[c])))
    own = ["ord", "start_ms", "end_ms", "score_pm", *MEASURES, "self_contained"]
    return rows.select(*rest, F.transform(scored, lambda x: F.struct(*[x[c].alias(c) for c in own], _tags(lambda c: x[c]).alias("tags"))).alias("_lines"))


def _answered(rows: DataFrame, key: str, weight_pm: int = 400) -> DataFrame:
    """rows with their _lines as blend_answers has them; the answer to a line is the last of its ord, found by a search."""
    if "answers" not in rows.columns:
        return rows
    usable = F.filter(F.coalesce("answers", F.array().cast(rows.schema["answers"].dataType)), lambda a: a["ord"].isNotNull() & a["answer_no"].isNotNull())
    usable = F.sort_array(F.transform(usable, lambda a: F.struct(a["ord"].alias("ord"), a["answer_no"].alias("answer_no"), a["llm_pm"].try_cast("long").alias("_llm"), a["content_type"].alias("content_type"), a["virality_pm"].alias("virality_pm"))))
    rows = made_once(rows, "_usable", usable)
    n = F.size("_usable")

    def met(x: Column) -> Column:
        last = F.get("_usable", rank_of(n, lambda i: F.get("_usable", i)["ord"], x["ord"]) - 1)
        return F.struct(x.alias("x"), last.alias("a"))

    def blended(y: Column) -> Column:
        x = y["x"]
        score, tags = _blended(x["score_pm"], x["tags"], lambda c: F.when(y["a"]["ord"] == x["ord"], y["a"][c]), weight_pm)
        made = {"score_pm": score, "tags": tags}
        return F.struct(*[made.get(c, x[c]).alias(c) for c in ("ord", "start_ms", "end_ms", "score_pm", *MEASURES, "self_contained", "tags")])

    return rows.select(key, F.transform(F.transform("_lines", met), blended).alias("_lines"))


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    """(key, rows, top), as _merged takes them: the lines by start_ms and ord."""
    columns = ["start_ms", "ord", "end_ms", "score_pm", *MEASURES, "self_contained", "tags"]
    rows = made_once(rows, "rows", F.sort_array(F.transform("_lines", lambda x: F.struct(*[x[c].alias(c) for c in columns])))).select(key, "rows")
    return made_once(rows, "top", running_max(F.transform("rows", lambda x: x["end_ms"])))


def best_segments(scored: DataFrame, n: int = 40, key: str = "video_id") -> DataFrame:
    """The candidates worth an expensive call: the n best by score, in time order on ties."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score_pm"), "ord"))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def batches(rows: DataFrame, size: int = 15, key: str = "video_id", order: str = "ord") -> DataFrame:
    """Consecutive batches of `size` within key, numbered from 0."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))


def batch_verdict(results: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, batches, failed, valid): a run is invalid if more than half of its batches failed or one found
    the model unavailable. results: key, batch, outcome ok / failed / unavailable."""
    bad = F.count_if(F.col("outcome") != "ok")
    gone = F.count_if(F.col("outcome") == "unavailable")
    n = F.count(F.lit(1))
    return results.groupBy(key).agg(n.alias("batches"), bad.alias("failed"), ((bad * 2 <= n) & (gone == 0)).alias("valid"))
