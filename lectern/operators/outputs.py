"""What is handed on: clip records, manifests, suggestion texts, crop parameters, render keys, keywords."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as T

#: Candidates of several recordings that are embedded at a time.
TERMS_AT_ONCE = 1 << 16


def clip_json(clips: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, clip_id, json): one JSON record for each clip, seconds in place of milliseconds."""
    sec = lambda c: F.col(c) / 1000
    body = F.struct(F.col("clip_id").alias("id"), sec("start_ms").alias("start"), sec("end_ms").alias("end"), sec("score_pm").alias("score"))
    return clips.select(key, "clip_id", F.to_json(body).alias("json"))


def write_clip_json(clips: DataFrame, path: str, key: str = "video_id") -> None:
    """The records as JSON lines in a folder for each recording."""
    clip_json(clips, key).select(key, F.col("json").alias("value")).write.partitionBy(key).text(path)


def manifest(clips: DataFrame, key: str = "video_id") -> DataFrame:
    """Per recording: number of clips, their whole length, and their ids in order of time."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "clip_no"))), lambda x: x["clip_no"].cast("string"))
    return clips.groupBy(key).agg(F.count(F.lit(1)).alias("n_clips"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.array_join(ordered, ",").alias("clips"))


def suggestion_text(suggestions: DataFrame, clock: Column, key: str = "video_id") -> DataFrame:
    """(key, text): a line "clock suggestion [keywords]" for each suggestion; no brackets without keywords."""
    words = F.when(F.col("keywords") != "", F.concat(F.lit(" ["), "keywords", F.lit("]"))).otherwise("")
    line = F.concat(clock, F.lit(" "), F.col("suggestion"), words)
    return suggestions.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def with_crops(clips: DataFrame, crops: DataFrame, default_x: int, key: str = "video_id") -> DataFrame:
    """Clips with the crop of the same bounds in hundredths of a second; of several the last, of none the
    centre. crops: key, start_ms, end_ms, crop_no, crop_x."""
    cs = lambda c: F.floor((F.col(c) + 5) / 10)
    last = crops.groupBy(F.col(key).alias("_k"), cs("start_ms").alias("_s"), cs("end_ms").alias("_e")).agg(F.max_by("crop_x", "crop_no").alias("_x"))
    rows = clips.join(last.hint("merge"), (F.col(key) == F.col("_k")) & (cs("start_ms") == F.col("_s")) & (cs("end_ms") == F.col("_e")), "left")
    return rows.withColumn("crop_x", F.coalesce("_x", F.lit(default_x))).drop("_k", "_s", "_e", "_x")


def render_keys(clips: DataFrame, columns: list[str]) -> DataFrame:
    """clips with render_key, the hash of what their rendering depends on, columns in order of name."""
    return clips.withColumn("render_key", F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]), 256))


def reusable(keyed: DataFrame, rendered: DataFrame, keys=("video_id", "clip_no")) -> DataFrame:
    """Clips whose earlier rendering has the same key."""
    return keyed.join(rendered.select(*keys, "render_key").hint("merge"), [*keys, "render_key"], "left_semi")


def _candidate_lists(segments: DataFrame, key: str) -> DataFrame:
    """(key, _text, _terms): the whole text of each recording and the array of its keyword_candidates."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    words = F.filter(T.tokens(F.col("_text")), lambda w: F.length(w) >= 2)
    # A one-row generator stands between the steps, so that the words are found once.
    rows = segments.groupBy(key).agg(F.array_join(lines, " ").alias("_text")).select(key, "_text", F.explode(F.array(words)).alias("_w"))
    pairs = F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return rows.select(key, "_text", F.array_distinct(F.concat("_w", pairs)).alias("_terms"))


def keyword_candidates(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, term): the distinct words of two characters or more of each recording, and the pairs of such words that stand
    next to each other."""
    return _candidate_lists(segments, key).select(key, F.explode("_terms").alias("term"))


def embedded(texts: DataFrame, column: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """texts with `vector` (array<double>), what embed, a model of the caller, gives for lists of at most `batch` texts of
    column. It runs in the workers, batch by batch, on Arrow data."""
    names = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors = pa.array([[float(x) for x in v] for v in embed(part.column(names.index(column)).to_pylist())], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*names, "vector"])

    return texts.mapInArrow(run, StructType([*texts.schema.fields, StructField("vector", ArrayType(DoubleType()))]))


def keywords(segments: DataFrame, embed: Callable[[list[str]], list[list[float]]], n: int = 10, key: str = "video_id", batch: int = 256) -> DataFrame:
    """(key, term, rank): the candidates of each recording nearest by cosine to its whole text, as embed sees both. Equal
    cosines go in order of the term; a zero vector has cosine 0.

    The terms of a recording are ranked in its row, so no term is shuffled. embed is given lists of at most `batch` texts; recordings
    that lie next to each other, of about TERMS_AT_ONCE candidates together, have each distinct term embedded once."""
    at_once = TERMS_AT_ONCE

    def cosines(vectors: list[list[float]], d: list[float]) -> np.ndarray:
        """Cosines with d, summed from the first dimension on; 0 where a vector is zero or of another length."""
        fits = np.array([len(v) == len(d) for v in vectors], bool)
        m = np.array([v for v in vectors if len(v) == len(d)], np.float64).reshape(-1, len(d))
        dot, a, b = np.zeros(len(m)), np.zeros(len(m)), 0.0
        with np.errstate(all="ignore"):
            for i, x in enumerate(np.array(d, np.float64)):
                dot, a, b = dot + m[:, i] * x, a + m[:, i] * m[:, i], b + x * x
            norm = np.sqrt(a * b)
            out = np.zeros(len(vectors))
            out[fits] = np.where(norm == 0, 0.0, dot / np.where(norm == 0, 1.0, norm))
        return out

    def vectors(texts: list[str]) -> list[list[float]]:
        return [v for at in range(0, len(texts), batch) for v in embed(texts[at : at + batch])]

    def ranked(rows: pa.RecordBatch) -> pa.RecordBatch:
        terms = rows.column(2).to_pylist()
        names = list(dict.fromkeys(t for listed in terms for t in listed))
        known, whole = dict(zip(names, vectors(names))), vectors(rows.column(1).to_pylist())
        at, kept = [], []
        for k, listed in enumerate(terms):
            cosine = cosines([known[t] for t in listed], whole[k])
            value = np.where(np.isnan(cosine), np.inf, cosine)  # not a number comes first, as in Spark
            if len(listed) > n:
                least = np.partition(value, len(listed) - n)[len(listed) - n]
                chosen = np.flatnonzero(value >= least).tolist()
            else:
                chosen = range(len(listed))
            best = sorted(chosen, key=lambda i: (-value[i], listed[i]))[:n]
            at += [k] * len(best)
            kept += [(listed[i], r) for r, i in enumerate(best, 1)]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), pa.array([t for t, _ in kept], pa.string()), pa.array([r for _, r in kept], pa.int32())], names=[key, "term", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            low = 0
            while low < b.num_rows:
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + at_once, "right")))
                yield ranked(b.slice(low, high - low))
                low = high

    rows = _candidate_lists(segments, key).where(F.size("_terms") > 0)
    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("term", StringType(), False), StructField("rank", IntegerType(), False)]))


def nearest_terms(terms: DataFrame, vectors: DataFrame, n: int = 10, key: str = "video_id") -> DataFrame:
    """(key, term, rank): terms nearest by cosine to the sum of all term vectors of their recording.

    vectors: term, vector, from any model of the caller; terms without one take no part. Equal cosines go
    in order of the term."""
    held = vectors.select(F.col("term").alias("_t"), "vector").where(F.size("vector") > 0)
    rows = terms.select(key, "term").join(held.hint("merge"), F.col("term") == F.col("_t"))
    # Vectors stay arrays: one row for each recording with its terms, of which extract_terms gives a bounded number.
    rows = rows.groupBy(key).agg(F.collect_list(F.struct("term", "vector")).alias("_l"))
    zero = rows.schema["_l"].dataType.elementType["vector"].dataType.elementType
    zero = F.lit(0).cast("double" if zero.typeName() in ("float", "double") else "long")
    total = lambda a, use: F.aggregate(a, zero, lambda acc, x: acc + F.coalesce(use(x), zero))
    widest = F.array_max(F.transform("_l", lambda x: F.size(x["vector"])))
    whole = F.transform(F.sequence(F.lit(0), widest - 1), lambda d: total(F.col("_l"), lambda x: F.get(x["vector"], d)))
    rows = rows.select(key, whole.alias("_w"), F.explode("_l").alias("_x")).select(key, "_x.term", "_x.vector", "_w")
    both = F.arrays_zip(F.col("vector").alias("v"), F.slice("_w", 1, F.size("vector")).alias("w"))
    part = lambda use: total(both, use)
    sums = rows.select(key, "term", part(lambda x: x["v"] * x["w"]).alias("dot"), part(lambda x: x["v"] * x["v"]).alias("a"), part(lambda x: x["w"] * x["w"]).alias("b"))
    cosine = F.col("dot") / F.sqrt((F.col("a") * F.col("b")).cast("double"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(cosine.desc(), "term"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n).select(key, "term", "rank")


def carry_over_blocks(answers: DataFrame, key: str = "video_id") -> DataFrame:
    """Chapters of consecutive blocks (key, block_no, chapter_no, is_final): of a block that is not the last, the
    last of several chapters is dropped, as the next block takes it up again."""
    w = Window.partitionBy(key, "block_no")
    back = F.row_number().over(w.orderBy(F.desc("chapter_no")))
    n = F.count(F.lit(1)).over(w)
    return answers.withColumn("_b", back).withColumn("_n", n).where(F.col("is_final") | (F.col("_b") > 1) | (F.col("_n") == 1)).drop("_b", "_n")
