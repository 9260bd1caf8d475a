"""Queries on outputs with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chapters as C
from ..operators import outputs as P
from ..operators import scoring as S
from ..sources import views as V
from .oracle import sql


def _crops(s, d):
    c = V.clips(s, d).where("clip_no % 2 = 0").withColumn("crop_no", F.explode(F.array(F.lit(1), F.lit(2))))
    return c.select("video_id", (F.col("start_ms") + 3).alias("start_ms"), "end_ms", "crop_no", (F.col("clip_no") * 10 + F.col("crop_no")).alias("crop_x"))


def _keyed(s, d, salt):
    return P.render_keys(V.clips(s, d).withColumn("version", F.when(F.col("clip_no") % 3 == 0, salt).otherwise("v")), ["start_ms", "end_ms", "version"])


def _vectors(s, d):
    terms = S.extract_terms(V.segments(s, d)).select("term").distinct()
    digit = lambda i: F.conv(F.substring(F.md5(F.col("term").cast("binary")), i, 1), 16, 10).cast("long")
    return terms.where("length(term) % 7 <> 0").select("term", F.array(*[digit(i) for i in range(1, 9)]).alias("vector"))


def _blocks(s, d):
    b = C.pack_blocks(V.segments(s, d), 1500)
    rows = b.withColumn("chapter_no", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("video_id") + F.col("block_no")) % 3)))
    last = F.max("block_no").over(Window.partitionBy("video_id"))
    return rows.select("video_id", "block_no", "chapter_no", (F.col("block_no") == last).alias("is_final"))


def _keywords(s, d):
    def digits(texts):  # a stand-in for a model, sent to the workers by value: eight digits of the MD5 of a text
        from hashlib import md5

        return [[int(c, 16) for c in md5(t.encode()).hexdigest()[:8]] for t in texts]

    return P.keywords(V.segments(s, d), digits)


QUERIES = {
    "keywords": _keywords,
    "clip_records": lambda s, d: P.clip_json(V.clips(s, d).withColumn("clip_id", F.format_string("clip_%03d", F.col("clip_no") + 1))).select("video_id", "clip_id", F.get_json_object("json", "$.id").alias("id"), F.round(F.get_json_object("json", "$.start").cast("double") * 1000).cast("long").alias("start_ms")),
    "manifests": lambda s, d: P.manifest(V.clips(s, d)),
    "suggestion_texts": lambda s, d: P.suggestion_text(C.leading_suggestions(V.segments(s, d)), T.clock(F.col("start_ms"), F.lit(False))),
    "cropped_clips": lambda s, d: P.with_crops(V.clips(s, d), _crops(s, d), 656).select("video_id", "clip_no", "crop_x"),
    "reusable_renders": lambda s, d: P.reusable(_keyed(s, d, "new"), _keyed(s, d, "old")).select("video_id", "clip_no"),
    "nearest_terms": lambda s, d: P.nearest_terms(S.extract_terms(V.segments(s, d)), _vectors(s, d)),
    "carried_chapters": lambda s, d: P.carry_over_blocks(_blocks(s, d)).select("video_id", "block_no", "chapter_no"),
}

_WALK = {
    "walk": """SELECT video_id, 0::BIGINT AS ord, 0::BIGINT AS block_no, length(trim(text)) + 9 AS used FROM segments WHERE ord = 0
      UNION ALL SELECT s.video_id, s.ord, CASE WHEN ok THEN block_no ELSE block_no + 1 END, CASE WHEN ok THEN used ELSE 0 END + length(trim(text)) + 9 FROM walk w JOIN segments s ON s.video_id = w.video_id AND s.ord = w.ord + 1, LATERAL (SELECT w.used + length(trim(s.text)) + 9 <= 1500 AS ok) z""",
    "listed": "SELECT DISTINCT video_id, block_no, max(block_no) OVER (PARTITION BY video_id) AS final FROM walk",
}
SQL = {
    "keywords": sql("""SELECT video_id, term, rank FROM (
      SELECT c.video_id, term, row_number() OVER (PARTITION BY c.video_id ORDER BY coalesce(dot / nullif(sqrt((a * b)::DOUBLE), 0), 0) DESC, term) AS rank FROM (
        SELECT video_id, term, sum(x * y)::DOUBLE AS dot, sum(x * x)::DOUBLE AS a, sum(y * y)::DOUBLE AS b FROM (
          SELECT video_id, term, ('0x' || substr(md5(term), i, 1))::BIGINT AS x, ('0x' || substr(md5(whole), i, 1))::BIGINT AS y FROM kw_terms, range(1, 9) t(i)) GROUP BY video_id, term) c) WHERE rank <= 10""",
      kw_words="SELECT video_id, whole, list_filter(regexp_extract_all(lower(whole), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2) AS ws FROM (SELECT video_id, string_agg(text, ' ' ORDER BY ord) AS whole FROM segments GROUP BY video_id)",
      kw_terms="SELECT DISTINCT video_id, whole, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM kw_words"),
    "clip_records": sql("SELECT video_id, 'clip_' || lpad((clip_no + 1)::VARCHAR, 3, '0') AS clip_id, 'clip_' || lpad((clip_no + 1)::VARCHAR, 3, '0') AS id, start_ms FROM clips"),
    "manifests": sql("SELECT video_id, count(*) AS n_clips, sum(end_ms - start_ms)::BIGINT AS total_ms, string_agg(clip_no::VARCHAR, ',' ORDER BY start_ms, clip_no) AS clips FROM clips GROUP BY video_id"),
    "suggestion_texts": sql("""SELECT video_id, string_agg(CASE WHEN x < 6000 THEN lpad((x // 60)::VARCHAR, 2, '0') ELSE (x // 60)::VARCHAR END || ':' || lpad((x % 60)::VARCHAR, 2, '0') || ' ' || CASE WHEN len(w) > 0 THEN 'Illustrative footage for: "' || array_to_string(w[1:6], ' ') || '" [' || array_to_string(w[1:3], ', ') || ']' ELSE 'Illustrative footage' END, chr(10) ORDER BY ord) AS text
      FROM (SELECT *, start_ms // 1000 AS x, greatest(1, count(*) OVER (PARTITION BY video_id) // 10) AS step, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM segments) WHERE ord % step = 0 AND ord < step * 10 GROUP BY video_id"""),
    "cropped_clips": sql("SELECT video_id, clip_no, CASE WHEN clip_no % 2 = 0 THEN clip_no * 10 + 2 ELSE 656 END AS crop_x FROM clips"),
    "reusable_renders": sql("SELECT video_id, clip_no FROM clips WHERE clip_no % 3 <> 0"),
    "nearest_terms": sql("""SELECT video_id, term, rank FROM (SELECT video_id, term, row_number() OVER (PARTITION BY video_id ORDER BY dot / sqrt((a * b)::DOUBLE) DESC, term) AS rank FROM (
        SELECT video_id, term, sum(v * w)::BIGINT AS dot, sum(v * v)::BIGINT AS a, sum(w * w)::BIGINT AS b FROM (SELECT *, sum(v) OVER (PARTITION BY video_id, i)::BIGINT AS w FROM dims) GROUP BY video_id, term)) WHERE rank <= 10""",
      dims="SELECT video_id, term, i, ('0x' || substr(md5(term), i::INT, 1))::BIGINT AS v FROM terms, range(1, 9) t(i) WHERE length(term) % 7 <> 0"),
    "carried_chapters": sql("SELECT video_id, block_no, c AS chapter_no FROM listed, unnest(range(0, (video_id + block_no) % 3 + 1)) t(c) WHERE block_no = final OR c < (video_id + block_no) % 3 OR (video_id + block_no) % 3 = 0", True, **_WALK),
}
