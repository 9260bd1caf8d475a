"""Queries of the window family with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as S
from ..operators import windows as W
from ..sources import views as V
from .oracle import _LIST, sql


def _cands(s, d):
    windows = W.build_windows(V.segments(s, d))
    return W.candidates(S.last_answers(V.window_answers(windows), ["video_id", "window_no"], "answer_no"), windows)


def _fitted(s, d):
    return W.fit_boundaries(_cands(s, d), V.segments(s, d))


def _joined(df):
    return df.withColumn("tags", F.array_join("tags", "|"))


def _strategy(s, d):
    seg = V.segments(s, d)
    return W.window_strategy(seg, V.window_answers(W.build_windows(seg)))


_ENDS = "".join(T.SENTENCE_ENDS)
_PHRASES = " OR ".join(f"starts_with(opening, '{p}')" for p in T.CONTINUATION_PHRASES)
_CTE = {
    "last_ord": "SELECT video_id, max(ord) AS n1 FROM segments GROUP BY video_id",
    "chain": """SELECT video_id, 1 AS window_no, 0::BIGINT AS i, coalesce(bad - 1, n1) AS j, n1 FROM last_ord o JOIN segments f USING (video_id),
        LATERAL (SELECT min(x.ord) AS bad FROM segments x WHERE x.video_id = f.video_id AND x.ord > f.ord AND x.end_ms - f.start_ms > 150000) b WHERE f.ord = 0
      UNION ALL SELECT c.video_id, window_no + 1, nx, coalesce((SELECT min(y.ord) FROM segments y WHERE y.video_id = c.video_id AND y.ord > nx AND y.end_ms - g.start_ms > 150000) - 1, n1), n1
      FROM chain c JOIN segments f ON f.video_id = c.video_id AND f.ord = c.i,
        LATERAL (SELECT least(coalesce(min(x.ord), n1 + 1), j + 1) AS nx FROM segments x WHERE x.video_id = c.video_id AND x.ord > c.i AND x.start_ms >= f.start_ms + 75000) k
        JOIN segments g ON g.video_id = c.video_id AND g.ord = nx WHERE j < n1""",
    "windows": "SELECT video_id, window_no::BIGINT AS window_no, i AS first_ord, j AS last_ord FROM chain",
    "window_answers": """SELECT video_id, window_no, n AS answer_no, (7 * window_no + video_id + n) % 5 AS a, CASE WHEN window_no % 19 <> 5 THEN (7 * window_no + video_id + n) % 5 + 4 + (3 * window_no) % 9 END AS b,
        (37 * window_no + 11 * video_id) % 1001 AS hook_pm, (53 * window_no + 7 * video_id) % 1001 AS complete_pm, (71 * window_no + 3 * video_id) % 1001 AS value_pm
      FROM windows, unnest(CASE WHEN window_no % 17 = 3 THEN [0, 1] ELSE [0] END) t(n) WHERE window_no % 13 <> 12""",
    "cands": """SELECT video_id, window_no, first_ord + least(a, last_ord - first_ord) AS first, first_ord + least(b, last_ord - first_ord) AS last, hook_pm, complete_pm, value_pm,
        (2 * (40 * hook_pm + 35 * complete_pm + 25 * value_pm) + 100) // 200 AS score_pm
      FROM (SELECT * FROM window_answers QUALIFY row_number() OVER (PARTITION BY video_id, window_no ORDER BY answer_no DESC) = 1) JOIN windows USING (video_id, window_no) WHERE b IS NOT NULL""",
    "lines": f"""SELECT video_id, ord, start_ms, end_ms, NOT regexp_matches(regexp_extract(text, '^[^\\p{{L}}]*(\\p{{L}})', 1), '^\\p{{Ll}}') AS s, contains('{_ENDS}', right(rtrim(text), 1)) AND text <> '' AS e, rtrim(text) LIKE '%?' AS q,
        coalesce(list_contains({_LIST(T.CONTINUATION_WORDS)}, words[1]), false) OR {_PHRASES} AS cont
      FROM (SELECT *, array_to_string(words[1:3], ' ') AS opening FROM (SELECT *, regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM segments))""",
    "fit1": "SELECT c.*, coalesce((SELECT max(ord) FROM lines x WHERE x.video_id = c.video_id AND x.s AND x.ord BETWEEN greatest(c.first - 4, 0) AND c.first), greatest(c.first - 4, 0)) AS f FROM cands c",
    "fit2": """SELECT c.*, a.start_ms AS f_ms, b.end_ms - a.start_ms AS span, b.e AS l_end, n1 FROM fit1 c JOIN lines a ON a.video_id = c.video_id AND a.ord = c.f JOIN lines b ON b.video_id = c.video_id AND b.ord = c.last JOIN last_ord o ON o.video_id = c.video_id""",
    "fit3": """SELECT *, (SELECT min(x.ord) FROM lines x LEFT JOIN lines y ON y.video_id = x.video_id AND y.ord = x.ord + 1 WHERE x.video_id = c.video_id AND x.ord >= c.last AND (x.ord = n1 OR x.end_ms - f_ms >= 45000 OR y.end_ms - f_ms > 90000)) AS grown,
        (SELECT max(x.ord) FROM lines x WHERE x.video_id = c.video_id AND x.ord BETWEEN c.f AND c.last - 1 AND x.end_ms - f_ms <= 90000) AS fits,
        (SELECT max(x.ord) FROM lines x WHERE x.video_id = c.video_id AND x.ord BETWEEN c.f AND c.last - 1 AND x.end_ms - f_ms <= 90000 AND x.e) AS fit_ends FROM fit2 c""",
    "fit4": """SELECT *, (SELECT max(x.ord) FROM lines x WHERE x.video_id = c.video_id AND x.ord BETWEEN c.last AND grown AND x.e) AS grown_ends,
        (SELECT CASE WHEN x.end_ms - f_ms <= 90000 THEN x.ord END FROM lines x WHERE x.video_id = c.video_id AND x.ord BETWEEN grown AND grown + 4 AND (x.end_ms - f_ms > 90000 OR x.e) ORDER BY x.ord LIMIT 1) AS grown_stop,
        (SELECT CASE WHEN x.end_ms - f_ms <= 90000 THEN x.ord END FROM lines x WHERE x.video_id = c.video_id AND x.ord BETWEEN c.last AND c.last + 4 AND (x.end_ms - f_ms > 90000 OR x.e) ORDER BY x.ord LIMIT 1) AS last_stop FROM fit3 c""",
    "fit5": """SELECT *, CASE WHEN span > 90000 THEN coalesce(fit_ends, fits, f) WHEN span < 45000 THEN coalesce(grown_stop, grown_ends, grown) WHEN NOT l_end THEN coalesce(last_stop, last) ELSE last END AS l FROM fit4""",
    "fit6": """SELECT *, (SELECT max(x.ord) FROM lines x LEFT JOIN lines y ON y.video_id = x.video_id AND y.ord = x.ord - 1 WHERE x.video_id = c.video_id AND x.ord BETWEEN c.f AND c.l
        AND NOT (x.ord > c.f AND x.q AND (y.end_ms - f_ms) * 10 >= 360000 AND y.e)) AS t FROM fit5 c""",
    "fit7": "SELECT c.*, (NOT a.s OR a.cont) AS loose, b.end_ms AS t_ms FROM fit6 c JOIN lines a ON a.video_id = c.video_id AND a.ord = c.f JOIN lines b ON b.video_id = c.video_id AND b.ord = c.t",
    "fitted": """SELECT video_id, window_no, f AS first, t AS last, f_ms AS start_ms, t_ms AS end_ms, h AS hook_pm, k AS complete_pm, value_pm, CASE WHEN loose THEN (2 * (40 * h + 35 * k + 25 * value_pm) + 100) // 200 ELSE score_pm END AS score_pm,
        concat_ws('|', CASE WHEN f < first THEN 'start_to_sentence' END, CASE WHEN span > 90000 THEN 'trimmed_to_max' WHEN span < 45000 AND l <> last THEN 'extended_to_min' WHEN span >= 45000 AND NOT l_end AND l <> last THEN 'end_to_sentence' END,
          CASE WHEN t < l THEN 'question_end_trimmed' END, CASE WHEN loose THEN 'continuation_start' END) AS tags
      FROM (SELECT *, CASE WHEN loose THEN greatest(0, hook_pm - 250) ELSE hook_pm END AS h, CASE WHEN loose THEN greatest(0, complete_pm - 250) ELSE complete_pm END AS k FROM fit7)""",
    "padded": """SELECT c.* EXCLUDE (start_ms, end_ms), least(c.start_ms, greatest(c.start_ms - 250, coalesce(a.end_ms, 0), 0)) AS start_ms, greatest(c.end_ms, least(c.end_ms + 400, coalesce(b.start_ms, c.end_ms + 400))) AS end_ms
      FROM fitted c LEFT JOIN segments a ON a.video_id = c.video_id AND a.ord = c.first - 1 LEFT JOIN segments b ON b.video_id = c.video_id AND b.ord = c.last + 1""",
    "queue": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score_pm DESC, start_ms, window_no) AS place FROM padded WHERE score_pm >= 450",
    "pick": """SELECT video_id, 0::BIGINT AS place, []::STRUCT(s BIGINT, e BIGINT)[] AS chosen, false AS took FROM last_ord
      UNION ALL SELECT p.video_id, q.place, CASE WHEN ok THEN list_append(chosen, {'s': q.start_ms, 'e': q.end_ms}) ELSE chosen END, ok FROM pick p JOIN queue q ON q.video_id = p.video_id AND q.place = p.place + 1,
        LATERAL (SELECT len(chosen) < 12 AND len(list_filter(chosen, lambda c: least(q.end_ms, c.e) - greatest(q.start_ms, c.s) > 2000)) = 0 AS ok) z""",
    "selected": "SELECT q.*, row_number() OVER (PARTITION BY q.video_id ORDER BY q.place) AS rank FROM queue q JOIN pick p ON p.video_id = q.video_id AND p.place = q.place WHERE took",
}

_TEMPLATE = "Clips of {{MIN_DURATION}} to {{MAX_DURATION}} s:\n{{WINDOWS}}\nAnswer in JSON."


def _outcomes(s, d):
    """Four batches of each recording: three of some failed, one of others found no model."""
    v, b = F.col("video_id"), F.col("batch")
    rows = V.videos(s, d).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.withColumn("outcome", F.when((v % 5 == 2) & (b < 3), "failed").when((v % 25 == 3) & (b == 1), "unavailable").when((v % 5 == 1) & (b < 2), "failed").otherwise("ok"))


QUERIES = {
    "windows": lambda s, d: W.build_windows(V.segments(s, d)),
    "window_candidates": _cands,
    "fitted_candidates": lambda s, d: _joined(_fitted(s, d)),
    "padded_candidates": lambda s, d: W.pad_bounds(_fitted(s, d), V.segments(s, d)).select("video_id", "window_no", "start_ms", "end_ms"),
    "selected_clips": lambda s, d: W.select_clips(V.clips(s, d), 5, 200, tie="clip_no").select("video_id", "rank", "clip_no", "start_ms", "end_ms", "score_pm"),
    "window_strategy": lambda s, d: _joined(_strategy(s, d)).select("video_id", "clip_id", "start_ms", "end_ms", "score_pm", "self_contained", "tags"),
    "window_or_heuristic_clips": lambda s, d: W.with_fallback(_strategy(s, d), V.clips(s, d).withColumn("clip_id", F.format_string("clip_%03d", F.col("clip_no") + 1)), S.batch_verdict(_outcomes(s, d))).select("video_id", "clip_id", "start_ms", "end_ms", "score_pm", "origin"),
    "prompt_batches": lambda s, d: W.prompt_batches(W.window_prompts(W.build_windows(V.segments(s, d)), V.segments(s, d)), _TEMPLATE),
    "window_prompts": lambda s, d: W.window_prompts(W.build_windows(V.segments(s, d)), V.segments(s, d)),
}

_OVERLAP_PICK = {
    "queue_c": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score_pm DESC, start_ms, clip_no) AS place FROM clips WHERE score_pm >= 200",
    "pick_c": """SELECT video_id, 0::BIGINT AS place, []::STRUCT(s BIGINT, e BIGINT)[] AS chosen, false AS took FROM videos
      UNION ALL SELECT p.video_id, q.place, CASE WHEN ok THEN list_append(chosen, {'s': q.start_ms, 'e': q.end_ms}) ELSE chosen END, ok FROM pick_c p JOIN queue_c q ON q.video_id = p.video_id AND q.place = p.place + 1,
        LATERAL (SELECT len(chosen) < 5 AND len(list_filter(chosen, lambda c: least(q.end_ms, c.e) - greatest(q.start_ms, c.s) > 2000)) = 0 AS ok) z""",
}

_PROMPTS = """SELECT video_id, window_no, '### Window w_' || lpad(window_no::VARCHAR, 3, '0') || chr(10) || string_agg('[' || (ord - first_ord) || ' | ' || round_even((start_ms - base) / 1000, 0)::BIGINT || 's] ' || text, chr(10) ORDER BY ord) AS prompt
      FROM (SELECT w.*, s.ord, s.start_ms, s.text, first_value(s.start_ms) OVER (PARTITION BY w.video_id, window_no ORDER BY s.ord) AS base FROM windows w JOIN segments s ON s.video_id = w.video_id AND s.ord BETWEEN first_ord AND last_ord) GROUP BY video_id, window_no"""

SQL = {
    "windows": sql("SELECT * FROM windows", True, **_CTE),
    "window_candidates": sql("SELECT * FROM cands", True, **_CTE),
    "fitted_candidates": sql("SELECT * FROM fitted", True, **_CTE),
    "padded_candidates": sql("SELECT video_id, window_no, start_ms, end_ms FROM padded", True, **_CTE),
    "selected_clips": sql("SELECT q.video_id, row_number() OVER (PARTITION BY q.video_id ORDER BY q.place) AS rank, clip_no, start_ms, end_ms, score_pm FROM queue_c q JOIN pick_c p ON p.video_id = q.video_id AND p.place = q.place WHERE took", True, **_OVERLAP_PICK),
    "window_strategy": sql("SELECT video_id, 'clip_' || lpad(rank::VARCHAR, 3, '0') AS clip_id, start_ms, end_ms, score_pm, complete_pm >= 600 AS self_contained, concat_ws('|', 'llm_window', nullif(tags, '')) AS tags FROM selected", True, **_CTE),
    "window_or_heuristic_clips": sql("""SELECT video_id, 'clip_' || lpad(rank::VARCHAR, 3, '0') AS clip_id, start_ms, end_ms, score_pm, 'windows' AS origin FROM selected WHERE video_id % 5 <> 2 AND video_id % 25 <> 3
      UNION ALL SELECT video_id, 'clip_' || lpad((clip_no + 1)::VARCHAR, 3, '0'), start_ms, end_ms, score_pm, 'heuristic' FROM clips WHERE video_id % 5 = 2 OR video_id % 25 = 3 OR video_id NOT IN (SELECT video_id FROM selected)""", True, **_CTE),
    "window_prompts": sql(_PROMPTS, True, **_CTE),
    "prompt_batches": sql("""SELECT video_id, batch, 'Clips of 45 to 90 s:' || chr(10) || string_agg(prompt, chr(10) || chr(10) ORDER BY window_no) || chr(10) || 'Answer in JSON.' AS prompt
      FROM (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY window_no) - 1) // 4 AS batch FROM wp) GROUP BY video_id, batch""", True, **_CTE, wp=_PROMPTS),
}
