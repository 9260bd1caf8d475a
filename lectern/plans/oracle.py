"""DuckDB SQL for the domain tables of lectern.sources.views, as common table expressions by name."""

from __future__ import annotations

import re

from ..functions import text as T

_SENT = r"[^.!?\n]+[.!?]*"


def _sentences(source: str, keys: str) -> str:
    return f"""SELECT {keys}, ord, start_ms, start_ms + dur AS end_ms, text FROM (
      SELECT {keys}, ord, dur, text, coalesce(sum(dur + 100) OVER (PARTITION BY {keys} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM (
        SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS ord, 400 + 60 * length(text) AS dur, text FROM (
          SELECT {keys}, i, trim(l[i]) AS text FROM (SELECT {keys}, regexp_extract_all(text, '{_SENT}') AS l FROM {source}), unnest(range(1, len(l) + 1)) t(i)) WHERE text <> ''))"""


_CLIP = "(i * 41000 + video_id * 700) % 600000"
_START = f"CASE WHEN video_id % 5 = 2 AND i = 7 THEN (246000 + video_id * 700) % 600000 + 3 ELSE {_CLIP} END"
_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _present(phrases: list[str]) -> str:
    single = [p for p in phrases if " " not in p]
    parts = [f"len(list_intersect(list_distinct(words), {_LIST(single)}))"]
    parts += [f"regexp_matches(lower(text), '{T.phrase_pattern(p)}')::INT" for p in phrases if " " in p]
    return " + ".join(parts)


_COPULA = " + ".join(f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}\\s+[\\p{{L}}\\p{{N}}_]')::INT" for w in ("is", "are"))

COVERED = """SELECT video_id, clip_no, short_no, b::BIGINT AS covered_ms, total::BIGINT AS total_ms, CASE WHEN total > 0 THEN b * 1000 // total ELSE 0 END::BIGINT AS covered_pm FROM (
      SELECT c.video_id, clip_no, short_no, sum(least(c.end_ms, source_end_ms) - greatest(c.start_ms, source_start_ms)) AS b FROM clips c JOIN pieces p ON c.video_id = p.video_id AND source_end_ms > c.start_ms AND source_start_ms < c.end_ms GROUP BY ALL)
      JOIN (SELECT video_id, short_no, sum(source_end_ms - source_start_ms) AS total FROM pieces GROUP BY ALL) USING (video_id, short_no)"""
BEST = """SELECT s.video_id, s.short_no, clip_no, coalesce(covered_pm, 0) AS covered_pm FROM shorts s LEFT JOIN (SELECT * FROM covered WHERE covered_ms > 0 AND total_ms > 0) c ON s.video_id = c.video_id AND s.short_no = c.short_no
      QUALIFY row_number() OVER (PARTITION BY s.video_id, s.short_no ORDER BY covered_ms DESC NULLS LAST, clip_no) = 1"""

CTES: dict[str, str] = {
    "segments": _sentences("(SELECT doc_id AS video_id, text FROM documents)", "video_id"),
    "chunks": "SELECT conv_id AS video_id, turn AS chunk, 60 * length(text) AS dur_ms FROM conversations",
    "chunk_segments": _sentences("(SELECT conv_id AS video_id, turn AS chunk, text FROM conversations)", "video_id, chunk"),
    "terms": f"""SELECT video_id, term, weight, rank FROM (
      SELECT video_id, term, weight, row_number() OVER (PARTITION BY video_id ORDER BY weight DESC, first_ord, first_pos) AS rank FROM (
        SELECT video_id, term, count(*) * length(term) AS weight, min(ord * 1000000 + i) // 1000000 AS first_ord, min(ord * 1000000 + i) % 1000000 AS first_pos FROM (
          SELECT video_id, ord, i, w[i] AS term FROM (SELECT video_id, ord, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM segments), unnest(range(1, len(w) + 1)) t(i))
        WHERE length(term) > 3 AND NOT list_contains({_LIST(T.STOP_WORDS)}, term) GROUP BY video_id, term)) WHERE rank <= 50""",
    "scored": f"""SELECT video_id, ord, start_ms, end_ms, text, self_contained, term_pm, definition_pm, rhetorical_pm, self_pm, score_pm,
        list_filter([CASE WHEN definition_pm >= 500 THEN 'definition' END, CASE WHEN rhetorical_pm >= 500 THEN 'engaging' END, CASE WHEN term_pm >= 500 THEN 'high_term_density' END,
          CASE WHEN self_contained THEN 'self_contained' END, CASE WHEN len(hit) > 0 THEN 'terms:' || array_to_string(hit[1:3], ',') END], lambda x: x IS NOT NULL) AS tags
      FROM (SELECT *, (w > 0 AND p * 100 < 15 * w) AS self_contained,
          CASE WHEN w > 0 THEN (2000 * f + w) // (2 * w) ELSE 0 END AS term_pm, CASE WHEN w > 0 THEN d * 250 ELSE 0 END AS definition_pm, CASE WHEN w > 0 THEN r * 10 ELSE 0 END AS rhetorical_pm,
          CASE WHEN w > 0 THEN (2000 * s + 1200 * w) // (2400 * w) ELSE 0 END AS self_pm,
          CASE WHEN w > 0 THEN (2 * (1800 * f + 525 * w * d + 9 * w * r + s) + 6 * w) // (12 * w) ELSE 0 END AS score_pm
        FROM (SELECT *, least(w, 10 * len(hit)) AS f, CASE WHEN p * 20 < w THEN 1200 * w WHEN p * 5 > w THEN 0 ELSE 1600 * (w - 5 * p) END AS s,
            CASE WHEN nd = 0 THEN 0 ELSE least(4, nd + 1) END AS d, least(100, least(70, nr * 15) + q * 30) AS r
          FROM (SELECT *, CASE WHEN ru THEN {_present(T.DEFINITION_RU)} ELSE {_present(T.DEFINITION_EN)} + {_COPULA} END AS nd,
              q + CASE WHEN ru THEN {_present(T.RHETORICAL_RU)} ELSE {_present(T.RHETORICAL_EN)} END AS nr,
              len(list_filter(words, lambda x: list_contains(CASE WHEN ru THEN {_LIST(T.PRONOUNS_RU)} ELSE {_LIST(T.PRONOUNS_EN)} END, x))) AS p
            FROM (SELECT s.*, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS words, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w,
                contains(text, '?')::INT AS q, len(regexp_extract_all(text, '[а-яА-Яё]')) * 2 > len(regexp_extract_all(text, '\\p{{L}}')) AS ru,
                list_filter(coalesce(t.terms, []), lambda x: contains(lower(text), x)) AS hit
              FROM segments s LEFT JOIN (SELECT video_id AS tv, list(term ORDER BY rank) AS terms FROM terms GROUP BY video_id) t ON s.video_id = t.tv))))""",
    "segment_answers": """SELECT video_id, ord, n AS answer_no, CASE WHEN ord % 19 = 5 THEN 'n/a' ELSE ((37 * ord + 11 * video_id + 100 * n) % 1001)::VARCHAR END AS llm_pm,
        ['definition', 'example', 'story'][ord % 3 + 1] AS content_type, (71 * ord + 3 * video_id) % 1001 AS virality_pm
      FROM segments, unnest(CASE WHEN ord % 17 = 3 THEN [0, 1] ELSE [0] END) t(n) WHERE ord % 13 <> 12""",
    "blended": """SELECT s.* EXCLUDE (score_pm, tags), CASE WHEN llm IS NOT NULL THEN (2 * (score_pm * 600 + llm * 400) + 1000) // 2000 ELSE score_pm END AS score_pm,
        list_concat(tags, list_filter([CASE WHEN llm IS NOT NULL AND NOT list_contains(tags, content_type) THEN 'llm:' || content_type END, CASE WHEN llm IS NOT NULL AND virality_pm >= 700 THEN 'viral_potential' END], lambda x: x IS NOT NULL)) AS tags
      FROM scored s LEFT JOIN (SELECT video_id AS av, ord AS ao, try_cast(llm_pm AS BIGINT) AS llm, content_type, virality_pm FROM segment_answers
        QUALIFY row_number() OVER (PARTITION BY video_id, ord ORDER BY answer_no DESC) = 1) a ON s.video_id = av AND s.ord = ao""",
    "videos": "SELECT doc_id AS video_id FROM documents",
    "clips": f"SELECT video_id, i AS clip_no, {_START} AS start_ms, {_START} + 45000 + (i * 7000) % 45000 AS end_ms, (i * 37 + video_id * 11) % 1001 AS score_pm FROM videos, range(0, 12) t(i) WHERE video_id % 11 <> 7",
    "clips_b": f"SELECT video_id, i AS clip_no, {_START} + 3000 AS start_ms, {_START} + 48000 + (i * 7000) % 45000 AS end_ms, (i * 37 + video_id * 11) % 1001 AS score_pm FROM videos, range(0, 12) t(i) WHERE video_id % 11 <> 7",
    "shorts": "SELECT video_id, s AS short_no, (video_id + s) % 7 = 0 AS montage, (video_id + s) % 5 = 0 AS reordered, CASE WHEN (video_id + s) % 3 > 0 THEN (video_id * 500 + s * 190000) % 600000 END AS span_start_ms FROM videos, range(0, 3) t(s)",
    "pieces": """SELECT video_id, short_no, p AS piece, b AS source_start_ms, CASE WHEN (video_id + short_no) % 17 = 3 THEN b ELSE b + 9000 + (p * 4000 + video_id * 10) % 6000 END AS source_end_ms, ((video_id + short_no) % 3 - p) * 15000 AS short_start_ms
      FROM (SELECT video_id, s AS short_no, p, (video_id * 500 + s * 190000 + p * 23000) % 600000 AS b FROM videos, range(0, 3) t(s), unnest(range(0, (video_id + s) % 3 + 1)) u(p))""",
    "interval_labels": f"SELECT video_id, i AS clip_no, {_CLIP} + 5000 AS start_ms, {_CLIP} + 50000 + (i * 7000) % 45000 AS end_ms, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'keep' ELSE 'edit' END AS label FROM (SELECT doc_id AS video_id, doc_id % 12 AS i, quality, toxic FROM labels)",
    "reviews": "SELECT video_id, clip_no, start_ms + o AS start_ms, CASE WHEN video_id % 9 > 0 THEN end_ms + o END AS end_ms, label AS status, 'note ' || video_id AS notes FROM (SELECT *, CASE WHEN video_id % 2 = 0 THEN 40 ELSE 60 END - 5000 AS o FROM interval_labels)",
    "covered": COVERED,
    "matches": """SELECT * FROM (SELECT video_id, clip_no, label, CASE WHEN u > 0 THEN b * 1000 // u ELSE 0 END AS iou_pm FROM (SELECT video_id, clip_no, label, b, la + lb - b AS u FROM (
      SELECT c.video_id, c.clip_no, label, greatest(0, least(c.end_ms, l.end_ms) - greatest(c.start_ms, l.start_ms)) AS b, c.end_ms - c.start_ms AS la, l.end_ms - l.start_ms AS lb FROM clips c JOIN interval_labels l ON c.video_id = l.video_id))) WHERE iou_pm >= 500""",
    "best": BEST,
    "found": "SELECT *, clip_no IS NOT NULL AND covered_pm >= 700 AS found FROM best",
    "counted": "SELECT f.* FROM found f JOIN shorts s ON f.video_id = s.video_id AND f.short_no = s.short_no WHERE NOT montage",
    "precise": "SELECT DISTINCT video_id, clip_no FROM (SELECT c.video_id, clip_no FROM covered c JOIN shorts s ON c.video_id = s.video_id AND c.short_no = s.short_no WHERE NOT montage AND covered_pm >= 700 UNION ALL SELECT video_id, clip_no FROM matches WHERE label IN ('keep', 'edit'))",
    "in_run": "SELECT video_id FROM videos WHERE video_id % 13 <> 5",
    "jobs": """SELECT o_orderkey AS job_id, o_custkey AS user_id, s AS status, o_orderdate AS created_at, b AS started_at, CASE WHEN o_orderkey % 23 <> 0 THEN b + to_minutes(7 + o_orderkey % 240) END AS completed_at,
        'uploads/' || o_orderkey % 5000 AS input_source, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS sources_removed_at
      FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS s, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_orderkey % 60) END AS b FROM orders)""",
    "files": """SELECT CASE WHEN n >= 1000000 AND n % 50 = 0 THEN 'uploads/' || n || '.part' ELSE 'uploads/' || n END AS path, n * 37 % 900000 + 1000 AS bytes, make_timestamp((997401600 - n % 97 * 3600) * 1000000) AS mtime FROM (
      SELECT DISTINCT o_orderkey % 5000 AS n FROM orders UNION ALL SELECT DISTINCT o_orderkey % 5000 + 1000000 FROM orders WHERE o_orderkey % 5000 % 10 = 0)""",
    "job_events": """SELECT user_id AS job_id, event_id AS id, ts, CASE event_type WHEN 'signup' THEN 'job_requeued' WHEN 'view' THEN 'stage_started' WHEN 'click' THEN 'stage_completed' WHEN 'error' THEN 'stage_failed' WHEN 'purchase' THEN 'job_completed' END AS event_type,
        ['ingest', 'transcribe', 'score', 'track', 'render'][event_id % 5 + 1] AS stage FROM events""",
    "detections": """SELECT user_id AS clip_id, n, n * 1000 AS t_ms, floor(value * 4)::BIGINT % 1600 AS x, 100 AS y, w, w * 14 // 10 AS h, CASE WHEN event_type = 'error' THEN 0 ELSE 600 + event_id % 400 END AS conf_pm, event_type = 'signup' AS cut
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, 120 + 40 * (event_id % 3) AS w FROM events)""",
}


def sql(body: str, recursive: bool = False, **more: str) -> str:
    """body with the common table expressions that it names, in the order they need each other."""
    ctes = CTES | more
    order: list[str] = []

    def need(text: str) -> None:
        for name in ctes:
            if name not in order and re.search(rf"\b{name}\b", text) and text is not ctes[name]:
                need(ctes[name])
                if name not in order:
                    order.append(name)

    need(body)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({ctes[n]})" for n in order) + "\n" + body if order else body
