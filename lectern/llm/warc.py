"""Not-modified revisits of a web archive resolved against the latest earlier full response.

A crawler that gets 304 Not Modified stores a revisit record without a body. An as-of join by canonical URL
finds the latest full response before it; if a validator agrees, the revisit stands for that response
with its headers brought up to date by those that a 304 may carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The headers that a 304 has in place of those of a 200 (RFC 9110, 15.4.5), and last-modified, which it
#: may have without an ETag; they replace stored ones, all other stored headers stay.
UPDATES = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Statuses of full responses with a body; a part (206) or an empty body (204, 205) answers no revisit.
FULL = [200, 203]
#: Query parameters that name a visit, not a document.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Length of the spans of time that a URL's records are divided into, in seconds, and records of a span from which
#: it is divided further.
SPAN, SPAN_ROWS = 86_400, 50_000


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without www. and default port, no fragment, no tracking
    parameters, no slash at the end."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    path = F.regexp_replace(path, r"/+$", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, span: int = SPAN, span_rows: int = SPAN_ROWS) -> DataFrame:
    """records (record_id, url, ts timestamp, status int, headers map<string,string>) -> one row for each
    revisit (status 304): record_id, url_key, ts, response_id, response_ts, outcome, headers.

    The response is the latest full one (status in FULL) of the canonical URL strictly before the revisit;
    of responses at one time the largest record_id. outcome: resolved; no_response; no_validator (the
    revisit has neither ETag nor Last-Modified, or the response has not the one); changed (ETags differ
    by weak comparison, or without an ETag the Last-Modified dates differ). headers: of the response,
    updated by those of the revisit in UPDATES, if resolved; else the revisit's own. Header names are read in
    lower case, the first of equal ones counts. A null url or ts finds no response; records of another or no status
    play no part. Repeated records are records like any other; other columns are left out.

    A URL's records are divided by spans of time, so that no task holds all of a much visited URL: within
    a span the latest response is a window's running maximum, before it the greatest of earlier spans. A span that
    holds more than span_rows records and a thousandth of all is divided evenly; records of one instant stay together."""
    lower = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(F.map_keys("headers"), lambda k: F.lower(k))),
            lambda k: F.struct(k, F.element_at(F.map_values(F.map_filter("headers", lambda n, _: F.lower(n) == k)), 1)),
        )
    )
    empty = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id",
        canonical_url(F.col("url")).alias("url_key"),
        "ts",
        "status",
        F.coalesce(lower, empty).alias("headers"),
    ).where((F.col("status") == 304) | F.col("status").isin(FULL))
    rows = materialize(rows, "records")
    full = F.col("status") != 304
    response = F.when(full, F.struct("ts", "record_id", F.map_entries("headers").alias("entries")))
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    micros = F.unix_micros("ts")
    placed = rows.where(known).withColumn("_response", response).withColumn("_day", (F.floor(micros / (span * 1_000_000)) * (span * 1_000_000)).cast("long"))
    # Fewer than a thousand spans can hold a thousandth of the records each.
    least = max(span_rows, rows.count() // 1000)
    busy = placed.groupBy("url_key", "_day").count().where(F.col("count") > least)
    width = F.greatest(F.lit(1), (F.lit(span * 1_000_000) / F.ceil(F.col("count") / span_rows)).cast("long"))
    busy = busy.select(F.col("url_key").alias("_k"), F.col("_day").alias("_d"), width.alias("_width"))
    placed = placed.join(F.broadcast(busy), (F.col("url_key") == F.col("_k")) & (F.col("_day") == F.col("_d")), "left")
    begun = F.when(F.col("_width").isNull(), F.col("_day")).otherwise(F.col("_day") + (F.floor((micros - F.col("_day")) / F.col("_width")) * F.col("_width")).cast("long"))
    placed = placed.withColumn("_span", begun).drop("_day", "_k", "_d", "_width")
    spans = placed.groupBy("url_key", "_span").agg(F.max("_response").alias("_last"))
    earlier = Window.partitionBy("url_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("url_key").alias("_k"), F.col("_span").alias("_s"), F.max("_last").over(earlier).alias("_before"))
    # Full responses sort behind revisits of the same time: strictly earlier ones count.
    running = Window.partitionBy("url_key", "_span").orderBy("ts", full).rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("_within", F.max("_response").over(running)).where("status = 304").drop("_response")
    seen = seen.join(spans.hint("merge"), (F.col("url_key") == F.col("_k")) & (F.col("_span") == F.col("_s")), "left").drop("_k", "_s", "_span")
    nothing = F.lit(None).cast(seen.schema["_within"].dataType)
    seen = seen.unionByName(rows.where(~known & (F.col("status") == 304)).withColumn("_within", nothing).withColumn("_before", nothing))
    found = F.coalesce("_within", "_before")
    seen = seen.withColumn("_r", found).withColumn("_old", F.map_from_entries(F.coalesce("_r.entries", F.map_entries(empty))))
    weak = lambda m: F.regexp_replace(F.col(m)["etag"], r"^W/", "")
    outcome = (
        F.when(F.col("_r").isNull(), "no_response")
        .when(weak("headers").isNotNull() & weak("_old").isNotNull(), F.when(weak("headers") == weak("_old"), "resolved").otherwise("changed"))
        .when(
            weak("headers").isNull() & F.col("headers")["last-modified"].isNotNull() & F.col("_old")["last-modified"].isNotNull(),
            F.when(F.col("headers")["last-modified"] == F.col("_old")["last-modified"], "resolved").otherwise("changed"),
        )
        .otherwise("no_validator")
    )
    updates = F.map_filter("headers", lambda k, _: k.isin(UPDATES))
    stays = F.map_filter("_old", lambda k, _: ~F.map_contains_key(updates, k))
    return seen.withColumn("outcome", outcome).select(
        "record_id",
        "url_key",
        "ts",
        F.col("_r.record_id").alias("response_id"),
        F.col("_r.ts").alias("response_ts"),
        "outcome",
        F.when(F.col("outcome") == "resolved", F.map_concat(stays, updates)).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl made from pages: each page is fetched, some again with new content, many
    revisited under another spelling of the URL, with and without matching validators."""
    at = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    p = F.col("page_id")
    tag = lambda *x: F.concat(F.lit('"'), F.md5(F.concat(*x).cast("binary")), F.lit('"'))
    html = F.coalesce("html", F.lit(""))
    body = [F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(html).cast("string")]

    def record(kind: int, status: int, seconds: Column, url: Column, *headers: Column) -> Column:
        return F.struct((p * 4 + kind).alias("record_id"), url.alias("url"), at(seconds).alias("ts"), F.lit(status).alias("status"), F.create_map(*headers).alias("headers"))

    date = lambda seconds: [F.lit("Date"), seconds.cast("string")]
    modified = [F.lit("Last-Modified"), (p % 1000).cast("string")]
    first, again, back, later = p * 60, p * 60 + 40_000, p * 60 + 3600 + p % 7 * 20_000, p * 60 + 200_000
    spelled = F.concat(F.regexp_replace("url", r"#.*$", ""), F.lit("#seen"))
    old = tag(html)
    rows = F.array(
        record(0, 200, first, F.col("url"), *body, F.lit("ETag"), old, *modified, *date(first)),
        F.when(p % 6 == 0, record(1, 206, first + 1800, F.col("url"), F.lit("Content-Range"), F.lit("bytes 0-9/10"), F.lit("ETag"), old, *date(first))),
        F.when(p % 5 == 0, record(1, 200, again, F.col("url"), *body, F.lit("ETag"), tag(html, F.lit("2")), *modified, *date(again))),
        F.when(
            p % 3 == 0,
            F.when(p % 15 == 3, record(2, 304, back, spelled, *date(back)))
            .when(p % 15 == 6, record(2, 304, back, spelled, *date(back), *modified))
            .otherwise(record(2, 304, back, spelled, *date(back), F.lit("etag"), F.concat(F.lit("W/"), old), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60"))),
        ),
        F.when(p % 4 == 1, record(3, 304, later, F.upper(F.substring_index("url", "/", 3)), *date(later), F.lit("ETag"), old)),
    )
    return pages.where(p.isNotNull()).select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def op9_warc_revisits(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    names = ["cache-control", "content-length", "content-type", "date", "etag", "last-modified"]
    return out.select(
        "record_id",
        "url_key",
        F.unix_seconds("ts").alias("ts"),
        "response_id",
        F.unix_seconds("response_ts").alias("response_ts"),
        "outcome",
        *[F.col("headers")[n].alias(n.replace("-", "_")) for n in names],
    )


def _canonical_sql(url: str) -> str:
    u = f"regexp_replace(trim({url}), '#.*$', '')"
    rest = f"regexp_replace({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/?]*)', 1)), '^www\\.', ''), ':(?:80|443)$', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    query = f"regexp_replace(regexp_replace(regexp_extract({rest}, '\\?(.*)$', 1), '(^|&){TRACKING}=[^&]*', '', 'g'), '^&', '')"
    return f"{host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


OP9_SQL = f"""
WITH p AS (SELECT page_id AS p, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
full_responses AS (
  SELECT p * 4 AS id, url, p * 60 AS s, '"' || md5(html) || '"' AS etag, p, html, 200 AS status FROM p
  UNION ALL SELECT p * 4 + 1, url, p * 60 + 1800, '"' || md5(html) || '"', p, html, 206 FROM p WHERE p % 6 = 0
  UNION ALL SELECT p * 4 + 1, url, p * 60 + 40000, '"' || md5(html || '2') || '"', p, html, 200 FROM p WHERE p % 5 = 0),
revisits AS (
  SELECT p * 4 + 2 AS id, regexp_replace(url, '#.*$', '') || '#seen' AS url, p * 60 + 3600 + p % 7 * 20000 AS s,
    CASE WHEN p % 15 IN (3, 6) THEN NULL ELSE 'W/"' || md5(html) || '"' END AS etag,
    CASE WHEN p % 15 = 6 THEN (p % 1000)::VARCHAR END AS modified,
    CASE WHEN p % 15 IN (3, 6) THEN NULL ELSE 'max-age=60' END AS cache,
    CASE WHEN p % 15 IN (3, 6) THEN NULL ELSE '0' END AS size
  FROM p WHERE p % 3 = 0
  UNION ALL
  SELECT p * 4 + 3, upper(array_to_string(string_split(url, '/')[1:3], '/')), p * 60 + 200000, '"' || md5(html) || '"', NULL, NULL, NULL
  FROM p WHERE p % 4 = 1),
f AS (SELECT *, {_canonical_sql('url')} AS k FROM full_responses WHERE status IN (200, 203)),
r AS (SELECT *, {_canonical_sql('url')} AS k FROM revisits),
found AS (
  SELECT r.*, f.id AS rid, f.s AS rs, f.etag AS retag, f.p AS rp, octet_length(encode(f.html)) AS rsize,
    row_number() OVER (PARTITION BY r.id ORDER BY f.s DESC NULLS LAST, f.id DESC NULLS LAST) AS n
  FROM r LEFT JOIN f ON r.k = f.k AND f.s < r.s),
judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = retag THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = (rp % 1000)::VARCHAR THEN 'resolved' ELSE 'changed' END
    ELSE 'no_validator' END AS outcome
  FROM found WHERE n = 1)
SELECT id AS record_id, k AS url_key, 1700000000 + s AS ts, rid AS response_id, 1700000000 + rs AS response_ts, outcome,
  cache AS cache_control,
  CASE WHEN outcome = 'resolved' THEN rsize::VARCHAR ELSE size END AS content_length,
  CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type,
  s::VARCHAR AS date,
  CASE WHEN outcome = 'resolved' THEN coalesce(etag, retag) ELSE etag END AS etag,
  CASE WHEN outcome = 'resolved' THEN coalesce(modified, (rp % 1000)::VARCHAR) ELSE modified END AS last_modified
FROM judged
"""
