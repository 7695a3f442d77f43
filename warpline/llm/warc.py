"""Not-modified revisit resolution: an as-of join by canonical URL.

A revisit record (a 304 answer) has no body of its own. It refers to the latest
earlier full response for the same canonical URL; if its validators agree, the
response's headers are updated by those that a 304 may update.

A URL that holds a third of all records does not meet in one task. Records are
reduced to points (URL, time) with the greatest response id of each; points of a
URL with many of them are cut into time slices by approximate quantiles; within
a slice a window finds the latest earlier response, and the last response of
each slice is carried to the later ones. Revisits then join their point, and
their response, by joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpline.plans.scratch import pick

#: A URL with more points than this is cut into MAX_SLICES time slices of about equal size.
SLICE_POINTS = 5_000
MAX_SLICES = 1_000
#: Header names that a 304 answer does not update (framing, coding and connection headers).
KEPT_HEADERS = [
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
]
#: Query parameters that only track.
TRACKING = r"^(utm_[^=]*|fbclid|gclid)(=|$)"
_AUTHORITY = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)"


def canonical_url(url: Column) -> Column:
    """One spelling for the URLs that mean the same page; null for a null url or one without ``scheme://host``.

    The scheme and any user go, the host is lower-cased and loses ``www.`` and a
    default port, the fragment and tracking parameters go, other parameters are
    sorted, and an empty path is ``/``.
    """
    url = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_extract(url, r"(?s)^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), tail))


def _headers(h: Column) -> Column:
    """A header map with lower-case names; of names that then clash the last stays."""
    entries = F.transform(F.map_entries(h), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def merged_headers(full: Column, revisit: Column) -> Column:
    """The response's headers, updated by the permitted ones of the revisit."""
    fresh = F.map_filter(revisit, lambda k, v: ~k.isin(KEPT_HEADERS))
    stale = F.map_filter(full, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(stale, fresh)


def _tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def _as_of(points: DataFrame) -> DataFrame:
    """``points(canon, ts, response)`` -> ``(canon, ts, found)``: greatest response of the latest earlier point with one."""
    hot = points.groupBy("canon").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE_POINTS).select("canon")
    shares = F.array(*[F.lit(i / MAX_SLICES) for i in range(1, MAX_SLICES)])
    cuts = points.join(hot, "canon", "left_semi").groupBy("canon").agg(F.percentile_approx("ts", shares, 4 * MAX_SLICES).alias("cuts"))
    cuts = cuts.select("canon", F.array_distinct("cuts").alias("cuts"))
    # how many cuts are at most ts, by halving
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_SLICES.bit_length()))])
    step = lambda at, s: F.when((at + s <= F.size("cuts")) & (F.get("cuts", at + s - 1) <= F.col("ts")), at + s).otherwise(at)
    at = F.aggregate(steps, F.lit(0), step)
    sliced = points.join(cuts, "canon", "left").select("canon", "ts", "response", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(at).alias("slice"))
    latest = F.when(F.col("response").isNotNull(), F.struct("ts", "response"))
    earlier = Window.partitionBy("canon", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select("canon", "ts", "slice", F.max(latest).over(earlier).alias("own"))
    ends = sliced.groupBy("canon", "slice").agg(F.max(latest).alias("last"))
    slices = Window.partitionBy("canon").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canon", "slice", F.max("last").over(slices).alias("carried"))
    both = local.join(carried, ["canon", "slice"])
    return both.select("canon", "ts", F.coalesce("own", "carried")["response"].alias("found"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit of ``records`` with the response it refers to.

    ``records`` has record_id (long), url, ts (long), kind (``response`` or
    ``revisit``; others are left out), etag, last_modified (strings) and headers
    (map of strings). The result has a row for each revisit: record_id,
    canonical_url, resolved_id, outcome, headers.

    * ``resolved``: entity tags agree by weak comparison or, where one of them is
      missing, Last-Modified dates do; headers are merged.
    * ``unverified``: neither validator is on both sides; headers are merged.
    * ``mismatch``: a validator disagrees; resolved_id says with which response,
      headers are the revisit's own.
    * ``orphan``: no earlier response, no ts, or no canonical URL; headers are
      the revisit's own.

    Earlier means strictly: a response of the same time is not seen. Of several
    responses at the latest earlier time the greatest record_id counts. A
    missing header map is an empty one. Rows without record_id count as
    revisits but not as responses. Equal revisits give equal rows; responses
    that repeat a record_id count once. An empty table gives an empty result.
    """
    rows = pick(records, "record_id", "url", "ts", "kind", "etag", "last_modified", "headers")
    rows = rows.select(F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canon"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "headers")
    full = rows.where("kind = 'response' and record_id is not null")
    again = rows.where("kind = 'revisit'")
    timed = rows.where("canon is not null and ts is not null and kind in ('response', 'revisit')")
    points = timed.groupBy("canon", "ts").agg(F.max(F.when(F.col("kind") == "response", F.col("record_id"))).alias("response"))
    found = _as_of(points)
    base = full.dropDuplicates(["record_id"]).select(F.col("record_id").alias("found"), F.col("etag").alias("b_etag"), F.col("last_modified").alias("b_modified"), _headers(F.col("headers")).alias("b_headers"))
    joined = again.join(found, ["canon", "ts"], "left").join(base, "found", "left")
    etags = F.col("etag").isNotNull() & F.col("b_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("b_modified").isNotNull()
    agree = F.when(etags, _tag(F.col("etag")) == _tag(F.col("b_etag"))).when(dates, F.trim("last_modified") == F.trim("b_modified"))
    outcome = F.when(F.col("found").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    own = _headers(F.col("headers"))
    merged = F.when(outcome.isin("resolved", "unverified"), merged_headers(F.col("b_headers"), own)).otherwise(own)
    return joined.select("record_id", F.col("canon").alias("canonical_url"), F.col("found").alias("resolved_id"), outcome.alias("outcome"), merged.alias("headers"))


def header_lines(h: Column) -> Column:
    """A header map as sorted ``name: value`` lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(h), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log made of ``pages``: each page's first fetch in full and a later conditional one.

    Fetch times, validators and headers follow from page_id and html alone, so
    that SQL can make the same log: some revisits have stale or weak tags, some
    only dates, some neither, and some come before the page's own fetch.
    """
    p = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.md5(F.coalesce("html", F.lit(""))).alias("sum"))
    tag = F.concat(F.lit('"'), F.col("sum"), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    text = lambda c: c.cast("string")
    full = p.select((2 * F.col("page_id")).alias("record_id"), "url", (10 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 7 != 0, tag).alias("etag"), F.when(F.col("page_id") % 13 != 0, date).alias("last_modified"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.col("page_id") % 1000), F.lit("Server"), F.lit("a"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    stale = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).when(F.col("page_id") % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    again = p.select((2 * F.col("page_id") + 1).alias("record_id"), "url", (10 * F.col("page_id") + F.when(F.col("page_id") % 11 == 0, -5).otherwise(5)).alias("ts"), F.lit("revisit").alias("kind"), stale.alias("etag"), F.when(F.col("page_id") % 13 != 0, date).alias("last_modified"), F.create_map(F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), text(F.col("page_id")), F.lit("Connection"), F.lit("close")).alias("headers"))
    return full.unionByName(again)


def sql() -> str:
    """The query over ``pages`` in DuckDB SQL."""
    own = "'cache-control: no-cache' || chr(10) || 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || page_id"
    merged = "'cache-control: no-cache' || chr(10) || 'content-length: ' || (f // 2 % 1000) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id || chr(10) || 'server: a'"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract(u, '{_AUTHORITY}', 1)), ':(80|443)?$', ''), '^www[.]', '')"
    return f"""
WITH p AS (SELECT page_id, trim(url) AS u, md5(coalesce(html, '')) AS s FROM pages),
q AS (SELECT page_id, s, {host} AS host, regexp_extract(u, '(?s)^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '(?s)^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS params FROM p),
c AS (SELECT page_id, s, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END ||
    CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canon,
    10 * page_id + CASE WHEN page_id % 11 = 0 THEN -5 ELSE 5 END AS again_ts FROM q),
f AS (SELECT a.page_id, a.canon, a.s, arg_max(2 * b.page_id, struct_pack(t := 10 * b.page_id, i := 2 * b.page_id)) AS f
  FROM c a LEFT JOIN c b ON a.canon = b.canon AND 10 * b.page_id < a.again_ts GROUP BY a.page_id, a.canon, a.s),
v AS (SELECT f.page_id, f.canon, f.f,
    CASE WHEN f.page_id % 5 = 0 THEN 'stale' ELSE f.s END AS etag,
    CASE WHEN b.page_id % 7 <> 0 THEN b.s END AS b_etag,
    CASE WHEN f.page_id % 13 <> 0 THEN f.page_id % 28 END AS d, CASE WHEN b.page_id % 13 <> 0 THEN b.page_id % 28 END AS b_d
  FROM f LEFT JOIN c b ON f.f = 2 * b.page_id),
o AS (SELECT *, CASE WHEN f IS NULL THEN 'orphan' WHEN b_etag IS NOT NULL THEN CASE WHEN etag = b_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN d IS NOT NULL AND b_d IS NOT NULL THEN CASE WHEN d = b_d THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome FROM v)
SELECT 2 * page_id + 1 AS record_id, canon AS canonical_url, f AS resolved_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN {merged} ELSE {own} END AS headers FROM o
"""


def revisits_of_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``resolve_revisits`` over the crawl log of ``pages``, headers as text."""
    out = resolve_revisits(crawl_records(pages))
    return out.withColumn("headers", header_lines(F.col("headers")))
