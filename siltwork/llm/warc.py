"""WARC revisits: an as-of join by canonical URL to the latest earlier full response, with validators and header merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The header fields that a not-modified answer may renew in a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of a time slice; one URL's captures meet by slices, so none needs all of them in one task.
SLICE_SECONDS = 3600
_URL_RULES = (
    (r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),
    (r"#.*$", ""),
    (r"(?i)^(www[0-9]?|m)\.", ""),
    (r"^([^/?]*):(80|443)", r"\1"),
    (r"([?&])(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*", r"\1"),
    (r"&&+", "&"),
    (r"[?]&+", "?"),
    (r"[?&/]+$", ""),
)


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, www. and m., default ports, tracking parameters and trailing separators are dropped; the host is lower-cased."""
    c = F.trim(F.coalesce(url.cast("string"), F.lit("")))
    for pattern, to in _URL_RULES:
        c = F.regexp_replace(c, pattern, to.replace(r"\1", "$1"))
    host = F.regexp_extract(c, r"^[^/?]*", 0)
    return F.concat(F.lower(host), F.substring(c, F.length(host) + 1, F.length(c)))


def _sql_url(col: str) -> str:
    c = f"trim(coalesce({col}, ''), ' ')"
    for pattern, to in _URL_RULES:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"(lower(regexp_extract({c}, '^[^/?]*')) || substr({c}, length(regexp_extract({c}, '^[^/?]*')) + 1))"


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row per revisit record: record_id, url_key, at, source_id, verdict, headers.

    ``records`` has record_id long, url string, at long (seconds), kind ('response' or 'revisit'), etag,
    last_modified and digest strings, headers map<string,string> with lower-case names. The source is the
    latest response of the same canonical URL that is earlier by at (at a tie the larger record_id).
    verdict: 'resolved' where the first validator that the revisit has (etag by weak comparison,
    last_modified, digest) agrees with the source's, 'unchecked' where it has none, 'mismatch' where they
    differ, 'missing' without a source. headers: the source's, renewed by the permitted ones of the
    revisit; null unless resolved or unchecked. A null url is the empty URL; records with a null at never
    meet another; null headers are empty. Repeated records are records of their own.

    The join has two levels. Inside a slice of time records of a URL meet by a window; what a slice
    begins with is the last response of the slices before it, found over one row per URL and slice.
    """
    body = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "at", "kind", body.alias("own")).withColumn("slice", F.floor(F.col("at") / slice_seconds))
    r = r.withColumn("full", (F.col("kind") == "response") & F.col("at").isNotNull())
    slices = r.groupBy("url_key", "slice").agg(F.max_by(F.when(F.col("full"), F.col("own")), F.when(F.col("full"), F.struct("at", "record_id"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("url_key", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("url_key", "slice").orderBy("at", F.col("full").cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = r.withColumn("inner", F.last(F.when(F.col("full"), F.col("own")), ignorenulls=True).over(within)).where("kind = 'revisit'")
    same = seen.url_key.eqNullSafe(carried.url_key) & seen.slice.eqNullSafe(carried.slice)
    j = seen.join(carried, same, "left").select("record_id", seen.url_key, "at", "own", F.when(F.col("at").isNotNull(), F.coalesce("inner", "carried")).alias("src"))
    o, s = F.col("own"), F.col("src")
    agree = (
        F.when(o["etag"].isNotNull(), F.coalesce(_weak(o["etag"]) == _weak(s["etag"]), F.lit(False)))
        .when(o["last_modified"].isNotNull(), F.coalesce(o["last_modified"] == s["last_modified"], F.lit(False)))
        .when(o["digest"].isNotNull(), F.coalesce(o["digest"] == s["digest"], F.lit(False)))
    )
    verdict = F.when(s.isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    empty = F.create_map().cast("map<string,string>")
    renew = F.map_filter(F.coalesce(o["headers"], empty), lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.coalesce(s["headers"], empty), lambda k, _: ~F.map_contains_key(renew, k)), renew)
    return j.select("record_id", "url_key", "at", s["record_id"].alias("source_id"), verdict.alias("verdict"), F.when(verdict.isin("resolved", "unchecked"), merged).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Two crawls of the pages: a full response a minute, and ninety minutes later a revisit with the page's own validator."""
    tag, stamp = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"')), (F.floor(F.col("page_id") / 100) * 6000).cast("string")
    p = pages.select("page_id", "url", tag.alias("tag"), stamp.alias("stamp"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    m, none, at = F.pmod("page_id", F.lit(3)), F.lit(None).cast("string"), F.col("page_id") * 60
    text = lambda **h: F.create_map(*(x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)))
    full = p.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.col("stamp").alias("last_modified"), F.col("tag").alias("digest"), text(content_type=F.lit("text/html"), content_length=F.col("size"), etag=F.col("tag"), last_modified=F.col("stamp"), date=at.cast("string")).alias("headers"))
    late = at + 5430
    again = p.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", late.alias("at"), F.lit("revisit").alias("kind"), F.when(m == 0, F.concat(F.lit("W/"), F.col("tag"))).otherwise(none).alias("etag"), F.when(m == 1, F.col("stamp")).otherwise(none).alias("last_modified"), F.when(m == 2, F.col("tag")).otherwise(none).alias("digest"), text(date=late.cast("string"), cache_control=F.lit("max-age=60"), content_length=F.lit("0")).alias("headers"))
    return full.unionByName(again)


def revisit_report(pages: DataFrame) -> DataFrame:
    """resolve_revisits over the pages, with the headers as one string in the order of their names."""
    r = resolve_revisits(page_records(pages))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return r.withColumn("headers", said).withColumnRenamed("at", "captured")


OP2_SQL = f"""
WITH p AS (SELECT page_id, {_sql_url("url")} AS url_key, '"' || md5(coalesce(html, '')) || '"' AS tag, CAST(page_id // 100 * 6000 AS VARCHAR) AS stamp, CAST(length(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
f AS (SELECT page_id * 2 AS source_id, url_key, page_id * 60 AS ts, tag, stamp, size FROM p),
v AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id * 60 + 5430 AS ts, tag, stamp, page_id % 3 AS m FROM p),
j AS (SELECT v.*, f.source_id, f.tag AS ftag, f.stamp AS fstamp, f.size, f.ts AS fts FROM v ASOF LEFT JOIN f ON v.url_key = f.url_key AND v.ts > f.ts),
k AS (SELECT *, CASE WHEN source_id IS NULL THEN 'missing' WHEN (m = 1 AND stamp = fstamp) OR (m <> 1 AND tag = ftag) THEN 'resolved' ELSE 'mismatch' END AS verdict FROM j)
SELECT record_id, url_key, ts AS captured, source_id, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;date=' || ts || ';etag=' || ftag || ';last-modified=' || fstamp END AS headers
FROM k
"""
