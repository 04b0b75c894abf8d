"""Not-modified revisits of a crawl resolved to the full responses that they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified response may update in the stored one (the fixed list of RFC 9110, section 15.4.5, and what caches may extend).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Captures of one URL are carried forward from one span of time to the next, of so many seconds.
SPAN_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, then path and query; scheme, fragment, tracking parameters and a trailing slash are left out. Null for a null or blank URL."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(rest, "^[^/?]*", "")
    path = F.regexp_replace(path, "([?&])((utm_[a-z]+|gclid|fbclid)=[^&]*&?)+", "$1")
    path = F.regexp_replace(F.regexp_replace(path, "[?&]+$", ""), "/+$", "")
    return F.when(F.length(host) > 0, F.concat(host, path))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records that Spark derives from pages (page_id LONG, url STRING, html STRING): for each page a full response, and later a second
    and third visit; a tenth of pages also have one before the first response. By crc32(page_id) mod 4, the second is a changed full response
    (0), or a revisit with the same (1), the weak form of the same (2) or another (3) entity tag; the third is a revisit with
    the tag of the first response, or without tag but with its date (page_id mod 5 = 0).

    Columns: record_id STRING, url, ts LONG (seconds), kind ('response', 'revisit'), status INT, etag, last_modified LONG, digest, headers MAP.
    """
    page, html = F.col("page_id").cast("long"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    case = F.coalesce(F.crc32(page.cast("string").cast("binary")) % 4, F.lit(0))
    base, day = F.coalesce(page, F.lit(0)) * 7, 86_400
    digest, changed = F.md5(html.cast("binary")), F.md5(F.concat(html, F.lit("+")).cast("binary"))
    tag = lambda d: F.concat(F.lit('"'), F.substring(d, 1, 16), F.lit('"'))
    none = F.lit(None).cast("string")

    def record(n: int, at: Column, kind: Column, etag: Column, modified: Column, body: Column) -> Column:
        full = kind == "response"
        headers = F.map_from_entries(F.filter(F.array(
            F.struct(F.lit("date").alias("key"), at.cast("string").alias("value")),
            F.struct(F.lit("etag").alias("key"), etag.alias("value")),
            F.struct(F.lit("cache-control").alias("key"), F.concat(F.lit("max-age="), F.lit(60 * (n + 1)).cast("string")).alias("value")),
            F.struct(F.lit("content-type").alias("key"), F.when(full, F.lit("text/html")).alias("value")),
            F.struct(F.lit("content-length").alias("key"), F.when(full, F.octet_length(html).cast("string")).otherwise("0").alias("value")),
            F.struct(F.lit("server").alias("key"), F.lit(f"node{n}").alias("value")),
        ), lambda e: e["value"].isNotNull()))
        return F.struct(F.concat(page.cast("string"), F.lit(f"-{n}")).alias("record_id"), at.alias("ts"), kind.alias("kind"), F.when(full, 200).otherwise(304).alias("status"), etag.alias("etag"), modified.alias("last_modified"), F.when(full, body).alias("digest"), headers.alias("headers"))

    dated = F.coalesce(page % 5 == 0, F.lit(False))
    second = record(2, base + day, F.when(case == 0, "response").otherwise("revisit"), F.when(case == 0, tag(changed)).when(case == 1, tag(digest)).when(case == 2, F.concat(F.lit("W/"), tag(digest))).otherwise(F.lit('"other"')), F.when(case == 0, base + day).otherwise(base), changed)
    third = record(3, base + 2 * day, F.lit("revisit"), F.when(dated, none).otherwise(tag(digest)), base, digest)
    early = record(0, base - day, F.lit("revisit"), tag(digest), base, digest)
    all_ = F.array(record(1, base, F.lit("response"), tag(digest), base, digest), second, third, F.when(F.coalesce(page % 10 == 0, F.lit(False)), early))
    return pages.select("url", F.explode(F.filter(all_, lambda r: r.isNotNull())).alias("r")).select("url", "r.*")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of records (see `captures`): record_id, url_key, ts, outcome, refers_to, refers_ts, digest, headers.

    A revisit refers to the latest response of status 200 of its canonical URL that is earlier: smaller (ts, record_id). It is
    'resolved' if its entity tag equals that response's (weak comparison), or, where it has none, its modification date
    does. Then headers are the response's, with the permitted ones of the revisit in their place; names are compared without case and stay as they are written. Else the outcome is
    'no_url', 'no_time', 'no_earlier_response', 'no_validator' or 'validator_mismatch', refers_to still tells the response, if any, and digest and headers are
    null. Repeated rows are each returned; responses tied in time go by record_id. Columns of other names are ignored.

    The as-of join is two-fold: the last response of each URL and hour is found by partial aggregation and carried forward over
    the hours, one row each; within an hour a window orders the captures. So a URL with a third of all captures is split
    by hours, and bodies are never moved, only digests.
    """
    url_key = canonical_url(F.col("url").cast("string"))
    rows = records.select("record_id", url_key.alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag", "last_modified", "digest", "headers").withColumn("span", F.expr(f"ts div {SPAN_SECONDS}"))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    seen = F.struct("ts", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers"))
    timed = rows.filter(usable & (full | (F.col("kind") == "revisit")))

    heads = timed.groupBy("url_key", "span").agg(F.max_by(F.when(full, seen), F.when(full, F.struct("ts", "record_id"))).alias("last"), F.max((F.col("kind") == "revisit").cast("int")).alias("asks"))
    earlier = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).filter("asks = 1").select("url_key", "span", "carried")
    within = Window.partitionBy("url_key", "span").orderBy("ts", "record_id", F.when(full, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    asked = timed.withColumn("own", F.last(F.when(full, seen), ignorenulls=True).over(within)).filter("kind = 'revisit'")
    found = asked.join(carried, ["url_key", "span"], "left").withColumn("to", F.coalesce("own", "carried"))
    rest = rows.filter((F.col("kind") == "revisit") & ~usable).withColumn("to", F.lit(None).cast(found.schema["to"].dataType))
    columns = ["record_id", "url_key", "ts", "etag", "last_modified", "headers", "to"]
    all_ = found.select(columns).union(rest.select(columns))

    strong = lambda t: F.regexp_replace(t, "^W/", "")
    same = F.when(F.col("etag").isNotNull(), F.coalesce(strong(F.col("etag")) == strong(F.col("to.etag")), F.lit(False))).otherwise(F.coalesce(F.col("last_modified") == F.col("to.last_modified"), F.lit(False)))
    outcome = (
        F.when(F.col("url_key").isNull(), "no_url").when(F.col("ts").isNull(), "no_time").when(F.col("to").isNull(), "no_earlier_response")
        .when(F.col("etag").isNull() & F.col("last_modified").isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    )
    update = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k).isin(PERMITTED))
    replaced = F.transform(F.map_keys(update), F.lower)
    kept = F.map_filter(F.map_from_entries("to.headers"), lambda k, _: ~F.array_contains(replaced, F.lower(k)))
    resolved = F.col("outcome") == "resolved"
    return all_.withColumn("outcome", outcome).select("record_id", "url_key", "ts", "outcome", F.col("to.record_id").alias("refers_to"), F.col("to.ts").alias("refers_ts"), F.when(resolved, F.col("to.digest")).alias("digest"), F.when(resolved, F.map_concat(update, kept)).alias("headers"))


def header_lines(resolved: DataFrame) -> DataFrame:
    """The same with headers as one text, a line each, in order of names."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved.withColumn("headers", lines)
