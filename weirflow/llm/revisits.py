"""Resolution of "not modified" revisit records to the full responses they stand for.

A revisit has headers but no body; its body is that of the latest earlier full response for the same
canonical URL, provided that the validators agree: the entity tag (weak comparison), else the date of
last modification, else the payload digest. Of the revisit's headers those that a 304 response may update
replace the base's; the rest of the base's stay.

The as-of join moves metadata only, never bodies. All records of one instant of a URL are one row first. Time is cut at
quantiles into buckets, so a URL with any share of the records is spread over them: within a bucket a window finds the latest response before each
revisit, and across buckets each URL has at most one summary row per bucket, from a partial aggregation,
from which a second window carries the latest response over.

Defined results: a response at the same instant is not earlier; of responses at the same instant the one
with the greatest record id counts; records that repeat are resolved each; a revisit with a null URL or
time, or without an earlier response, has status `no_base`; one without a comparable validator is
`unverified` and, like a `mismatch`, names its base but takes neither digest nor headers from it; null
headers count as none; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import bucket_of

# Header fields that a 304 response may update, and query parameters that only track visitors.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[a-z]*|gclid|fbclid|ref|sessionid)(=|$)"
#: Buckets of time per shuffle partition.
PER_PARTITION = 2


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port or www; path without a trailing slash; query sorted, without tracking; no scheme or fragment."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    shape = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)([^?]*)(.*)$"
    host = F.lower(F.regexp_extract(plain, shape, 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[0-9]*[.]", ""), ":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(plain, shape, 2), "/+$", "")
    parts = F.filter(F.split(F.substring(F.regexp_extract(plain, shape, 3), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(parts), "&")
    made = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(plain.rlike(shape), made).otherwise(plain)


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, captured, status, base_record_id, validator, payload_digest, headers.

    ``records``: record_id, record_type (`response` or `revisit`), target_uri, captured (whole seconds or any
    other long), etag, last_modified, digest, headers (array of name and value, names in lower case).
    """
    none = F.array().cast("array<struct<name:string,value:string>>")
    r = records.select(
        "record_id", "record_type", canonical_url(F.col("target_uri")).alias("url"), F.col("captured").cast("long").alias("captured"), "etag", "last_modified", "digest",
        F.coalesce(F.col("headers"), none).alias("headers"),
    )
    n = PER_PARTITION * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = records.agg(F.percentile_approx(F.col("captured").cast("long"), [i / n for i in range(1, n)] or [0.5], F.lit(20 * n)).alias("c")).first().c or []
    r = r.withColumn("full", F.when(F.col("record_type") == "response", F.struct("captured", "record_id", "etag", "last_modified", "digest", "headers")))
    # One row for each instant of a URL, by a partial aggregation; records without a URL or a time have no base and stay out.
    asks = F.max(F.col("record_type") == "revisit").alias("asks")
    points = r.filter("url IS NOT NULL AND captured IS NOT NULL").groupBy("url", "captured").agg(F.max("full").alias("full"), asks).withColumn("bucket", bucket_of(F.col("captured"), sorted(set(cuts))))
    found = points.filter("full IS NOT NULL").groupBy("url", "bucket").agg(F.max("full").alias("full"))
    over = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spine = points.filter("asks").select("url", "bucket").distinct()
    carried = spine.join(found, ["url", "bucket"], "full").withColumn("carried", F.max("full").over(over)).select("url", "bucket", "carried")
    within = Window.partitionBy("url", "bucket").orderBy("captured").rowsBetween(Window.unboundedPreceding, -1)
    bases = points.withColumn("inside", F.max("full").over(within)).filter("asks").join(carried, ["url", "bucket"], "left")
    bases = bases.select("url", "captured", F.coalesce("inside", "carried").alias("base"))
    # Many revisits of one instant, or of none, are rows of the left side of an outer join, which AQE may split.
    joined = r.filter("record_type = 'revisit'").drop("full").join(bases, ["url", "captured"], "left")
    return _checked(joined)


def _checked(joined: DataFrame) -> DataFrame:
    same, by = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for name, ours, theirs in (("digest", F.col("digest"), F.col("base.digest")), ("last-modified", F.col("last_modified"), F.col("base.last_modified")), ("etag", _tag(F.col("etag")), _tag(F.col("base.etag")))):
        both = ours.isNotNull() & theirs.isNotNull()
        same, by = F.when(both, ours == theirs).otherwise(same), F.when(both, F.lit(name)).otherwise(by)
    status = F.when(F.col("base").isNull(), "no_base").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    d = joined.withColumn("status", status).withColumn("validator", by)
    update = F.filter("headers", lambda h: h["name"].isin(*PERMITTED))
    merged = F.array_sort(F.concat(F.filter("base.headers", lambda h: ~F.exists(update, lambda u: u["name"] == h["name"])), update))
    resolved = F.col("status") == "resolved"
    return d.select(
        "record_id", F.col("url").alias("canonical_url"), "captured", "status", F.col("base.record_id").alias("base_record_id"), "validator",
        F.when(resolved, F.col("base.digest")).alias("payload_digest"), F.when(resolved, F.array_join(F.transform(merged, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages, for want of an archive: each page is fetched in full, every minute one,
    is asked for again a day later (another scheme, with its entity tag and a new lifetime), and had been asked for an hour before (with a date only).
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.md5(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("md5"),
        F.length(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("n"),
    )
    start = F.lit(1_700_000_000).cast("long") + 60 * F.col("id")
    tag, modified = F.concat(F.lit('"'), F.substring("md5", 1, 16), F.lit('"')), F.concat(F.lit("day-"), (F.floor(F.col("id") / 100)).cast("string"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    def record(k: int, kind: str, url: Column, at: Column, etag: Column, last: Column, digest: Column, headers: list[Column]) -> Column:
        return F.struct(
            F.concat(F.lit("urn:page:"), F.col("id").cast("string"), F.lit(f":{k}")).alias("record_id"), F.lit(kind).alias("record_type"), url.alias("target_uri"), at.alias("captured"),
            etag.cast("string").alias("etag"), last.cast("string").alias("last_modified"), digest.cast("string").alias("digest"), F.array(*headers).alias("headers"),
        )

    other = F.when(F.col("url").startswith("https:"), F.concat(F.lit("http:"), F.substring("url", 7, 1 << 30))).when(F.col("url").startswith("http:"), F.concat(F.lit("https:"), F.substring("url", 6, 1 << 30))).otherwise(F.col("url"))
    none = F.lit(None)
    full = record(0, "response", F.col("url"), start, tag, modified, F.concat(F.lit("md5:"), "md5"), [pair("cache-control", F.lit("max-age=60")), pair("content-length", F.col("n")), pair("content-type", F.lit("text/html")), pair("date", start), pair("etag", tag), pair("last-modified", modified)])
    later = record(1, "revisit", other, start + 86_400, F.concat(F.lit("W/"), tag), modified, none, [pair("cache-control", F.lit("max-age=120")), pair("content-length", F.lit(0)), pair("date", start + 86_400), pair("etag", F.concat(F.lit("W/"), tag)), pair("server", F.lit("edge"))])
    before = record(2, "revisit", F.col("url"), start - 3600, none, modified, none, [pair("date", start - 3600), pair("expires", start)])
    return p.select(F.explode(F.array(full, later, before)).alias("r")).select("r.*")
