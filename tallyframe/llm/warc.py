"""WARC not-modified revisits, resolved by an as-of join on the canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm._common import Scratch

#: The fields that a 304 response may bring up to date (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """host[:port]/path[?query]: without scheme, user, fragment, default port, leading ``www.``, closing ``/`` and tracking
    parameters; host in lower case, parameters sorted. Null for null or what has no host."""
    bare = F.trim(url)
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored fields, with those of the update that a 304 response may change. Names are compared in lower case."""
    lower = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    allowed = F.map_filter(lower(update), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    rest = F.map_filter(lower(stored), lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, original_id, state, headers.

    records: record_id long, url string, ts long, kind ('response' or 'revisit'), status int, etag string,
    last_modified string, headers map<string,string>. A full response is a response with status 200. A revisit
    takes the latest full response of its canonical URL with a smaller ts (of equal ones the largest record_id).
    state: 'no original'; 'mismatch' where both have an etag and these differ (a weak mark W/ counts for nothing),
    or, without two etags, both have last_modified and these differ; 'unchecked' where no validator is on both
    sides; else 'resolved'. headers (original's, brought up to date) and original_id are set for 'resolved' and
    'unchecked'; original_id also for 'mismatch'. Records with null url, ts or kind take no part as originals;
    such revisits have 'no original'. Repeated revisits give a row each; an empty table gives an empty result.

    Records are dealt out by ranges of URL and time that hold about as many records each, so one very common URL is many
    groups, however its records lie in time: the latest response of each range is found by itself, carried forward
    over a table of one row for each URL and range, and joined back.
    """
    scratch = Scratch(records.sparkSession, "warc")
    keyed = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag", "last_modified", "headers")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    fields = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    order = ("ts", F.when(full, 1).otherwise(0), "record_id")  # a revisit comes before responses of its own second
    within = W.partitionBy("url_key", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # ranges go by the URL's hash, which keeps the sample for their bounds small
    ranged = keyed.where(usable & (full | (F.col("kind") == "revisit"))).repartitionByRange(F.xxhash64("url_key"), *order)
    ranged = scratch.save(ranged.withColumn("part", F.spark_partition_id()))  # the bounds come from a sample, so they are used once
    placed = scratch.save(ranged.withColumn("here", F.last(F.when(full, fields), ignorenulls=True).over(within)).withColumn("is_full", full))
    scratch.drop(ranged)
    ends = placed.where("is_full").groupBy("url_key", "part").agg(F.max_by(fields, F.struct("ts", "record_id")).alias("last"))
    asking = placed.where("not is_full and here is null").select("url_key", "part").distinct()
    every = ends.unionByName(asking.withColumn("last", F.lit(None).cast(ends.schema["last"].dataType))).groupBy("url_key", "part").agg(F.first("last", ignorenulls=True).alias("last"))
    carried = every.withColumn("before", F.last("last", ignorenulls=True).over(W.partitionBy("url_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    carried = scratch.save(carried.where("before is not null").select("url_key", "part", "before"))
    revisits = placed.where("not is_full").join(carried, ["url_key", "part"], "left")
    revisits = revisits.withColumn("o", F.coalesce("here", "before"))
    lost = keyed.where((F.col("kind") == "revisit") & ~usable).select("record_id", "url_key", "ts", "etag", "last_modified", "headers").withColumn("o", F.lit(None).cast(revisits.schema["o"].dataType))
    found = revisits.select(*lost.columns).unionByName(lost)
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("o.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("o.last_modified").isNotNull()
    state = (
        F.when(F.col("o").isNull(), "no original")
        .when(tags, F.when(strong("etag") == strong("o.etag"), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("o.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    found = found.withColumn("state", state)
    headers = F.when(F.col("state").isin("resolved", "unchecked"), merge_headers(F.col("o.headers"), F.col("headers")))
    return found.select("record_id", "url_key", "ts", F.col("o.record_id").alias("original_id"), "state", headers.alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """WARC records that follow from a table of pages (page_id, url, html): for each page its full response, and a
    revisit 500 to 699 seconds later whose validators match, differ or are absent by the id."""
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    day = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd HH:mm:ss")
    head = pages.select(
        (i * 2).alias("record_id"), "url", i.alias("ts"), F.lit("response").alias("kind"), F.when(i % 13 == 0, 503).otherwise(200).alias("status"),
        F.when(i % 7 != 0, tag).alias("etag"), F.when(i % 11 != 0, day(i - i % 50)).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), day(i), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    later = i + 500 + i % 200
    back = pages.select(
        (i * 2 + 1).alias("record_id"), F.concat("url", F.when(F.col("url").contains("#"), "x").otherwise("#again")).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(i % 5 == 0, F.lit('"changed"')).when(i % 3 != 0, F.concat(F.lit("W/"), tag)).alias("etag"), F.when(i % 4 != 0, day(i - i % 50)).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("Date"), day(later), F.lit("Vary"), F.lit("Accept")).alias("headers"),
    )
    return head.unionByName(back)
