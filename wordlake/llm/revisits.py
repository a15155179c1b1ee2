"""Operator 10, WARC: not-modified revisit resolution.

A revisit record (a 304 answer, no body) is joined as of its time to the latest earlier full response of the same
canonical URL. Its validators are checked against that response, and the headers that a 304 may change are merged
into the stored ones. Everything is DataFrame work; bodies are not carried, a resolved row names the record and the
digest of its payload.

A URL may hold a third of all rows. Records are grouped by URL and time bucket: within a bucket a window finds the
latest response, and a second window, over one row per bucket of a URL, carries the last response of earlier buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query parameters that don't name content (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
#: Headers that an answer without body must not change.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
BUCKETS = 1024


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without a last slash, parameters sorted without tracking ones.

    Scheme and fragment are dropped. Null stays null.
    """
    plain = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, kind, url, ts, etag, last_modified, digest, headers).

    ``kind`` is ``response`` or ``revisit``, ``ts`` a number; ``headers`` a map with lower-case names. Earlier means
    smaller (ts, record_id); other kinds are ignored. ``outcome``: ``no_response`` without an earlier response (or
    without URL or time), ``changed`` if a validator that both sides have differs (entity tag first, weak marks
    ignored; the date only if one side has no tag; the digest always), else ``resolved``. Only resolved rows have
    ``headers`` (null maps count as empty) and ``digest`` of the response. Rows with equal record_id and ts are taken
    in order of kind, so a response may answer a revisit of its own id. Extra columns are not read.
    """
    tag = F.regexp_replace("etag", r"^W/", "")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    r = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "ts", tag.alias("etag"), "last_modified", "digest", F.coalesce("headers", none).alias("headers"))
    bounds = records.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    width = (F.col("high") - F.col("low") + 1) / F.lit(float(BUCKETS))
    placed = r.where(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()).crossJoin(F.broadcast(bounds))  # one row
    placed = placed.withColumn("bucket", F.floor((F.col("ts") - F.col("low")) / width).cast("int")).drop("low", "high")
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("entries")))
    placed = placed.withColumn("full", full)
    ends = placed.groupBy("canonical_url", "bucket").agg(F.max("full").alias("full"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("canonical_url", "bucket", F.last("full", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("ts", "record_id", "kind").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("inside", F.last("full", ignorenulls=True).over(inside)).where(F.col("kind") == "revisit")
    found = found.drop("full").join(ends, ["canonical_url", "bucket"]).withColumn("full", F.coalesce("inside", "carried"))
    lost = r.where((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("ts").isNull()))
    cols = ["record_id", "canonical_url", "ts", "etag", "last_modified", "digest", "headers"]
    found = found.select(*cols, "full").unionByName(lost.select(*cols), allowMissingColumns=True)
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"full.{c}"), F.lit(False))
    tags = F.col("etag").isNotNull() & F.col("full.etag").isNotNull()
    changed = (tags & differs("etag")) | (~tags & differs("last_modified")) | differs("digest")
    outcome = F.when(F.col("full").isNull(), "no_response").when(changed, "changed").otherwise("resolved")
    permitted = F.map_filter("headers", lambda k, _: ~k.isin(*BODY_HEADERS))
    stored = F.map_filter(F.map_from_entries("full.entries"), lambda k, _: ~F.array_contains(F.map_keys("permitted"), k))
    done = F.col("outcome") == "resolved"
    found = found.withColumn("outcome", outcome).withColumn("permitted", permitted)
    return found.select("record_id", "canonical_url", "ts", "outcome", F.when(done, F.col("full.record_id")).alias("response_id"),
                        F.when(done, F.col("full.digest")).alias("response_digest"), F.when(done, F.map_concat("permitted", stored)).alias("headers"))
