"""Resolution of not-modified revisit records against the captures that they refer to.

A revisit (a 304 answer) holds headers but no body. It refers to the latest earlier full response of the same
canonical URL. The as-of join has two levels, so a URL with very many captures is split by time: within a
bucket of (URL, time) a running maximum finds the latest response; the latest response before a bucket comes
from a window over bucket maxima, one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket.
BUCKET = 86_400
#: Headers that a 304 answer may replace in the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path, sorted query; no scheme, no fragment. Null stays null."""
    part = lambda k: F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.when(part(2) == "", "/").otherwise(part(2))
    query = F.array_join(F.array_sort(F.split(part(3), "&")), "&")
    full = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNull() | (part(1) != ""), full).otherwise(url)


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merge_headers(stored: Column, new: Column) -> Column:
    """Stored headers (array of name, value) with the permitted ones of the 304 answer in place of their namesakes."""
    fresh = F.filter(new, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(fresh, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False))), fresh)


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per record: ``record_id, ts, url_key, kind, ref_record_id, state, headers, payload``.

    Records have ``record_id, ts`` (seconds), ``url, kind`` (response or revisit), ``etag, last_modified, digest,
    headers`` (array of name, value) and ``payload``. States: ``full`` for responses; for revisits ``resolved``,
    ``no_response`` (none earlier, or ts or url is null), ``no_validator`` (no validator on both sides) and
    ``validator_mismatch`` (one on both sides differs; weak and strong ETags compare alike). A response at the same
    second is not earlier; of responses at one second the one with the larger record_id is the latest. Only
    resolved revisits get the response's payload and merged headers; others keep theirs. Rows with a null kind count as
    revisits. Repeated revisits are resolved each; of responses that repeat a record_id one is referred to.
    """
    null = lambda c: F.coalesce(c, F.array().cast("array<struct<name: string, value: string>>"))
    r = records.select(
        "record_id", F.col("ts").cast("long").alias("ts"), canonical_url(F.col("url")).alias("url_key"),
        F.when(F.col("kind") == "response", F.lit("response")).otherwise(F.lit("revisit")).alias("kind"),
        "etag", "last_modified", "digest", null(F.col("headers")).alias("headers"), F.col("payload").cast("string").alias("payload"),
    ).withColumn("bucket", F.expr(f"ts div {int(bucket)}L"))
    place = F.when((F.col("kind") == "response") & F.col("record_id").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id"))
    slim = r.where("url_key is not null and ts is not null").select("record_id", "ts", "url_key", "kind", "bucket", place.alias("place"))
    before = Window.partitionBy("url_key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = slim.withColumn("near", F.max("place").over(before)).where("kind = 'revisit'").select("record_id", "ts", "url_key", "bucket", "near")
    by_bucket = slim.groupBy("url_key", "bucket").agg(F.max("place").alias("top"))
    older = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_bucket.withColumn("carried", F.max("top").over(older)).select("url_key", "bucket", "carried")
    found = near.join(carried, ["url_key", "bucket"]).select("record_id", "ts", "url_key", F.coalesce("near", "carried")["record_id"].alias("ref")).distinct()
    revisits = r.where("kind = 'revisit'").drop("bucket", "payload")
    same = [revisits[c].eqNullSafe(found[c]) for c in ("record_id", "ts", "url_key")]
    revisits = revisits.join(found, same[0] & same[1] & same[2], "left").select(revisits["*"], "ref")
    full = r.where("kind = 'response' and record_id is not null").dropDuplicates(["record_id"])
    full = full.select(F.col("record_id").alias("ref"), F.col("etag").alias("s_etag"), F.col("last_modified").alias("s_modified"), F.col("digest").alias("s_digest"), F.col("headers").alias("s_headers"), "payload")
    both = revisits.join(full, "ref", "left")
    pairs = [(_strong(F.col("etag")), _strong(F.col("s_etag"))), (F.col("last_modified"), F.col("s_modified")), (F.col("digest"), F.col("s_digest"))]
    there = [a.isNotNull() & b.isNotNull() for a, b in pairs]
    differ = [t & (a != b) for t, (a, b) in zip(there, pairs, strict=True)]
    state = (
        F.when(F.col("ref").isNull(), "no_response")
        .when(~(there[0] | there[1] | there[2]), "no_validator")
        .when(differ[0] | differ[1] | differ[2], "validator_mismatch")
        .otherwise("resolved")
    )
    both = both.withColumn("state", state)
    ok = F.col("state") == "resolved"
    resolved = both.select(
        "record_id", "ts", "url_key", "kind", F.col("ref").alias("ref_record_id"), "state",
        F.when(ok, merge_headers(F.col("s_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("payload")).alias("payload"),
    )
    kept = r.where("kind = 'response'").select("record_id", "ts", "url_key", "kind", F.lit(None).cast(records.schema["record_id"].dataType).alias("ref_record_id"), F.lit("full").alias("state"), "headers", "payload")
    return kept.unionByName(resolved)
