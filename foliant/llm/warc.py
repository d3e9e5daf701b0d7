"""Not-modified revisits of a web archive: each is given the latest earlier full response of its URL.

The as-of join has no unbounded group.  Captures fall into time buckets of each canonical URL; a
bucket's latest response is an aggregate, the latest of all earlier buckets is a window over those
few rows, and within a bucket a window finds the latest earlier response.  So a URL with a third of
all captures is spread over its buckets of ten minutes, and captures without a URL, which can have no
response, meet nowhere.

A revisit's validators are checked against the response's: entity tags by weak comparison if both
have one, else the modification dates if both have one.  On agreement the permitted headers of the
revisit replace the response's.

Outcomes: `resolved` (a validator agrees), `unverified` (none in common; merged too), `mismatch` (a
validator differs; the response's headers stay), `orphan` (no earlier response; null fields).

Cases: a null URL has no canonical form and its revisits are orphans; a response at the very time
of a revisit is not earlier; of responses at one time the one with the largest record id counts;
null validators are none, null headers are empty, header names are compared in lower case; a
repeated revisit row is resolved each time; a null time is before all others; an empty table gives no
rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 600

#: Headers that a 304 answer may change.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no default port, at least `/` as path; null without a scheme."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def headers_of(names: Column) -> Column:
    """A header map as an array of (key, value) with lower-case keys, in order."""
    entries = F.map_entries(F.coalesce(names, F.create_map().cast("map<string,string>")))
    return F.array_sort(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, captured (seconds), response_id, outcome, payload_digest, headers (array of key and value).

    `captures` has record_id long, url string, captured long (seconds), kind ('response' or
    'revisit'), etag string, last_modified string, payload_digest string, headers map.
    """
    rows = captures.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.col("captured").cast("long").alias("captured"),
        (F.col("kind") == "response").alias("full"),
        F.col("etag"),
        F.col("last_modified"),
        F.col("payload_digest"),
        headers_of(F.col("headers")).alias("headers"),
        F.floor(F.col("captured") / bucket_seconds).alias("bucket"),
    )
    found = F.when(F.col("full"), F.struct("captured", "record_id", "etag", "last_modified", "payload_digest", "headers"))
    nowhere = rows.where(F.col("canonical_url").isNull() & ~F.col("full"))
    rows = rows.where(F.col("canonical_url").isNotNull())
    buckets = rows.groupBy("canonical_url", "bucket").agg(F.max(found).alias("latest"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("canonical_url", "bucket", F.max("latest").over(earlier).alias("carried"))
    within = Window.partitionBy("canonical_url", "bucket").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("own", F.max(found).over(within)).where(~F.col("full"))
    same = F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("base.etag"))).when(
        F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(), F.col("last_modified") == F.col("base.last_modified")
    )
    outcome = F.when(F.col("base").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    change = F.filter("headers", lambda h: h["key"].isin(PERMITTED))
    kept = F.filter("base.headers", lambda h: ~F.exists(change, lambda c: c["key"] == h["key"]))
    merged = F.when(F.col("outcome").isin("resolved", "unverified"), F.array_sort(F.concat(kept, change))).when(F.col("outcome") == "mismatch", F.col("base.headers"))
    found_base = joined.join(carried, ["canonical_url", "bucket"], "left").withColumn("base", F.coalesce("own", "carried")).drop("own", "carried")
    resolved = found_base.unionByName(nowhere.withColumn("base", F.lit(None).cast(found_base.schema["base"].dataType)))
    return resolved.withColumn("outcome", outcome).select("record_id", "canonical_url", "captured", F.col("base.record_id").alias("response_id"), "outcome", F.col("base.payload_digest").alias("payload_digest"), merged.alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """An archive of three crawls of each page: a check an hour before the first full response, that response, and a check 30 days later.

    Times follow from the page's number.  A URL with a query has no entity tag, and the last check
    of a URL with a fragment carries another tag.
    """
    at = F.lit(1_704_067_200) + F.col("page_id") * 60
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    tag = F.when(F.col("url").contains("?"), F.lit(None)).otherwise(F.concat(F.lit('"'), digest, F.lit('"')))
    size = F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    stamp = lambda x: F.concat(F.lit("t"), x.cast("string"))

    def capture(k: int, kind: str, when: Column, etag: Column) -> Column:
        own = {"Date": stamp(when), "Cache-Control": F.lit(f"max-age={60 * (k + 1)}"), "Content-Length": size if kind == "response" else F.lit("0")}
        if kind == "response":
            own["Content-Type"] = F.lit("text/html")
        return F.struct(
            (F.col("page_id") * 3 + k).alias("record_id"),
            when.alias("captured"),
            F.lit(kind).alias("kind"),
            etag.alias("etag"),
            stamp(at).alias("last_modified"),
            F.when(F.lit(kind == "response"), digest).alias("payload_digest"),
            F.create_map(*[x for name, value in own.items() for x in (F.lit(name), value)]).alias("headers"),
        )

    later = F.when(F.col("url").contains("#"), F.lit('"other"')).otherwise(tag)
    three = F.array(capture(0, "revisit", at - 3600, tag), capture(1, "response", at, tag), capture(2, "revisit", at + 30 * 86_400, later))
    return pages.select("url", F.inline(three))
