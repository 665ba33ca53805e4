"""Not-modified revisits: as-of join by canonical URL to the latest earlier full response, validators, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: fields that a 304 response may update (RFC 9110, 15.4.5)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# fixed values: query parameters that name a campaign or a referrer, not a page
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
SPAN = 3600  # seconds of one time bucket


def canonical(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case, default port, fragment, tracking parameters and a final slash
    dropped, other parameters sorted. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "(?i)^https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    )
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def strong(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per not-modified record: ``record_id, canonical_url, refers_to, verdict, headers``.

    ``records(record_id long, url string, ts long seconds, status int, etag, last_modified, headers
    array<struct<name, value>>)``; status 200 is a full response, 304 a revisit, others are left out. A revisit takes
    the latest full response of a strictly earlier second with its canonical URL (of several in one second the
    largest record_id). ``verdict``: ``resolved`` if the entity tags agree (weakly) or, where either is missing, the
    modification dates do; ``changed`` if they differ; ``unverified`` if there is nothing to compare; ``no_earlier``.
    Resolved rows get the full response's headers, with the permitted fields that the revisit has in their place
    (names in lower case); others null.

    Times of a URL are first collapsed to one row a second, ordered within time buckets, and carried from bucket to
    bucket, so a URL with a third of all records is spread over its buckets. The response's validators travel with its
    time; only resolved rows meet the responses again, for their headers, by id, URL and second, so an id that stands
    for several responses is told apart (of equal ones in a second the largest validators, then headers). Responses
    without an id cannot be referred to. Null URL or time: ``no_earlier``, without a join. Repeated rows are resolved
    alike, each on its own; bodies are not read. Empty tables give an empty result; other columns are ignored.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical(F.col("url")).alias("canonical_url"),
        F.col("ts").cast("long").alias("ts"),
        "status",
        strong(F.col("etag")).alias("tag"),
        "last_modified",
        F.transform(
            F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")),
            lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")),
        ).alias("headers"),
    )
    keyed = rows.filter("canonical_url is not null and ts is not null")
    responses = (F.col("status") == 200) & F.col("record_id").isNotNull()
    full = F.when(responses, F.struct("ts", "record_id", "tag", "last_modified"))
    times = keyed.groupBy("canonical_url", "ts").agg(F.max(full).alias("own"))
    times = times.withColumn("bucket", F.floor(F.col("ts") / span))
    before = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    within = times.withColumn("near", F.last("own", ignorenulls=True).over(before))
    closing = times.groupBy("canonical_url", "bucket").agg(F.max("own").alias("closing"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = closing.select("canonical_url", "bucket", F.last("closing", ignorenulls=True).over(earlier).alias("far"))
    asof = within.join(carried, ["canonical_url", "bucket"]).select("canonical_url", "ts", F.coalesce("near", "far").alias("old"))
    seen = (F.col("status") == 304) & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    matched = rows.filter(seen).join(asof.filter("old is not null"), ["canonical_url", "ts"], "left")
    tags, dates = (F.col("tag"), F.col("old.tag")), (F.col("last_modified"), F.col("old.last_modified"))
    both_tags, both_dates = tags[0].isNotNull() & tags[1].isNotNull(), dates[0].isNotNull() & dates[1].isNotNull()
    verdict = (
        F.when(F.col("old").isNull(), "no_earlier")
        .when(both_tags, F.when(tags[0] == tags[1], "resolved").otherwise("changed"))
        .when(both_dates, F.when(dates[0] == dates[1], "resolved").otherwise("changed"))
        .otherwise("unverified")
    )
    judged = matched.withColumn("verdict", verdict).select(
        "record_id", "canonical_url", F.col("old.record_id").alias("refers_to"), F.col("old.ts").alias("full_ts"), "verdict", "headers"
    )
    told = ["record_id", "canonical_url", "refers_to", "verdict"]
    stored = (
        keyed.filter(responses)
        .groupBy(F.col("record_id").alias("refers_to"), "canonical_url", F.col("ts").alias("full_ts"))
        .agg(F.max(F.struct("tag", "last_modified", "headers"))["headers"].alias("old_headers"))
    )
    newer = F.filter("headers", lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(newer, lambda h: h["name"])
    merged = F.concat(F.filter("old_headers", lambda h: ~F.array_contains(names, h["name"])), newer)
    resolved = judged.filter("verdict = 'resolved'").join(stored, ["refers_to", "canonical_url", "full_ts"])
    none = F.lit(None).cast("array<struct<name:string,value:string>>").alias("headers")
    unkeyed = rows.filter("status = 304 and (canonical_url is null or ts is null)").select(
        "record_id", "canonical_url", F.lit(None).cast("long").alias("refers_to"), F.lit("no_earlier").alias("verdict"), none
    )
    rest = judged.filter("verdict <> 'resolved'").select(*told, none)
    return resolved.select(*told, merged.alias("headers")).unionByName(rest).unionByName(unkeyed)


def with_bodies(resolved: DataFrame, records: DataFrame, body_col: str) -> DataFrame:
    """``resolved`` with the body of the response that each resolved row refers to, as ``body``.

    Where an id stands for several responses of one canonical URL, the latest one's, of equal times the largest. Rows
    that are not resolved have a null body and take no part in the join.
    """
    keys = ["refers_to", "canonical_url"]
    full = records.filter("status = 200 and record_id is not null and url is not null").select(
        F.col("record_id").cast("long").alias("refers_to"), canonical(F.col("url")).alias("canonical_url"), "ts", F.col(body_col).alias("body")
    )
    bodies = full.groupBy(*keys).agg(F.max(F.struct("ts", "body"))["body"].alias("body"))
    done = F.col("verdict") == "resolved"
    with_body = resolved.filter(done).join(bodies, keys, "left").select(*resolved.columns, "body")
    rest = resolved.filter(~done).withColumn("body", F.lit(None).cast(bodies.schema["body"].dataType))
    return with_body.unionByName(rest.select(with_body.columns))
