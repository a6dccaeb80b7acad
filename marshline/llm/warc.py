"""Resolution of not-modified revisit records against the latest earlier full response.

Records are captures: url, time, status, headers (a map with any letter case) and payload. A revisit has status 304 and no payload.
It resolves to the latest earlier full response (status 200) of the same canonical URL, if their validators agree: entity tags by weak
comparison where both have one, else Last-Modified values; without a common validator the as-of response is taken. The result has the
response's headers with those of the revisit laid over them, except for headers that describe the payload as sent, which a not-modified
response may not change.

As-of join without a hot task: records are counted by URL first, and URLs with more than ``bucket_rows`` are cut into time buckets of about that size at
approximate quantiles of their times. The latest response within a bucket comes from a window; the latest one of the buckets before from a window over bucket
summaries. An instant that holds several buckets' worth of records becomes a bucket of its own, and since records of one instant never look at each other,
its records are dealt to as many tasks at random. So a URL that a third of all records share is spread over as many tasks as its size asks for.

Defined results: a record with null url or null time resolves to nothing (``no_response``). Of several responses at one time
the one with the largest record id is the latest; a response at the revisit's own time is not earlier. Repeated rows each resolve. Null
header maps are empty. Null record ids are values like any other; records with a null status are neither responses nor revisits and give no row. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marshline.session import stage

#: Headers of the stored response that a not-modified response leaves alone.
PAYLOAD_HEADERS = ["content-encoding", "content-length", "content-md5", "content-range", "content-type", "digest", "trailer", "transfer-encoding"]


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case without default port, no fragment, no trailing slash, no tracking parameters, rest sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """The map with names in lower case; of names that differ by case only, the last in order of name stays."""
    none = F.create_map().cast("map<string,string>")
    entries = F.array_sort(F.map_entries(F.coalesce(headers, none)))
    pairs = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def agree(revisit: Column, response: Column) -> Column:
    tags = _tag(revisit).isNotNull() & _tag(response).isNotNull()
    dates = revisit["last-modified"].isNotNull() & response["last-modified"].isNotNull()
    return F.when(tags, _tag(revisit) == _tag(response)).when(dates, revisit["last-modified"] == response["last-modified"]).otherwise(True)


def merged_headers(revisit: Column, response: Column) -> Column:
    """The response's headers, replaced or joined by those of the revisit that it may carry."""
    fresh = F.map_filter(revisit, lambda k, v: ~k.isin(PAYLOAD_HEADERS) & v.isNotNull())
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def in_buckets(known: DataFrame, busy: DataFrame, parts: int, bucket_rows: int) -> DataFrame:
    """``known`` with a time bucket for each row of a busy URL, and a salt for rows of an instant that fills several buckets. ``parts``: buckets of the busiest URL."""
    micros = F.unix_micros("time")
    marks = known.join(busy, "_url", "left_semi").groupBy("_url").agg(
        F.percentile_approx(micros, [i / parts for i in range(1, parts)], 20 * parts).alias("_all"))
    # Smaller URLs take every so many of these cuts.
    step = F.greatest(F.floor(parts * F.lit(bucket_rows) / F.col("_n")), F.lit(1))
    own = marks.join(busy, "_url").select("_url", F.filter("_all", lambda c, i: (i + 1) % step == 0).alias("_all"))

    def repeats(c: Column) -> Column:
        return F.size(F.filter("_all", lambda x: x == c))

    heavy = F.filter(F.array_distinct("_all"), lambda c: repeats(c) > 1)
    cuts = own.select("_url", F.array_sort(F.array_distinct(F.concat("_all", F.transform(heavy, lambda c: c + 1)))).alias("_cuts"),
                      F.map_from_entries(F.transform(heavy, lambda c: F.struct(c, repeats(c) + 1))).alias("_heavy"))
    placed = known.withColumn("_draw", F.xxhash64("record_id", F.monotonically_increasing_id())).join(cuts, "_url", "left")
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= micros)), F.lit(0))
    salt = F.coalesce(F.pmod(F.col("_draw"), F.try_element_at("_heavy", micros)), F.lit(0))
    return placed.withColumns({"_bucket": bucket, "_salt": salt.cast("int")}).drop("_cuts", "_heavy", "_draw")


def resolve_revisits(records: DataFrame, bucket_rows: int = 1_000_000) -> DataFrame:
    """One row per revisit (record_id, url, time): response_id, outcome and the merged headers as a sorted list of "name: value".

    ``records``: record_id, url, time, status, headers. Outcomes: ``resolved``, ``validator_mismatch``, ``no_response``.
    """
    rows = records.select("record_id", "url", "time", "status", lower_keys(F.col("headers")).alias("_headers"), canonical_url(F.col("url")).alias("_url"))
    known = rows.where("status in (200, 304) and _url is not null and time is not null")
    busy = stage(known.groupBy("_url").agg(F.count("*").alias("_n")).where(F.col("_n") > bucket_rows), "busy")
    most = busy.agg(F.max("_n")).first()[0]
    if most is None:
        placed = known.withColumns({"_bucket": F.lit(0), "_salt": F.lit(0)})
    else:
        placed = in_buckets(known, busy, -(-most // bucket_rows), bucket_rows)
    full = F.when(F.col("status") == 200, F.struct("time", F.col("record_id").alias("id"), F.col("_headers").alias("headers")))
    # Strictly earlier: order by time and look back over times below the current one.
    micros = F.unix_micros("time")
    inside = Window.partitionBy("_url", "_bucket", "_salt").orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by(full, F.when(F.col("status") == 200, F.struct("time", "record_id")))
    summaries = placed.groupBy("_url", "_bucket").agg(latest.alias("_last")).select(
        "_url", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    seen = placed.withColumn("_near", latest.over(inside)).where("status = 304")
    asof = seen.join(summaries, ["_url", "_bucket"]).withColumn("_r", F.coalesce("_near", "_carried"))
    lost = rows.where("status = 304 and (_url is null or time is null)").withColumn("_r", F.lit(None).cast(asof.schema["_r"].dataType))
    every = asof.select("record_id", "url", "time", "_headers", "_r").unionByName(lost.select("record_id", "url", "time", "_headers", "_r"))
    response = F.col("_r.headers")
    outcome = F.when(F.col("_r").isNull(), "no_response").when(agree(F.col("_headers"), response), "resolved").otherwise("validator_mismatch")
    headers = F.when(outcome == "resolved", F.array_sort(F.transform(F.map_entries(merged_headers(F.col("_headers"), response)),
                                                                     lambda e: F.concat(e["key"], F.lit(": "), e["value"]))))
    return every.select("record_id", "url", "time", F.when(outcome != "no_response", F.col("_r.id")).alias("response_id"), outcome.alias("outcome"),
                        headers.alias("headers"))
