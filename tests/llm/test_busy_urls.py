"""Revisits of a URL that most records share, a third of them at one instant."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from marshline.llm import warc

KIND = "record_id long, url string, time timestamp, status int, headers map<string,string>"


def test_busy_urls_are_cut_by_their_size(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "https://hot.org/", start + dt.timedelta(seconds=5000 if i % 3 == 0 else int(rng.integers(0, 9000))), 200 if rng.random() < 0.3 else 304, None) for i in range(3000)]
    rows += [(10_000 + i, "https://warm.org/", start + dt.timedelta(seconds=i), 200 if i % 5 == 0 else 304, None) for i in range(250)]
    rows += [(20_000 + i, f"https://cold{i % 50}.org/", start + dt.timedelta(seconds=i), 200 if i < 50 else 304, None) for i in range(100)] + [(None, "https://hot.org/", start, 304, None)]
    df = spark.createDataFrame(rows, KIND)
    got = {(r["record_id"], r["response_id"]) for r in warc.resolve_revisits(df, 100).collect()}
    full = {}
    for i, url, t, status, _ in rows:
        if status == 200:
            full.setdefault(url, []).append((t, i))
    want = {(i, max((x for x in full.get(url, []) if x[0] < t), default=(None, None))[1]) for i, url, t, status, _ in rows if status == 304}
    assert got == want
    known = df.select("record_id", "time", warc.canonical_url(F.col("url")).alias("_url"))
    busy = known.groupBy("_url").agg(F.count("*").alias("_n")).where("_n > 100")
    tasks = warc.in_buckets(known, busy, 31, 100).groupBy("_url", "_bucket", "_salt").count().orderBy(F.desc("count")).collect()
    assert tasks[0]["count"] <= 250 and sum(r["_url"].startswith("hot") for r in tasks) > 20 and 2 <= sum(r["_url"].startswith("warm") for r in tasks) <= 6
    assert {(r["_bucket"], r["_salt"]) for r in tasks if r["_url"].startswith("cold")} == {(0, 0)}
