"""Distributed order statistics against brute force, with heavy skew."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marshline.operators import selection as S, training as L


def skewed(spark, n=20000, seed=1):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 4, n))  # one group holds most rows
    v = np.where(rng.random(n) < 0.35, 0.5, rng.normal(size=n))  # one value holds a third
    w = np.where(rng.random(n) < 0.1, np.nan, rng.exponential(size=n))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "w": w})
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    return pdf, df


def test_exact_percentiles(spark):
    pdf, df = skewed(spark)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = S.exact_percentiles(df, ["v", "w"], probs, accuracy=100).first()
    for c in ("v", "w"):
        for p in probs:
            assert abs(got[S.percentile_name(c, p)] - pdf[c].quantile(p)) < 1e-12
    for few in (True, False):
        rows = {r["g"]: r for r in S.exact_percentiles(df, ["v", "w"], [0.5], ["g"], accuracy=100, few_groups=few).collect()}
        for g, part in pdf.groupby("g"):
            assert abs(rows[g]["v_p50"] - part["v"].median()) < 1e-12
            assert abs(rows[g]["w_p50"] - part["w"].median()) < 1e-12


def test_brackets_are_narrowed_to_a_budget(spark):
    """One group holds nearly all rows; no task ranks more different values than the budget says, and ties stay exact."""
    rng = np.random.default_rng(4)
    n = 60_000
    v = np.concatenate([rng.normal(size=n // 2), np.full(n // 4, 0.25), rng.normal(loc=9, scale=1e-6, size=n // 4)])
    pdf = pd.DataFrame({"g": np.where(np.arange(n) < 50, 1, 0), "v": v})
    df = spark.createDataFrame(pdf)
    probs, budget = [0.1, 0.5, 0.6, 0.9], 40
    values = df.select("g", F.lit("v").alias("feature"), F.col("v").alias("value"))
    for few in (True, False):
        bounds = S.brackets(values, ["g"], probs, 100, few, budget)
        sizes = [r["count"] for r in S.ranked_rows(values, bounds, ["g"], few).where("v is not null").groupBy("g", "feature", "i").count().collect()]
        assert len(sizes) == 8 and max(sizes) <= max(budget, 50) < 100  # 50: the small group, which is ranked whole
        rows = {r["g"]: r for r in S.exact_percentiles(df, ["v"], probs, ["g"], 100, few, budget).collect()}
        for g, part in pdf.groupby("g"):
            for p in probs:
                assert abs(rows[g][S.percentile_name("v", p)] - part["v"].quantile(p)) < 1e-12
    wide = S.ranked_rows(values, S.brackets(values, ["g"], probs, 100, True, 10**9), ["g"], True).where("v is not null").groupBy("i", "g").count()
    assert wide.agg(F.max("count")).first()[0] > 10 * budget  # what it would be without


def test_percentiles_of_few_rows(spark):
    for vals in ([3.0], [1.0, 2.0], [1.0, 2.0, 10.0], [5.0, 1.0, 2.0, 7.0]):
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        got = S.exact_percentiles(df, ["v"], [0.25, 0.5, 0.75]).first()
        assert list(got) == [float(np.quantile(vals, p)) for p in (0.25, 0.5, 0.75)]


def test_grouped_medians_hot_route(spark):
    pdf, df = skewed(spark)
    plain = {r["g"]: r["v"] for r in S.grouped_medians(df, ["g"], ["v", "w"], None).collect()}
    mixed = {r["g"]: r["v"] for r in S.grouped_medians(df, ["g"], ["v", "w"], 5000).collect()}
    assert plain == mixed and len(mixed) == 4


def test_grouped_medians_do_not_depend_on_the_size_of_a_key(spark):
    nan = float("nan")
    rows = [(1, 2.0, None), (1, nan, None), (1, 4.0, None), (2, None, nan), (2, None, None), (None, 7.0, 1.0), (None, 9.0, None), (3, nan, nan)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    plain = sorted(map(tuple, S.grouped_medians(df, ["g"], ["v", "w"], None).collect()), key=str)
    for size in (0, 1, 2):
        assert sorted(map(tuple, S.grouped_medians(df, ["g"], ["v", "w"], size).collect()), key=str) == plain
    assert plain == [(1, 3.0, None), (2, None, None), (3, None, None), (None, 8.0, 1.0)]


def test_folds_are_stratified(spark):
    df = spark.range(1007).selectExpr("id", "cast(id % 97 = 0 as int) as label")
    got = {(r["label"], r["fold"]): r["n"] for r in L.kfold(df, 5, ids=["id"]).groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        sizes = [got[label, i] for i in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == df.where(F.col("label") == label).count()


def test_running_totals(spark):
    pdf, df = skewed(spark)
    got = S.running_totals(df.select("v", F.lit(1).alias("n")), "v", ["n"], buckets=16).toPandas().sort_values("v")
    want = pdf.groupby("v").size().cumsum()
    assert (got["n_cum"].to_numpy() == want.to_numpy()).all()


def test_hash_take_exact(spark):
    _, df = skewed(spark, 5000)
    for n in (0, 1, 777, 5000, 9999):
        assert S.hash_take(df, ["id"], F.lit(n)).where("taken").count() == min(n, 5000)
    a = {r["id"] for r in S.hash_take(df, ["id"], F.lit(100)).where("taken").collect()}
    b = {r["id"] for r in S.hash_take(df.repartition(7), ["id"], F.lit(100)).where("taken").collect()}
    c = {r["id"] for r in S.hash_take(df, ["id"], F.lit(100), seed=7).where("taken").collect()}
    assert a == b != c


def test_stratified_split_counts(spark):
    pdf, df = skewed(spark, 5000)
    out = L.stratified_split(df, 0.2, "g", ["id"])
    rows = {r["g"]: r["n"] for r in out.where("is_test").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert rows == {g: int(len(p) * 0.2 + 0.5) for g, p in pdf.groupby("g")}
    assert out.count() == 5000


def test_ranking_metrics_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 1500)
    s = np.round(np.clip(0.3 * y + rng.random(1500) * 0.7, 0, 1), 2)
    got = L.ranking_metrics(spark.createDataFrame(pd.DataFrame({"score": s, "label": y}))).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp, fp = (pos >= t).sum(), (neg >= t).sum()
        ap, seen = ap + (tp - seen) / len(pos) * tp / (tp + fp), tp
    assert abs(got["roc_auc"] - auc) < 1e-12 and abs(got["average_precision"] - ap) < 1e-12
