"""Scores of clustered cells: suitability, trajectory, conservation priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marshline import constants as K
from marshline.functions.labels import cluster_label
from marshline.operators.selection import exact_percentiles, percentile_struct


def scale_between(value: Column, lo: Column, hi: Column, top: float = 100.0) -> Column:
    """``value`` mapped from ``lo..hi`` to ``0..top``; an empty range counts as 1."""
    span = F.when(hi > lo, hi - lo).otherwise(1.0)
    return (value - lo) / span * top


def minmax_scale(df: DataFrame, col: str, out: str, top: float = 100.0,
                 bounds: tuple[float, float] | None = None) -> DataFrame:
    """Scale a column to ``0..top`` by its own range, or by saved ``bounds``.

    The range is a scalar subquery: two numbers, no join and no global window.
    """
    if bounds is not None:
        return df.withColumn(out, scale_between(F.col(col), F.lit(bounds[0]), F.lit(bounds[1]), top))
    rng = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("r")).scalar()
    return (df.withColumn("_r", rng)
            .withColumn(out, scale_between(F.col(col), F.col("_r.lo"), F.col("_r.hi"), top)).drop("_r"))


def trend_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_trend")]


def trend_composite(df: DataFrame, weights: dict[str, float] = K.TREND_WEIGHTS) -> DataFrame:
    """Weighted sum of the trend columns; weights sum to one, missing counts 0."""
    cols = trend_columns(df)
    raw = {c: weights.get(c, K.OTHER_TREND_WEIGHT) for c in cols}
    total = sum(raw.values())
    expr = F.lit(0.0)
    for c in cols:
        expr = expr + F.coalesce(F.col(c), F.lit(0.0)) * F.lit(raw[c] / total)
    return df.withColumn("trend_composite", expr)


def trajectory(df: DataFrame, percentiles: tuple[float, float] | None = None,
               col: str = "trend_composite") -> DataFrame:
    """improving above the 75th, degrading below the 25th percentile, else stable."""
    if percentiles is not None:
        low, high = F.lit(percentiles[0]), F.lit(percentiles[1])
        staged = df
    else:
        staged = df.withColumn("_q", percentile_struct(df, [col], [0.25, 0.75]))
        low, high = F.col(f"_q.{col}_p25"), F.col(f"_q.{col}_p75")
    label = F.when(F.col(col) > high, "improving").when(F.col(col) < low, "degrading").otherwise("stable")
    return staged.withColumn("trajectory", label).drop("_q")


def cluster_bird_scores(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Median bird statistics per cluster over cells with birds, and cell counts."""
    cols = ["n_species_mean", "shannon_diversity_mean", "n_observations_mean"]
    birded = F.col("has_bird_data") == 1
    sizes = df.groupBy(cluster).agg(
        F.count(F.when(birded, 1)).alias("cells_with_data"), F.count("*").alias("total_cells"))
    medians = exact_percentiles(df.where(birded), cols, [0.5], [cluster]).select(
        cluster, F.col("n_species_mean_p50").alias("median_species"),
        F.col("shannon_diversity_mean_p50").alias("median_diversity"),
        F.col("n_observations_mean_p50").alias("median_observations"))
    return sizes.join(medians, cluster, "left")


def habitat_suitability(scores: DataFrame, cluster: str = "cluster") -> DataFrame:
    """0-100 score per cluster from its median diversity.

    Clusters without birds take the median of the other clusters' medians.
    ``scores`` has one row per mixture component (at most a few dozen), so it is
    folded into a single row and unfolded again.
    """
    folded = scores.agg(
        F.median("median_diversity").alias("mid"),
        F.collect_list(F.struct(F.col(cluster), F.col("median_diversity").alias("d"))).alias("items"))
    filled = folded.select(F.transform("items", lambda i: F.struct(
        i[cluster].alias(cluster), F.coalesce(i["d"], F.col("mid"), F.lit(0.0)).alias("d"))).alias("items"))
    spread = filled.withColumns({
        "lo": F.array_min(F.transform("items", lambda i: i["d"])),
        "hi": F.array_max(F.transform("items", lambda i: i["d"]))})
    return (spread.select("lo", "hi", F.explode("items").alias("i"))
            .select(f"i.{cluster}", scale_between(F.col("i.d"), F.col("lo"), F.col("hi"))
                    .alias("habitat_suitability")))


def map_cluster_scores(df: DataFrame, scores: DataFrame, cluster: str = "cluster",
                       score: str = "habitat_suitability") -> DataFrame:
    """Look up each row's cluster score.

    The score table has one row per mixture component, so it becomes a map
    literal for the scan instead of a join on a handful of very hot keys.
    """
    table = scores.agg(F.map_from_entries(F.collect_list(F.struct(F.col(cluster), F.col(score))))).scalar()
    return (df.withColumn("_m", table)
            .withColumn(score, F.try_element_at(F.col("_m"), F.col(cluster))).drop("_m"))


def conservation_priority(df: DataFrame, bounds: tuple[float, float] | None = None) -> DataFrame:
    """0-100 priority: value, urgency, and good habitat at risk."""
    ws, wu, wi = K.PRIORITY_WEIGHTS
    s = F.col("habitat_suitability") / 100
    u = 1 - F.col("trend_score") / 100
    raw = df.withColumn("_raw_priority", ws * s + wu * u + wi * (s * u))
    return minmax_scale(raw, "_raw_priority", "conservation_priority", bounds=bounds).drop("_raw_priority")


def cluster_profiles(df: DataFrame, features: list[str], scores: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean features per cluster with bird scores, size and a readable label."""
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in features], F.count("*").alias("n_cells"))
    birds = scores.select(cluster, *[F.col(c).alias(f"bird_{c}") for c in scores.columns if c != cluster])

    def have(c: str) -> Column:
        return F.col(c) if c in features else F.lit(None).cast("double")

    return means.join(birds, cluster, "left").withColumn(
        "archetype_label", cluster_label(have("flood_frequency"), have("NDVI_mean"), have("NDVI_trend")))


def priority_stats(df: DataFrame, col: str = "conservation_priority") -> DataFrame:
    """mean, std, min, max, p25 and p75 of the priority in one row."""
    quartiles = percentile_struct(df, [col], [0.25, 0.75])
    return df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                  F.min(col).alias("min"), F.max(col).alias("max")).withColumn("_q", quartiles).select(
        "mean", "std", "min", "max", F.col(f"_q.{col}_p25").alias("p25"), F.col(f"_q.{col}_p75").alias("p75"))


def trajectory_distribution(df: DataFrame) -> DataFrame:
    """Cells, share in percent and mean priority per trajectory."""
    total = df.agg(F.count("*")).scalar()
    return df.groupBy("trajectory").agg(
        F.count("*").alias("n_cells"), F.avg("conservation_priority").alias("mean_priority")
    ).withColumn("pct", 100.0 * F.col("n_cells") / total)


def common_clusters(left: DataFrame, right: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters present in both tables, with the columns of both."""
    return left.join(right, cluster)


def suitability_diversity_corr(suit: DataFrame, medians: DataFrame) -> DataFrame:
    """Pearson correlation over common clusters; missing for two or fewer."""
    both = common_clusters(suit, medians.where(F.col("median_diversity").isNotNull()))
    return both.agg(F.when(F.count("*") > 2, F.corr("habitat_suitability", "median_diversity"))
                    .alias("suitability_diversity_correlation"))


def best_k(search: DataFrame) -> DataFrame:
    """Row of the search table with the best equal blend of BIC and silhouette.

    The search table has one row per tried k; ties go to the smallest k.
    """
    rng = search.agg(F.struct(*[
        f(c).alias(f"{n}_{c}") for c in ("bic", "silhouette") for n, f in (("lo", F.min), ("hi", F.max))
    ]).alias("r")).scalar()

    def unit(c: str) -> Column:
        lo, hi = F.col(f"_r.lo_{c}"), F.col(f"_r.hi_{c}")
        return (F.col(c) - lo) / (hi - lo + F.lit(1e-10))

    scored = search.withColumn("_r", rng).withColumn(
        "combined_score", (1 - unit("bic")) * 0.5 + unit("silhouette") * 0.5).drop("_r")
    return scored.orderBy(F.desc("combined_score"), F.asc("k")).limit(1)


def top_priority_cells(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` cells of highest priority; equal cells by key."""
    return df.orderBy(F.desc("conservation_priority"), "ix", "iy").limit(n)
