"""Unsupervised habitat archetypes: scaling, PCA, mixture search, scoring."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marshline import constants as K
from marshline.functions.casting import nonfinite_to_zero
from marshline.operators import scoring as S
from marshline.operators.mixtures import Mixture, assigned, coordinates, fit_mixtures, mean_silhouettes
from marshline.operators.scoring import best_k
from marshline.session import stage


def clustering_features(columns: list[str]) -> list[str]:
    """Profile columns used for clustering: satellite features only."""
    bird = tuple(K.BIRD_METRICS) + ("has_bird_data",)
    skip = {"ix", "iy", "cell_x", "cell_y", "cluster", "cluster_confidence"}
    return [c for c in columns if c not in skip and not c.startswith(bird) and not c.endswith("_total")]


def _zscore(col: Column, mean: Column, std: Column) -> Column:
    return (col - mean) / F.when(std > 0, std).otherwise(1.0)


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores by population deviation; constant columns become 0."""
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).alias("s")).scalar()
    return df.withColumn("_s", stats).withColumns(
        {c: _zscore(F.col(c), F.col("_s")[c]["m"], F.col("_s")[c]["s"]) for c in cols}).drop("_s")


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column: one eager aggregate row."""
    row = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in cols]).first()
    return {c: (float(row[c][0]), float(row[c][1])) for c in cols}


def scaled_vectors(df: DataFrame, scaler: dict[str, tuple[float, float]], out: str = "scaled") -> DataFrame:
    """Standardised feature vectors; features a table lacks count as 0 before scaling."""
    have = set(df.columns)
    z = [
        _zscore(nonfinite_to_zero(F.col(c).cast("double")) if c in have else F.lit(0.0), F.lit(m), F.lit(s)).alias(f"_z_{c}")
        for c, (m, s) in scaler.items()]
    wide = df.select("*", *z)
    names = [f"_z_{c}" for c in scaler]
    return VectorAssembler(inputCols=names, outputCol=out).transform(wide).drop(*names)


def pca_variance(df: DataFrame, col: str = "scaled", share: float = K.PCA_VARIANCE) -> tuple[PCAModel, int, list[float]]:
    """PCA and the fewest components whose variance share reaches ``share``."""
    width = df.schema[col].metadata.get("ml_attr", {}).get("num_attrs") or len(df.select(col).first()[0])
    model = PCA(k=width, inputCol=col, outputCol="pca_full").fit(df)
    shares = [float(v) for v in model.explainedVariance]
    total, n = 0.0, 0
    for v in shares:
        total, n = total + v, n + 1
        if total > share:
            break
    return model, n, shares


def _components(df: DataFrame, pca: PCAModel, n: int, out: str = "pca") -> DataFrame:
    full = pca.setInputCol("scaled").setOutputCol("pca_full").transform(df)
    return VectorSlicer(inputCol="pca_full", outputCol=out, indices=list(range(n))).transform(full).drop("pca_full", "scaled")


def information_criteria(loglik: float, k: int, d: int, n: int) -> tuple[float, float]:
    """BIC and AIC of a full-covariance mixture."""
    import math
    p = k * d + k * d * (d + 1) / 2 + k - 1
    return -2 * loglik + p * math.log(n), -2 * loglik + 2 * p


def silhouette(df: DataFrame, features: str = "pca", cluster: str = "cluster", sample: int = 10_000) -> float:
    """Mean Euclidean silhouette over at most ``sample`` rows; 0 where all rows have one label."""
    return mean_silhouettes(df, features, [cluster], sample)[0]


def dispersion_ratios(df: DataFrame, cols: list[str], cluster: str, by: list[str]) -> DataFrame:
    """Between to within dispersion ratio of each group of ``by``, from per-cluster sums."""
    per = df.groupBy(*by, cluster).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols],
        sum((F.var_pop(c) for c in cols[1:]), F.var_pop(cols[0])).alias("v"))
    mean = {c: F.sum(F.col("n") * F.col(f"m_{c}")) / F.sum("n") for c in cols}
    between = [F.sum(F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}")) - F.sum("n") * mean[c] * mean[c] for c in cols]
    flat = per.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("v")).alias("within"),
                                sum(between[1:], between[0]).alias("between"))
    c = F.col
    return flat.select(*by, F.try_divide(c("between") * (c("rows") - c("k")), c("within") * (c("k") - 1))
                       .alias("calinski_harabasz"))


def calinski_harabasz(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Between to within dispersion ratio, from per-cluster sums."""
    return dispersion_ratios(df, cols, cluster, [])


def cluster_assign(df: DataFrame, model: Mixture, features: str = "pca") -> DataFrame:
    """Most likely component and its membership probability."""
    return (df.withColumn("_p", assigned(coordinates(df, features), model)[0])
            .withColumns({"cluster": F.col("_p")["cluster"], "cluster_confidence": F.col("_p")["confidence"]}).drop("_p"))


def gmm_search(df: DataFrame, d: int, ks=range(K.MIN_CLUSTERS, K.MAX_CLUSTERS + 1), n_init: int = 3,
               max_iter: int = 300, seed: int = 42, features: str = "pca") -> tuple[list[dict], dict]:
    """Best of ``n_init`` full-covariance mixtures per k, with quality measures.

    ``df`` should be a stored table: every iteration scans it, for all k and starts together. A k without a mixture has null measures
    and the reason.
    """
    fits = fit_mixtures(df, ks, features, n_init, max_iter, seed=seed)
    models = {k: m for k, m in fits.items() if isinstance(m, Mixture)}
    measured = {}
    if models:
        arr = coordinates(df, features)
        labels = assigned(arr, *models.values())
        labelled = stage(df.select(arr.alias("_x"), labels.alias("_l")).select(
            *[F.col("_x")[j].alias(f"c{j}") for j in range(d)], F.col("_x").alias("x"), *[F.col("_l")[i]["cluster"].alias(f"k{k}") for i, k in enumerate(models)]), "labelled")
        n = labelled.count()
        near = mean_silhouettes(labelled, "x", [f"k{k}" for k in models])
        cols = [f"c{j}" for j in range(d)]
        long = labelled.select(*cols, F.inline(F.array(*[F.struct(F.lit(int(k)).alias("k_of"), F.col(f"k{k}").alias("cluster")) for k in models])))
        ratios = {r["k_of"]: r["calinski_harabasz"] for r in dispersion_ratios(long, cols, "cluster", ["k_of"]).collect()}  # one row a k
        for (k, m), s in zip(models.items(), near):
            bic, aic = information_criteria(m.log_likelihood, k, d, n)
            measured[k] = {"bic": float(bic), "aic": float(aic), "silhouette": float(s), "calinski_harabasz": ratios[k], "reason": None}
    nothing = {"bic": None, "aic": None, "silhouette": None, "calinski_harabasz": None}
    return [{"k": int(k), **(measured[k] if k in measured else {**nothing, "reason": m})} for k, m in fits.items()], models


SEARCH_SCHEMA = "k int, bic double, aic double, silhouette double, calinski_harabasz double, reason string"


@dataclass
class ArchetypeModel:
    """A fitted archetype model: everything needed to score new profiles."""

    scaler: dict[str, tuple[float, float]]
    pca: PCAModel
    n_components: int
    gmm: Mixture
    search: list[dict]
    best_k: int
    variance: float = 0.0
    suitability: dict[int, float] = field(default_factory=dict)
    percentiles: tuple[float, float] = (0.0, 0.0)
    trend_bounds: tuple[float, float] = (0.0, 0.0)
    priority_bounds: tuple[float, float] = (0.0, 0.0)

    def cluster(self, profiles: DataFrame) -> DataFrame:
        comps = _components(scaled_vectors(profiles, self.scaler), self.pca, self.n_components)
        return cluster_assign(comps, self.gmm).drop("pca")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.pca.write().overwrite().save(f"{path}/pca")
        plain = {k: v for k, v in self.__dict__.items() if k not in ("pca", "gmm")} | {"gmm": self.gmm.to_dict()}
        spark.createDataFrame([(json.dumps(plain),)], "value string").write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ArchetypeModel":
        p = json.loads(spark.read.text(f"{path}/params").first()[0])
        p["scaler"] = {k: tuple(v) for k, v in p["scaler"].items()}
        p["suitability"] = {int(k): v for k, v in p["suitability"].items()}
        for k in ("percentiles", "trend_bounds", "priority_bounds"):
            p[k] = tuple(p[k])
        return cls(pca=PCAModel.load(f"{path}/pca"), gmm=Mixture.from_dict(p.pop("gmm")), **p)


def train_archetypes(profiles: DataFrame, ks=range(K.MIN_CLUSTERS, K.MAX_CLUSTERS + 1), n_init: int = 3,
                     max_iter: int = 300, seed: int = 42,
                     variance: float = K.PCA_VARIANCE) -> tuple[ArchetypeModel, DataFrame]:
    """Scale, reduce, search mixtures and score; returns the model and results."""
    from marshline.plans.habitat import habitat_results

    spark = profiles.sparkSession
    cols = clustering_features(profiles.columns)
    scaler = fit_scaler(profiles, cols)
    vectors = stage(scaled_vectors(profiles.select("ix", "iy", *cols), scaler).select("ix", "iy", "scaled"), "vectors")
    pca, n, shares = pca_variance(vectors, share=variance)
    comps = stage(_components(vectors, pca, n), "components")
    rows, models = gmm_search(comps, n, ks, n_init, max_iter, seed)
    if not models:
        raise ValueError("no mixture could be fitted: " + "; ".join(sorted({r["reason"] for r in rows})))
    best = best_k(spark.createDataFrame(rows, SEARCH_SCHEMA)).first()["k"]
    model = ArchetypeModel(scaler, pca, n, models[best], rows, int(best), sum(shares[:n]))
    clustered = stage(model.cluster(profiles), "clustered")
    results = stage(habitat_results(clustered), "results")
    model.suitability = {int(r[0]): float(r[1]) for r in
                         results.groupBy("cluster").agg(F.first("habitat_suitability")).collect()}
    q = S.exact_percentiles(results, ["trend_composite"], [0.25, 0.75]).first()
    model.percentiles = (float(q[0]), float(q[1]))
    s = F.col("habitat_suitability") / 100
    u = 1 - F.col("trend_score") / 100
    ws, wu, wi = K.PRIORITY_WEIGHTS
    raw = ws * s + wu * u + wi * (s * u)
    lo = results.agg(F.min("trend_composite"), F.max("trend_composite"), F.min(raw), F.max(raw)).first()
    model.trend_bounds, model.priority_bounds = (float(lo[0]), float(lo[1])), (float(lo[2]), float(lo[3]))
    return model, results


def score_profiles(model: ArchetypeModel, profiles: DataFrame, norm: str = "batch") -> DataFrame:
    """Score new profiles with a saved model.

    Trajectories use the saved percentiles. ``norm="batch"`` rescales by the new
    table's own range, ``norm="trained"`` by the training range.
    """
    from marshline.plans.habitat import RESULT_COLUMNS, score_results

    spark = profiles.sparkSession
    scores = spark.createDataFrame(list(model.suitability.items()), "cluster int, habitat_suitability double")
    saved = norm == "trained"
    return score_results(
        model.cluster(profiles), scores, model.percentiles,
        model.trend_bounds if saved else None, model.priority_bounds if saved else None).select(*RESULT_COLUMNS)


def model_diagnostics(model: ArchetypeModel, clustered: DataFrame, results: DataFrame) -> DataFrame:
    """One row: sizes, search table, cluster scores, trajectories, priorities.

    The nested lists have one entry per tried k, cluster or trajectory.
    """
    spark = results.sparkSession
    scores = S.cluster_bird_scores(clustered)
    suit = results.groupBy("cluster").agg(F.first("habitat_suitability").alias("habitat_suitability"))

    def rows_of(df: DataFrame) -> Column:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)))).scalar()

    search = spark.createDataFrame(model.search, SEARCH_SCHEMA)
    stats = S.priority_stats(results)
    return results.agg(F.count("*").alias("n_cells")).select(
        "n_cells", F.lit(len(model.scaler)).alias("n_features_original"),
        F.lit(model.n_components).alias("n_pca_components"),
        F.lit(model.variance).alias("pca_variance_explained"), F.lit(model.best_k).alias("best_k"),
        rows_of(search).alias("cluster_search"), rows_of(scores).alias("cluster_bird_scores"),
        rows_of(S.trajectory_distribution(results).select("trajectory", "n_cells")).alias("trajectory_distribution"),
        stats.select(F.struct(*stats.columns)).scalar().alias("conservation_priority_stats"),
        S.suitability_diversity_corr(suit, scores).scalar().alias("suitability_diversity_correlation"))
