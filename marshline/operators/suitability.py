"""Supervised suitability: boosted presence classifier, calibration, regressor."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession, functions as F

from marshline import constants as K
from marshline.functions.features import scoring_features
from marshline.functions.labels import suitability_class
from marshline.operators.boosting import Boosted, boost, predicted
from marshline.operators.isotonic import Isotonic, fit_isotonic
from marshline.operators.training import classifier_metrics, kfold
from marshline.session import stage


def _classifiers(df: DataFrame, features: list[str], label: str, trees: int, depth: int, seed: int, **which) -> list[Boosted]:
    p = K.CLASSIFIER
    return boost(df, features, label, "log", trees, depth, p["step"], p["subsample"], p["min_leaf"], seed=seed, **which)


def train_presence_classifier(df: DataFrame, features: list[str] = K.MODEL_FEATURES, label: str = "label",
                              trees: int = K.CLASSIFIER["trees"], depth: int = K.CLASSIFIER["depth"],
                              seed: int = 42) -> Boosted:
    """Boosted trees for presence; ``df`` holds the feature columns and label."""
    return _classifiers(df, features, label, trees, depth, seed)[0]


def train_diversity_regressor(df: DataFrame, features: list[str] = K.MODEL_FEATURES,
                              target: str = "shannon_diversity", trees: int = K.REGRESSOR["trees"],
                              depth: int = K.REGRESSOR["depth"], seed: int = 42) -> Boosted | None:
    """Boosted trees for diversity on rows with birds; None under 50 rows."""
    if df.limit(K.MIN_REGRESSION_ROWS).count() < K.MIN_REGRESSION_ROWS:
        return None
    p = K.REGRESSOR
    return boost(df.fillna(0.0, subset=[target]), features, target, "square", trees, depth, p["step"], p["subsample"], p["min_leaf"], seed=seed)[0]


def presence_probability(df: DataFrame, model: Boosted, features: list[str], out: str) -> DataFrame:
    """Add a classifier's raw probability of presence."""
    return df.withColumn(out, predicted([model], features)[0])


def diversity_prediction(df: DataFrame, model: Boosted, features: list[str], out: str) -> DataFrame:
    """Add a regressor's prediction."""
    return df.withColumn(out, predicted([model], features)[0])


def held_out_scores(df: DataFrame, models: list[Boosted], features: list[str], out: str = "score") -> DataFrame:
    """Add the probability by the model that was grown without the row's own fold."""
    return df.withColumn(out, predicted(models, features, F.col("fold"))[0])


def _calibrated(folds: DataFrame, models: list[Boosted], features: list[str], label: str) -> list[tuple[Boosted, Isotonic]]:
    scored = held_out_scores(folds.select("fold", label, *features), models, features, "_s")
    curves = fit_isotonic(scored, "_s", label, "fold")
    nothing = Isotonic(np.zeros(0), np.zeros(0))
    return [(m, curves.get(i, nothing)) for i, m in enumerate(models)]


def calibrate_isotonic(df: DataFrame, features: list[str] = K.MODEL_FEATURES, label: str = "label", k: int = 5,
                       trees: int = K.CLASSIFIER["trees"], depth: int = K.CLASSIFIER["depth"], seed: int = 42) -> list[tuple[Boosted, Isotonic]]:
    """One classifier per fold with an isotonic map fitted on the fold left out; the classifiers are grown together."""
    folds = stage(kfold(df, k, label), "folds")
    models = _classifiers(folds, features, label, trees, depth, seed, fold="fold", folds=k, base=False)
    return _calibrated(folds, models, features, label)


def calibrated_probability(df: DataFrame, pairs: list[tuple[Boosted, Isotonic]], features: list[str], out: str) -> DataFrame:
    """Mean of the calibrated fold classifiers."""
    curves = [c for _, c in pairs]

    @F.pandas_udf("double")
    def mean(scores):
        import pandas as pd
        values = np.array(scores.tolist(), float).reshape(len(scores), len(curves))
        return pd.Series(np.mean([c(v) for c, v in zip(curves, values.T)], axis=0))

    return df.withColumn(out, mean(predicted([m for m, _ in pairs], features)))


def feature_importance_rank(spark: SparkSession, model: Boosted, features: list[str] = K.MODEL_FEATURES) -> DataFrame:
    """Importance per feature, largest first; equal ones by name."""
    rows = [(f, float(v)) for f, v in zip(features, model.importances)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def cross_validate(df: DataFrame, features: list[str] = K.MODEL_FEATURES, label: str = "label", k: int = 5,
                   trees: int = K.CLASSIFIER["trees"], depth: int = K.CLASSIFIER["depth"], seed: int = 42) -> DataFrame:
    """Mean and deviation of AUC, average precision and F1 over k folds, whose classifiers are grown together."""
    folds = stage(kfold(df, k, label), "folds")
    models = _classifiers(folds, features, label, trees, depth, seed, fold="fold", folds=k, base=False)
    held = stage(held_out_scores(folds.select("fold", label, *features), models, features).select("fold", label, "score"), "held_out")
    per_fold = None
    for i in range(k):
        row = classifier_metrics(held.where(F.col("fold") == i), "score", label).select(
            F.lit(i).alias("fold"), "roc_auc", "average_precision", F.col("present_f1").alias("f1"))
        per_fold = row if per_fold is None else per_fold.unionByName(row)
    return per_fold.agg(*[f(c).alias(f"{c}_{n}") for c in ("roc_auc", "average_precision", "f1")
                          for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


@dataclass
class SuitabilityModel:
    """Calibrated presence classifier with an optional diversity regressor."""

    features: list[str]
    base: Boosted
    pairs: list = field(default_factory=list)
    regressor: Boosted | None = None

    def score(self, cells: DataFrame, doy_period: float = 365.0) -> DataFrame:
        return score_cells(cells, self, doy_period)

    def save(self, path: str) -> None:
        parts = {"base": self.base.to_dict(), "regressor": self.regressor and self.regressor.to_dict(), "features": self.features, "folds": len(self.pairs)}
        for i, (m, curve) in enumerate(self.pairs):
            parts |= {f"fold{i}": m.to_dict(), f"isotonic{i}": curve.to_dict()}
        SparkSession.active().createDataFrame([(k, json.dumps(v)) for k, v in parts.items()], "part string, value string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SuitabilityModel":
        p = {r["part"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()}  # a row for each part of the model
        pairs = [(Boosted.from_dict(p[f"fold{i}"]), Isotonic.from_dict(p[f"isotonic{i}"])) for i in range(p["folds"])]
        return cls(p["features"], Boosted.from_dict(p["base"]), pairs, p["regressor"] and Boosted.from_dict(p["regressor"]))


def train_suitability(train: DataFrame, features: list[str] = K.MODEL_FEATURES, label: str = "label",
                      target: str = "shannon_diversity", folds: int = 5, trees: int = K.CLASSIFIER["trees"],
                      regressor_trees: int = K.REGRESSOR["trees"], depth: int = K.CLASSIFIER["depth"], seed: int = 42) -> SuitabilityModel:
    """Fit classifier, calibration and regressor on a stored feature table; the classifier and those of the folds are grown together."""
    dealt = stage(kfold(train, folds, label), "folds")
    base, *models = _classifiers(dealt, features, label, trees, depth, seed, fold="fold", folds=folds)
    pairs = _calibrated(dealt, models, features, label)
    reg = train_diversity_regressor(train.where(F.col(label) == 1), features, target, trees=regressor_trees)
    return SuitabilityModel(list(features), base, pairs, reg)


def score_cells(cells: DataFrame, model: SuitabilityModel, doy_period: float = 365.0) -> DataFrame:
    """Probability, percent, class and predicted diversity per cell.

    ``cells`` carries the indices and ``acquisition_date``.
    """
    keep = [c for c in cells.columns if c not in model.features]
    wet = cells.withColumn("_water", F.coalesce(F.col("water_mask"), F.lit(0.0)))
    x = scoring_features(wet, F.col("acquisition_date"), [*keep, "_water"], model.features, doy_period)
    rated = calibrated_probability(x, model.pairs, model.features, "suitability_probability")
    if model.regressor is not None:
        rated = diversity_prediction(rated, model.regressor, model.features, "_d")
    else:
        rated = rated.withColumn("_d", F.lit(0.0))
    p = F.col("suitability_probability")
    return rated.select(
        *keep, p, F.bround(p * 100, 1).alias("suitability_pct"),
        suitability_class(p, F.col("_water")).alias("archetype"),
        F.bround(F.greatest(F.col("_d"), F.lit(0.0)), 2).alias("predicted_diversity"))


def area_under_roc(df: DataFrame, score: str, label: str = "label") -> float:
    """AUC of scored rows by Spark's evaluator (a cross-check of our own curve)."""
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label).evaluate(df)
