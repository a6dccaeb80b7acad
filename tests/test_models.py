"""Fitted models on planted signals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marshline import constants as K
from marshline.operators import archetypes as M, suitability as U, training as L


def test_information_criteria_parameter_count():
    bic, aic = M.information_criteria(0.0, 4, 20, 100)
    assert aic == 2 * 923 and abs(bic - 923 * np.log(100)) < 1e-9


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    n = 1200
    pdf = pd.DataFrame({f: rng.normal(size=n) for f in K.MODEL_FEATURES})
    pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(-2 * pdf["NDVI"]))).astype(int)
    pdf["shannon_diversity"] = np.maximum(pdf["EVI"], 0)
    pdf["ix"], pdf["iy"], pdf["dekad"] = np.arange(n), 1, "2024-01-01"
    return spark.createDataFrame(pdf).cache()


def test_classifier_and_calibration(spark, labelled, tmp_path):
    model = U.train_suitability(labelled, folds=2, trees=6, regressor_trees=4)
    top = U.feature_importance_rank(spark, model.base).first()
    assert top["feature"] == "NDVI"
    out = U.calibrated_probability(labelled, model.pairs, model.features, "score").cache()
    lo, hi = out.agg(F.min("score"), F.max("score")).first()
    assert 0 <= lo <= hi <= 1
    row = L.classifier_metrics(out).first()
    assert row["roc_auc"] > 0.7
    assert abs(row["roc_auc"] - U.area_under_roc(out, "score")) < 0.01
    cells = labelled.select("ix", "iy", *K.INDICES).withColumn("acquisition_date", F.lit("2024-06-01").cast("date"))
    model.save(str(tmp_path / "m"))
    again = U.SuitabilityModel.load(spark, str(tmp_path / "m"))
    a = {r["ix"]: tuple(r) for r in model.score(cells).collect()}
    b = {r["ix"]: tuple(r) for r in again.score(cells).collect()}
    assert a == b and len(a) == 1200


def test_regressor_needs_rows(labelled):
    assert U.train_diversity_regressor(labelled.limit(49), trees=2) is None


def test_archetypes_find_planted_clusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 300
    which = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"ix": np.arange(n), "iy": 1, "NDVI_mean": which + rng.normal(scale=.05, size=n),
                        "flood_frequency": (which == 1) + rng.normal(scale=.05, size=n),
                        "NDVI_trend": rng.normal(size=n), "EVI_trend": rng.normal(size=n)})
    pdf["n_species_mean"] = which + 1.0
    pdf["shannon_diversity_mean"] = which * 0.5
    pdf["n_observations_mean"] = 1.0
    pdf["has_bird_data"] = 1
    profiles = spark.createDataFrame(pdf)
    assert M.clustering_features(profiles.columns) == ["NDVI_mean", "flood_frequency", "NDVI_trend", "EVI_trend"]
    model, results = M.train_archetypes(profiles, [3, 4], n_init=1, max_iter=30, variance=0.999)
    assert model.best_k in (3, 4) and results.count() == n
    row = results.agg(F.min("conservation_priority"), F.max("conservation_priority"), F.min("cluster_confidence")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 100) < 1e-9 and row[2] > 0.2
    model.save(str(tmp_path / "a"))
    again = M.score_profiles(M.ArchetypeModel.load(spark, str(tmp_path / "a")), profiles, norm="trained")
    diff = results.alias("a").join(again.alias("b"), "ix").agg(
        F.max(F.abs(F.col("a.conservation_priority") - F.col("b.conservation_priority"))),
        F.sum((F.col("a.trajectory") != F.col("b.trajectory")).cast("int"))).first()
    assert diff[0] < 1e-9 and diff[1] == 0
    report = M.model_diagnostics(model, model.cluster(profiles), results).first()
    assert report["n_cells"] == n and abs(report["suitability_diversity_correlation"] - 1) < 1e-6
