"""The registered model queries fit with the operators' full sizes."""

import inspect
from types import SimpleNamespace

import pytest

from catalog import load
from marshline import constants as K
from marshline.operators import archetypes as M, suitability as U, training as L

QUERIES = load().QUERIES
from catalog import models as C  # noqa: E402  (after the tables that it builds on)

#: Query, operator, and the arguments in which it may differ from the defaults.
CALLS = [("gmm_search", M, "gmm_search", {}), ("cluster_assign", M, "gmm_search", {"ks": [4]}), ("silhouette", M, "gmm_search", {"ks": [4]}),
         ("gmm_search", M, "pca_variance", {}), ("train_archetypes", M, "train_archetypes", {}), ("score_profiles", M, "train_archetypes", {}),
         ("model_diagnostics", M, "train_archetypes", {}), ("train_presence_classifier", U, "train_presence_classifier", {}),
         ("calibrate_isotonic", U, "calibrate_isotonic", {}), ("train_diversity_regressor", U, "train_diversity_regressor", {}),
         ("feature_importance_rank", U, "train_presence_classifier", {}), ("cross_validate", U, "cross_validate", {}),
         ("score_cells", U, "train_suitability", {}), ("score_aoi", U, "train_suitability", {})]


class Called(Exception):
    pass


@pytest.mark.parametrize("query,module,operator,other", CALLS, ids=lambda x: x if isinstance(x, str) else "")
def test_operators_run_with_their_defaults(monkeypatch, query, module, operator, other):
    want = inspect.signature(getattr(module, operator))

    def seen(*args, **named):
        raise Called(want.bind(*args, **named).arguments)

    table = SimpleNamespace(where=lambda *_: table, withColumn=lambda *_: table)
    monkeypatch.setattr(L, "stratified_split", lambda df: df)
    for name in ("_profiles", "_vectors", "_train"):
        monkeypatch.setattr(C, name, lambda spark, d: table)
    for name in ("latest_sat", "scenes", "pixels", "aois"):
        monkeypatch.setattr(C.X, name, lambda spark, d: table)
    monkeypatch.setattr(C, "F", SimpleNamespace(lit=lambda x: x))
    monkeypatch.setattr(C, "stage", lambda df, name: df)
    if operator == "gmm_search":
        monkeypatch.setattr(C, "_components", lambda spark, d: (table, 2))
    monkeypatch.setattr(module, operator, seen)
    with pytest.raises(Called) as found:
        QUERIES[query](None, "")
    given = {k: v for k, v in found.value.args[0].items() if want.parameters[k].default is not inspect.Parameter.empty}
    given |= given.pop("params", {})
    assert given == other
    assert (K.PCA_VARIANCE, K.CLASSIFIER["trees"], K.REGRESSOR["trees"]) == (0.95, 500, 300)


def test_silhouette_of_one_label(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense(float(i), 1.0), 0) for i in range(5)], ["pca", "cluster"])
    assert M.silhouette(df) == 0.0
