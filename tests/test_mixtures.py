"""Mixtures against planted groups and plain float64 computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from catalog import load
from marshline.operators import archetypes as M, mixtures as X
from conftest import SF


def table(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "pca": x.tolist()})).repartition(3).cache()


def planted(d, groups, each=150, gap=12.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups * each, d))
    for g in range(groups):
        x[g * each:(g + 1) * each, g % d] += gap
    return x, np.repeat(np.arange(groups), each)


@pytest.mark.parametrize("d", [20, 40])
def test_groups_in_many_dimensions(spark, d):
    x, own = planted(d, 2, each=300)
    df = table(spark, x)
    model = X.fit_mixtures(df, [2])[2]
    got = M.cluster_assign(df, model).toPandas().sort_values("id")
    assert (got.cluster_confidence > 0.99).all()
    assert len(set(zip(got.cluster, own))) == 2


def test_search_finds_the_planted_number(spark):
    x, _ = planted(8, 5)
    rows, models = M.gmm_search(table(spark, x), 8, [2, 3, 4, 5, 6, 7])
    assert sorted(models) == [2, 3, 4, 5, 6, 7] and all(r["reason"] is None for r in rows)
    assert M.best_k(spark.createDataFrame(rows, M.SEARCH_SCHEMA)).first()["k"] == 5


def plain_em(x, centres, steps, floor=X.FLOOR):
    """Maximisation and expectation with nothing shared: densities by solving for every row and component."""
    n, d = x.shape
    p = np.eye(len(centres))[((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)]
    for _ in range(steps + 1):
        w = p.sum(axis=0)
        mu = p.T @ x / w[:, None]
        cov = [((x - m).T * q) @ (x - m) / q.sum() + floor * np.eye(d) for m, q in zip(mu, p.T)]
        log = np.stack([np.log(v / n) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.einsum("nd,nd->n", x - m, np.linalg.solve(c, (x - m).T).T))
                        for v, m, c in zip(w, mu, cov)], axis=1)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        p = np.exp(log - total[:, None])
    return w / n, mu, np.array(cov), total.sum()


def test_as_a_plain_computation(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 100  # far from the origin, overlapping groups
    x[:150] += rng.normal(size=12) * 3
    model = X.fit_mixtures(table(spark, x), [3], n_init=1, max_iter=15, tol=0.0)[3]
    sample = table(spark, x).selectExpr("pca", "xxhash64(pca) as h").orderBy("h").toPandas()
    drawn = np.array(sample.pca.tolist())
    shift = drawn.mean(axis=0)
    w, mu, cov, log = plain_em(x, X.starts(drawn - shift, 3, np.random.default_rng([42, 0])) + shift, 15)
    assert model.iterations == 15 and abs(model.log_likelihood - log) < 1e-6 * abs(log)
    assert np.allclose(model.weights, w) and np.allclose(model.means, mu) and np.allclose(model.covariances, cov, atol=1e-6)


def test_equal_rows_and_few_rows(spark):
    df = table(spark, np.vstack([np.zeros((30, 3)), np.ones((10, 3))]))
    rows, models = M.gmm_search(df, 3, [2, 41], n_init=2)
    assert rows[0]["k"] == 2 and abs(rows[0]["silhouette"] - 1) < 1e-9
    assert rows[1] == {"k": 41, "bic": None, "aic": None, "silhouette": None, "calinski_harabasz": None, "reason": "40 rows are fewer than 41 clusters"}
    assert M.best_k(spark.createDataFrame(rows, M.SEARCH_SCHEMA)).first()["k"] == 2
    assert {r["cluster_confidence"] for r in M.cluster_assign(df, models[2]).collect()} == {1.0}
    again = X.Mixture.from_dict(models[2].to_dict())
    assert np.array_equal(again.means, models[2].means) and again.converged == models[2].converged


def test_fits_that_fail_are_named(spark, monkeypatch):
    def broken(self):
        raise np.linalg.LinAlgError("planted")
    monkeypatch.setattr(X.Mixture, "factors", broken)
    rows, models = M.gmm_search(table(spark, planted(2, 2)[0]), 2, [2])
    assert not models and "planted" in rows[0]["reason"]


def plain_silhouette(x, own):
    gap = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        same = (own == own[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = gap[i, same].mean(), min(gap[i, own == c].mean() for c in set(own) - {own[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


def test_silhouette_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 64)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(300, 4)), np.zeros((20, 4))])
    own, lone = rng.integers(0, 3, 320), np.where(np.arange(320) == 5, 9, 4)
    df = spark.createDataFrame([(Vectors.dense(v), int(a), int(b), 1) for v, a, b in zip(x, own, lone)], ["pca", "a", "b", "c"])
    got = X.mean_silhouettes(df, "pca", ["a", "b", "c"])
    assert np.allclose(got, [plain_silhouette(x, own), plain_silhouette(x, lone), 0.0], atol=1e-9)
    assert abs(M.silhouette(df, "pca", "a") - got[0]) < 1e-12
    assert -1 <= M.silhouette(df, "pca", "a", sample=50) <= 1


def test_query_finds_several_clusters(spark):
    rows = load().QUERIES["cluster_assign"](spark, SF).collect()
    assert len({r["cluster"] for r in rows}) == 4 and np.median([r["cluster_confidence"] for r in rows]) > 0.9
