"""Boosting and isotonic maps against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marshline.operators import boosting as B, isotonic as I, suitability as U, training as L

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=(n, 6))
    x[:, 4] = np.round(x[:, 4])  # few distinct values
    x[:, 5] = 7.0  # constant
    y = (rng.random(n) < B.sigmoid(2 * x[:, 0] - x[:, 1] * x[:, 4])).astype(int)
    pdf = pd.DataFrame(x, columns=NAMES).assign(label=y, fold=np.arange(n) % 3, target=x[:, 0] ** 2 + x[:, 2])
    pdf.loc[:19, "f3"] = np.nan
    path = spark.createDataFrame(pdf).withColumn("f3", F.when(~F.isnan("f3"), F.col("f3"))).repartition(3)
    return path.cache()


def plain_boost(x, y, ids, fits_seed, fit, loss, trees, depth, step, share, min_leaf, cuts):
    """One fit, recursion by node, candidate splits one by one."""
    bins = B.binned_rows(x, cuts)
    mean = y.mean()
    score = np.full(len(y), np.log(mean / (1 - mean)) if loss == "log" else mean)
    take = int(np.sqrt(x.shape[1]))
    for t in range(trees):
        g, h = B.gradients(y, score, loss)
        inside = B.drawn(ids, t, fits_seed, share)
        change = np.zeros(len(y))

        def leaf(rows):
            w = h[rows & inside].sum()
            change[rows] = g[rows & inside].sum() / w if w > 1e-12 else 0.0

        def grow(rows, level, place):
            if level == depth:
                return leaf(rows)
            best = (1e-12, None)
            for f in B.node_features(fits_seed, fit, t, level, x.shape[1], take)[place]:
                for c in range(B.BINS):
                    left, right = rows & inside & (bins[:, f] <= c), rows & inside & (bins[:, f] > c)
                    n, m = left.sum(), right.sum()
                    if n >= min_leaf and m >= min_leaf:
                        gain = n * m / (n + m) * (g[left].mean() - g[right].mean()) ** 2
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, c))
            if best[1] is None:
                return leaf(rows)
            f, c = best[1]
            grow(rows & (bins[:, f] <= c), level + 1, 2 * place)
            grow(rows & (bins[:, f] > c), level + 1, 2 * place + 1)

        grow(np.ones(len(y), bool), 0, 0)
        score = score + step * change
    return score


@pytest.mark.parametrize("loss,target", [("log", "label"), ("square", "target")])
@pytest.mark.parametrize("local", [0, 1000])
def test_as_a_plain_computation(spark, data, loss, target, local, monkeypatch):
    monkeypatch.setattr(B, "LOCAL_ROWS", local)
    monkeypatch.setattr(B, "TASK_ROWS", 300)
    monkeypatch.setattr(B, "REFRESH", 2)  # scores move into new blocks, and those are checkpointed
    monkeypatch.setattr(B, "CHECKPOINT", 4)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    args = dict(trees=5, depth=3, step=0.3, subsample=0.8, min_leaf=10)
    base, first, *_ = B.boost(data, NAMES, target, loss, **args, fold="fold", folds=3)
    rows = data.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in NAMES], "label", "target", "fold", F.monotonically_increasing_id().alias("id")).toPandas()
    x, y, ids = rows[NAMES].to_numpy(), rows[target].to_numpy(float), rows.id.to_numpy()
    plain = dict(loss=loss, cuts=base.cuts, **{("share" if k == "subsample" else k): v for k, v in args.items()})
    assert np.allclose(base.raw(x), plain_boost(x, y, ids, 42, 0, **plain))
    other = (rows.fold != 0).to_numpy()
    assert np.allclose(first.raw(x[other]), plain_boost(x[other], y[other], ids[other], 42, 1, **plain))
    assert base.importances[5] == 0 and abs(base.importances.sum() - 1) < 1e-12
    again = B.Boosted.from_dict(base.to_dict())
    assert np.array_equal(again.predict(x), base.predict(x))


def rank_auc(score, y):
    order = pd.Series(score).rank().to_numpy()
    p, n = y.sum(), (1 - y).sum()
    return (order[y == 1].sum() - p * (p + 1) / 2) / (p * n)


def test_full_depth_and_auc(spark, data):
    model = U.train_presence_classifier(data, NAMES, trees=40)
    scored = U.presence_probability(data, model, NAMES, "score").toPandas()
    auc = rank_auc(scored.score.to_numpy(), scored.label.to_numpy())
    assert auc > 0.85 and abs(L.classifier_metrics(spark.createDataFrame(scored)).first()["roc_auc"] - auc) < 1e-9
    assert model.trees == 40 and model.feature.shape == (40, 31)


def test_held_out_scores_come_from_the_own_fold(spark, data):
    models = B.boost(data, NAMES, "label", "log", 3, 2, 0.3, 1.0, 5, fold="fold", folds=3, base=False)
    got = U.held_out_scores(data, models, NAMES).toPandas()
    x = got[NAMES].fillna(0.0).to_numpy()
    want = np.choose(got.fold, [m.predict(x) for m in models])
    assert np.allclose(got.score, want)


def test_nothing_to_learn(spark, data):
    empty, = B.boost(data.limit(0), NAMES, "label", "log", 3, 2, 0.3, 1.0, 5)
    assert empty.trees == 0 and len(empty.predict(np.zeros((2, 6)))) == 2
    flat, = B.boost(data.withColumn("label", F.lit(1)), NAMES, "label", "log", 3, 2, 0.3, 1.0, 5)
    assert (flat.predict(np.zeros((1, 6))) > 0.999).all() and (flat.feature == -1).all()


def plain_isotonic(x, y):
    """The least squares fit by its min-max formula, at every distinct score."""
    at = np.unique(x)
    s, w = np.array([y[x == v].sum() for v in at]), np.array([(x == v).sum() for v in at])
    cs, cw = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(w)])
    return at, np.array([max(min((cs[j + 1] - cs[i]) / (cw[j + 1] - cw[i]) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])


@pytest.mark.parametrize("ways", [2, 16])
def test_isotonic_by_merging_ranges(spark, ways):
    rng = np.random.default_rng(8)
    n = 600
    x = np.round(rng.random(n), 3)
    x[:250] = 0.5  # one hot score
    y = (rng.random(n) < x).astype(float)
    group = np.where(np.arange(n) % 7 == 0, 1, 0)
    rows = [(float(a), float(b), int(g)) for a, b, g in zip(x, y, group)] + [(None, 1.0, 0), (0.1, None, 0), (float("nan"), 1.0, 0), (0.2, 1.0, 5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = I.fit_isotonic(spark.createDataFrame(rows, "s double, y double, g int"), "s", "y", "g", ways)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got) == [0, 1, 5] and got[5](np.array([0.0, 9.0])).tolist() == [1.0, 1.0]
    for g in (0, 1):
        at, want = plain_isotonic(x[group == g], y[group == g])
        assert np.allclose(got[g](at), want) and (np.diff(got[g].y) >= 0).all()
        assert got[g](np.array([-1.0])) == want[0] and got[g](np.array([2.0])) == want[-1]
        assert np.array_equal(I.Isotonic.from_dict(got[g].to_dict()).x, got[g].x)
    assert I.fit_isotonic(spark.createDataFrame([], "s double, y double, g int"), "s", "y", "g") == {}


def test_cross_validation_and_calibration(spark, data):
    row = U.cross_validate(data.withColumns({"ix": F.monotonically_increasing_id(), "iy": F.lit(1), "dekad": F.lit("d")}).drop("fold"), NAMES, k=3, trees=10).first()
    assert 0.75 < row["roc_auc_mean"] <= 1 and row["roc_auc_std"] >= 0
    table = data.withColumns({"ix": F.monotonically_increasing_id(), "iy": F.lit(1), "dekad": F.lit("d")}).drop("fold")
    pairs = U.calibrate_isotonic(table, NAMES, k=3, trees=10)
    out = U.calibrated_probability(table, pairs, NAMES, "p").toPandas()
    assert out.p.between(0, 1).all() and abs(out.p.mean() - out.label.mean()) < 0.05


def test_rows_of_a_tree_are_looked_up_once(monkeypatch):
    """All levels of a tree share its rows; every bin of every node still sums up exactly the rows it holds."""
    rng = np.random.default_rng(3)
    n, width, depth, share, seed = 3000, 7, 3, 0.7, 5
    block = B.Block(rng.integers(0, 256, (n, width)).astype(np.uint8), rng.integers(0, 2, n).astype(float), rng.integers(0, 3, n).astype(np.int32),
                    np.arange(n), rng.normal(size=(1, n)))
    calls, draw = [], B.drawn
    monkeypatch.setattr(B, "drawn", lambda *a: calls.append(a[1]) or draw(*a))
    plan, kept = B.Plan(width, "log", 4, depth, 0.1, share, 20, seed), {}

    def histograms(asked, tree, level):
        got = B.level_histograms(block, asked, "log", tree, level, seed, share, kept)
        fit, = asked
        inside = draw(block.ids, tree, seed, share) & (block.fold != 1)
        g, c = B.gradients(block.target, block.scores[0], "log")
        node = B.leaves_of(block.bins, *(x[:(1 << level) - 1] for x in fit["growing"])) if level else np.zeros(n, int)
        for k in range(1 << level):
            rows = np.flatnonzero(inside & (node == k + (1 << level) - 1))
            for j, f in enumerate(fit["drawn"][k]):
                for have, w in zip(got[0][:, k, j], (np.ones(n), g, c)):
                    np.testing.assert_allclose(have, np.bincount(block.bins[rows, f], w[rows], 256), atol=1e-9)
        return got

    def forward(recent, tree):
        block.scores[0] += 0.1 * B.sum_of_trees(block.bins, *(np.array(x) for x in zip(*recent[0])))
        return [[]]

    done, = B.grow(plan, [(0, 1)], histograms, forward)
    assert calls == list(range(4)) and (np.array(done["feature"]) >= 0).any()
