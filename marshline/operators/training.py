"""Labelled sets, splits, samples, thresholds and model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marshline import constants as K
from marshline.functions.labels import probability_band
from marshline.operators.pixels import drop_missing_all
from marshline.operators.selection import exact_percentiles, hash_bucket, hash_take, hash_text, running_totals

CELL = ["ix", "iy"]
ROW = ["ix", "iy", "dekad"]
# Hash buckets whose rows are ranked one by one when folds are dealt.
FOLD_BUCKETS = 4096


def has_birds() -> Column:
    return F.coalesce(F.col("n_observations") > 0, F.lit(False))


def cell_label_stats(df: DataFrame) -> DataFrame:
    """Dekads, total sightings and birded dekads per cell."""
    return df.groupBy(*CELL).agg(
        F.count("*").alias("n_dekads"), F.sum("n_observations").alias("total_obs"),
        F.count(F.when(has_birds(), 1)).alias("n_positive"))


def negatives_from_birded_cells(df: DataFrame) -> DataFrame:
    """Quiet rows of cells that have birds at some other time."""
    birded = df.where(has_birds()).select(*CELL).distinct()
    return df.where(~has_birds()).join(birded, CELL, "left_semi")


def negatives_from_empty_cells(df: DataFrame, min_dekads: int = K.MIN_DEKADS_FOR_NEGATIVE) -> DataFrame:
    """Rows of well-observed cells that never had a sighting."""
    empty = cell_label_stats(df).where((F.col("total_obs") == 0) & (F.col("n_dekads") >= min_dekads))
    return df.where(~has_birds()).join(empty, CELL, "left_semi")


def distinct_negatives(df: DataFrame, keys: list[str] = ROW) -> DataFrame:
    return df.dropDuplicates(list(keys))


def reliable_negatives(df: DataFrame, min_dekads: int = K.MIN_DEKADS_FOR_NEGATIVE) -> DataFrame:
    """Both kinds of negatives from one pass of cell statistics and one join."""
    ok = (F.col("n_positive") > 0) | ((F.col("total_obs") == 0) & (F.col("n_dekads") >= min_dekads))
    cells = cell_label_stats(df).where(ok)
    return distinct_negatives(df.where(~has_birds()).join(cells, CELL, "left_semi"))


def sample_negatives(negatives: DataFrame, positives: DataFrame, ratio: float = K.NEGATIVE_RATIO,
                     seed: int = 42, ids: list[str] = ROW) -> DataFrame:
    """Exactly ``int(positives * ratio)`` rows, or all when there are fewer."""
    want = F.floor(positives.agg(F.count("*")).scalar() * F.lit(float(ratio)))
    return hash_take(negatives, ids, want, seed=seed).where("taken").drop("taken")


def union_labelled(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    return positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))


def build_training_set(df: DataFrame, ratio: float = K.NEGATIVE_RATIO, seed: int = 42,
                       min_dekads: int = K.MIN_DEKADS_FOR_NEGATIVE) -> DataFrame:
    """Every row with birds plus sampled reliable negatives, labelled 1 and 0."""
    valid = drop_missing_all(df, [c for c in K.INDICES if c in df.columns])
    positives = valid.where(has_birds())
    negatives = sample_negatives(reliable_negatives(valid, min_dekads), positives, ratio, seed)
    return union_labelled(positives, negatives)


def sample_cells(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All rows of exactly ``n`` cells (or of every cell when there are fewer)."""
    cells = df.select(*CELL).distinct()
    picked = hash_take(cells, CELL, F.lit(n), seed=seed).where("taken").select(*CELL)
    return df.join(picked, CELL, "left_semi")


def subsample(df: DataFrame, n: int = 10_000, ids: list[str] = CELL, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all)."""
    return hash_take(df, list(ids), F.lit(n), seed=seed).where("taken").drop("taken")


def stratified_split(df: DataFrame, test: float = 0.2, label: str = "label", ids: list[str] = ROW,
                     seed: int = 42) -> DataFrame:
    """Flag ``is_test``: the same share of each label, exact to one row."""
    want = F.round(F.col("total") * F.lit(test))
    return hash_take(df, list(ids), want, [label], seed, "is_test")


def kfold(df: DataFrame, k: int = 5, label: str = "label", ids: list[str] = ROW, seed: int = 42) -> DataFrame:
    """Stratified fold number ``0..k-1``: the rows of each label in order of their hash are dealt in turn, so folds differ by one row at most.

    Ranks are counted within hash buckets and shifted by the sizes of the buckets before, so no label is one task.
    """
    placed = df.withColumns({"_h": hash_text(list(ids), seed), "_b": hash_bucket(list(ids), seed, FOLD_BUCKETS)})
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy(label, "_b").agg(F.count("*").alias("_n")).select(
        label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(label, "_b").orderBy("_h", *ids)
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1).join(shift, [label, "_b"])
    return ranked.withColumn("fold", ((F.col("_rank") + F.col("_before")) % k).cast("int")).drop("_h", "_b", "_rank", "_before")


def feature_thresholds(df: DataFrame, features: list[str] = K.INDICES, label: str = "label") -> DataFrame:
    """Spectral ranges with and without birds, one row per feature."""
    flag = df.withColumn("_y", F.col(label).cast("int"))
    means = flag.groupBy("_y").agg(*[F.avg(c).alias(f"{c}_mean") for c in features])
    quart = exact_percentiles(flag, features, [0.25, 0.5, 0.75], ["_y"])
    both = means.join(quart, "_y")
    stats = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_p25").alias("p25"),
                 F.col(f"{c}_p50").alias("p50"), F.col(f"{c}_p75").alias("p75")) for c in features])).alias("s")
    long = both.select("_y", stats).select("_y", "s.*")

    def of(y: int, c: str) -> Column:
        return F.max(F.when(F.col("_y") == y, F.col(c)))

    return long.groupBy("feature").agg(
        of(1, "mean").alias("bird_present_mean"), of(1, "p50").alias("bird_present_median"),
        of(1, "p25").alias("bird_present_p25"), of(1, "p75").alias("bird_present_p75"),
        of(0, "mean").alias("bird_absent_mean"), of(0, "p50").alias("bird_absent_median"),
        (of(1, "mean") - of(0, "mean")).alias("difference"),
    ).where(F.col("difference").isNotNull())


def archetype_profiles(df: DataFrame, prob: str = "probability", features: list[str] = K.INDICES,
                       top_closed: bool = True) -> DataFrame:
    """Per probability band: sizes, species when present, index means and stds."""
    species = F.when(F.col("n_species") > 0, F.col("n_species"))
    stats = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return (df.withColumn("band", probability_band(F.col(prob), top_closed)).where(F.col("band").isNotNull())
            .groupBy("band").agg(
                F.count("*").alias("n_samples"), F.count(F.when(has_birds(), 1)).alias("n_with_birds"),
                F.bround(F.coalesce(F.avg(species), F.lit(0.0)), 1).alias("avg_species_when_present"), *stats))


def _curve(df: DataFrame, score: str, label: str) -> DataFrame:
    marked = df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("pos"),
                       (1 - F.col(label)).cast("long").alias("neg"))
    return running_totals(marked, "score", ["pos", "neg"])


def ranking_metrics(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC and average precision from one distributed score curve."""
    c = F.col
    curve = _curve(df, score, label)
    # P and N are constant; the last running total equals the sum over the curve.
    totals = df.agg(F.struct(F.sum(F.col(label).cast("long")).alias("p"),
                             F.sum((1 - F.col(label)).cast("long")).alias("n")).alias("t")).scalar()
    tp, fp = c("t.p") - c("pos_cum") + c("pos"), c("t.n") - c("neg_cum") + c("neg")
    wins = c("pos") * (c("neg_cum") - c("neg") / 2)
    return curve.withColumn("t", totals).agg(
        F.sum(F.try_divide(wins, c("t.p") * c("t.n").cast("double"))).alias("roc_auc"),
        F.sum(F.try_divide(c("pos"), c("t.p")) * F.try_divide(tp, tp + fp)).alias("average_precision"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Step-wise average precision over descending score."""
    return ranking_metrics(df, score, label).select("average_precision")


def confusion_metrics(df: DataFrame, score: str = "score", label: str = "label",
                      threshold: float = 0.5) -> DataFrame:
    """Accuracy and per-class precision, recall, F1 and support in one row."""
    hit, y = F.col(score) > threshold, F.col(label) == 1
    n = {name: F.count(F.when(cond, 1)).alias(name) for name, cond in {
        "tp": hit & y, "fp": hit & ~y, "fn": ~hit & y, "tn": ~hit & ~y}.items()}
    counts = df.agg(*n.values())
    c = F.col

    def rates(good: str, wrong: str, missed: str, name: str) -> list[Column]:
        zero = F.lit(0.0)
        return [
            F.coalesce(F.try_divide(c(good), c(good) + c(wrong)), zero).alias(f"{name}_precision"),
            F.coalesce(F.try_divide(c(good), c(good) + c(missed)), zero).alias(f"{name}_recall"),
            F.coalesce(F.try_divide(2 * c(good), 2 * c(good) + c(wrong) + c(missed)), zero).alias(f"{name}_f1"),
            (c(good) + c(missed)).alias(f"{name}_support"),
        ]

    return counts.select(
        F.try_divide(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")).alias("accuracy"),
        *rates("tn", "fn", "fp", "absent"), *rates("tp", "fp", "fn", "present"))


def classifier_metrics(df: DataFrame, score: str = "score", label: str = "label",
                       threshold: float = 0.5) -> DataFrame:
    """Ranking and confusion metrics of scored rows in one row."""
    rank = ranking_metrics(df, score, label).select(F.struct("roc_auc", "average_precision")).scalar()
    return confusion_metrics(df, score, label, threshold).withColumn("_r", rank).select("_r.*", "*").drop("_r")


def regressor_metrics(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Mean absolute error and R2 in one row."""
    err = F.col(prediction) - F.col(target)
    return df.agg(F.avg(F.abs(err)).alias("mae"),
                  (1 - F.try_divide(F.sum(err * err), F.var_pop(target) * F.count(target))).alias("r2"))
