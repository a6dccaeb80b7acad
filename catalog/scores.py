"""Queries for cluster scores, training sets, metrics and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rounded, tidy
from catalog.scalars import AREA_SQL
from catalog.sqlkit import (CTES, avgs, cluster_label_sql, condition_sql, coverage_sql, cx, cy, diversity_text, hashed,
                            notable_text, num, pmod, r6, rcols, scale, score_text, sql, trend_text)
from marshline import constants as K
from marshline.functions import features as E
from marshline.grid import with_centers
from marshline.operators import aoi as A, archetypes as M, scoring as S, sightings as B, training as L
from marshline.plans import areas, habitat as H
from marshline.session import stage

_I = K.INDICES
_TRENDS = [f"{c}_trend" for c in K.TREND_INDICES]
_ROW = ["ix", "iy", "dekad"]


def profiles(spark, d, orders=()):
    return stage(X.profiles(spark, d, orders), "profiles")


def mi(spark, d):
    return stage(X.model_input(spark, d), "model_input")


def results(spark, d):
    return H.habitat_results(X.profiles(spark, d))


# --- cluster scores --------------------------------------------------------------
@query("minmax_scale", sql(f"""SELECT ix, iy, {r6(scale('"NDVI"', '(SELECT min("NDVI") FROM latest)', '(SELECT max("NDVI") FROM latest)'),
    'scaled')} FROM latest""", "latest"))
def minmax(spark, d):
    return tidy(S.minmax_scale(X.latest_sat(spark, d), "NDVI", "scaled"), ["ix", "iy"], ["scaled"])


@query("trend_composite", sql(f"SELECT ix, iy, {rcols(['trend_composite'], 9)} FROM comp", "comp"))
def composite(spark, d):
    return tidy(S.trend_composite(X.profiles(spark, d)), ["ix", "iy"], ["trend_composite"], 9)


@query("trajectory", sql("SELECT ix, iy, trajectory FROM traj", "traj"))
def trajectory(spark, d):
    return S.trajectory(S.trend_composite(profiles(spark, d))).select("ix", "iy", "trajectory")


_CBS = ["median_species", "median_diversity", "median_observations"]


@query("cluster_bird_scores", sql(f"SELECT cluster, cells_with_data, total_cells, {rcols(_CBS)} FROM cbs", "cbs"))
def bird_scores(spark, d):
    return tidy(S.cluster_bird_scores(profiles(spark, d)), ["cluster", "cells_with_data", "total_cells"], _CBS)


@query("habitat_suitability", sql(f"SELECT cluster, {rcols(['habitat_suitability'])} FROM suit", "suit"))
def suitability(spark, d):
    return tidy(S.habitat_suitability(S.cluster_bird_scores(profiles(spark, d))), ["cluster"], ["habitat_suitability"])


@query("map_cluster_scores", sql(f"SELECT ix, iy, prof.cluster, {rcols(['habitat_suitability'])} FROM prof JOIN suit USING (cluster)",
                                 "prof", "suit"))
def mapped(spark, d):
    p = profiles(spark, d)
    out = S.map_cluster_scores(p, S.habitat_suitability(S.cluster_bird_scores(p)))
    return tidy(out, ["ix", "iy", "cluster"], ["habitat_suitability"])


@query("conservation_priority", sql(f"""SELECT ix, iy, cluster, trajectory, {rcols(['habitat_suitability', 'trend_score',
    'conservation_priority'])} FROM res""", "res"))
def priority(spark, d):
    return tidy(results(spark, d), ["ix", "iy", "cluster", "trajectory"],
                ["habitat_suitability", "trend_score", "conservation_priority"])


_CF = ["NDVI_mean", "flood_frequency", *_TRENDS]


@query("cluster_profiles", sql(f"""SELECT cluster, n_cells, {rcols(_CF)}, cells_with_data AS bird_cells_with_data,
    {', '.join(r6(c, 'bird_' + c) for c in _CBS)}, {cluster_label_sql('flood_frequency', '"NDVI_mean"', '"NDVI_trend"')} AS archetype_label
    FROM (SELECT cluster, count(*) AS n_cells, {avgs(_CF)} FROM prof GROUP BY cluster) JOIN cbs USING (cluster)""", "prof", "cbs"))
def cluster_table(spark, d):
    p = profiles(spark, d)
    out = S.cluster_profiles(p, _CF, S.cluster_bird_scores(p))
    return tidy(out, ["cluster", "n_cells", "bird_cells_with_data", "archetype_label"], [*_CF, *[f"bird_{c}" for c in _CBS]])


_PS = ["mean", "std", "min", "max", "p25", "p75"]
_CP = "conservation_priority"


@query("priority_stats", sql(f"""SELECT {r6(f'avg({_CP})', 'mean')}, {r6(f'stddev_samp({_CP})', 'std')}, {r6(f'min({_CP})', 'min')},
    {r6(f'max({_CP})', 'max')}, {r6(f'quantile_cont({_CP}, 0.25)', 'p25')}, {r6(f'quantile_cont({_CP}, 0.75)', 'p75')} FROM res""", "res"))
def stats(spark, d):
    return tidy(S.priority_stats(stage(results(spark, d), "results")), [], _PS)


@query("trajectory_distribution", sql(f"""SELECT trajectory, count(*) AS n_cells, {r6(f'avg({_CP})', 'mean_priority')},
    {r6('100e0 * count(*) / (SELECT count(*) FROM res)', 'pct')} FROM res GROUP BY trajectory""", "res"))
def distribution(spark, d):
    return tidy(S.trajectory_distribution(stage(results(spark, d), "results")), ["trajectory", "n_cells"], ["mean_priority", "pct"])


@query("common_clusters", sql(f"SELECT cluster, {rcols(['habitat_suitability', 'median_diversity'])} FROM suit JOIN cbs USING (cluster) "
                              "WHERE median_diversity IS NOT NULL", "suit", "cbs"))
def common(spark, d):
    b = stage(S.cluster_bird_scores(profiles(spark, d)), "bird_scores")
    out = S.common_clusters(S.habitat_suitability(b), b.where("median_diversity IS NOT NULL"))
    return tidy(out, ["cluster"], ["habitat_suitability", "median_diversity"])


@query("suitability_diversity_corr", sql(f"""SELECT {r6('CASE WHEN count(*) > 2 THEN corr(habitat_suitability, median_diversity) END',
    'suitability_diversity_correlation')} FROM suit JOIN cbs USING (cluster) WHERE median_diversity IS NOT NULL""", "suit", "cbs"))
def correlation(spark, d):
    b = stage(S.cluster_bird_scores(profiles(spark, d)), "bird_scores")
    return tidy(S.suitability_diversity_corr(S.habitat_suitability(b), b), [], ["suitability_diversity_correlation"])


_SEARCH = "SELECT cluster + 4 AS k, sum(\"NDVI_mean\") * 1000 AS bic, avg(flood_frequency) AS silhouette FROM prof GROUP BY cluster"


def _unit(c):
    lo, hi = f"(SELECT min({c}) FROM search)", f"(SELECT max({c}) FROM search)"
    return f"({c} - {lo}) / ({hi} - {lo} + 1e-10)"


CTES["search"] = (_SEARCH, ["prof"])


@query("best_k", sql(f"""SELECT k, {rcols(['bic', 'silhouette', 'combined_score'])} FROM (SELECT *,
    (1 - {_unit('bic')}) * 0.5e0 + {_unit('silhouette')} * 0.5e0 AS combined_score FROM search) ORDER BY combined_score DESC, k LIMIT 1""",
                     "search").replace("SELECT k, round", "SELECT CAST(k AS INTEGER) AS k, round"))
def pick_k(spark, d):
    search = stage(X.profiles(spark, d).groupBy((F.col("cluster") + 4).alias("k")).agg(
        (F.sum("NDVI_mean") * 1000).alias("bic"), F.avg("flood_frequency").alias("silhouette")), "search")
    return tidy(S.best_k(search), ["k"], ["bic", "silhouette", "combined_score"])


@query("top_priority_cells", sql(f"SELECT ix, iy, trajectory, {rcols([_CP])} FROM (SELECT * FROM res ORDER BY {_CP} DESC, ix, iy LIMIT 10)", "res"))
def top_priority(spark, d):
    return tidy(S.top_priority_cells(stage(results(spark, d), "results")), ["ix", "iy", "trajectory"], [_CP])


_Z = ["NDVI_mean", "flood_frequency", "NDVI_trend", "NDWI_trend"]


@query("standardize", sql("SELECT ix, iy, " + ", ".join(r6(
    f'("{c}" - avg("{c}") OVER ()) / (CASE WHEN stddev_pop("{c}") OVER () > 0 THEN stddev_pop("{c}") OVER () ELSE 1 END)', c) for c in _Z)
    + " FROM prof", "prof"))
def zscores(spark, d):
    return tidy(M.standardize(profiles(spark, d), _Z), ["ix", "iy"], _Z)


@query("calinski_harabasz", sql(f"""SELECT {r6('b * (n - k) / (w * (k - 1))', 'calinski_harabasz')} FROM (
    SELECT count(*) AS k, sum(nk) AS n, sum(nk * v) AS w, {' + '.join(
        f'sum(nk * (m{i} - (SELECT avg("{c}") FROM prof)) ** 2)' for i, c in enumerate(_Z))} AS b FROM (
    SELECT cluster, count(*) AS nk, {', '.join(f'avg("{c}") AS m{i}' for i, c in enumerate(_Z))},
    {' + '.join(f'var_pop("{c}")' for c in _Z)} AS v FROM prof GROUP BY cluster))""", "prof"))
def dispersion(spark, d):
    return tidy(M.calinski_harabasz(profiles(spark, d), _Z), [], ["calinski_harabasz"])


# --- training sets and metrics -----------------------------------------------------
@query("cell_label_stats", sql("SELECT ix, iy, n_dekads, CAST(total_obs AS BIGINT) AS total_obs, n_positive FROM cellstat", "cellstat"))
def label_stats(spark, d):
    return L.cell_label_stats(X.model_input(spark, d))


@query("negatives_from_birded_cells", sql("""SELECT ix, iy, dekad FROM mi JOIN cellstat USING (ix, iy)
    WHERE n_observations = 0 AND n_positive > 0""", "mi", "cellstat"))
def birded(spark, d):
    return L.negatives_from_birded_cells(mi(spark, d)).select(*_ROW)


@query("negatives_from_empty_cells", sql("""SELECT ix, iy, dekad FROM mi JOIN cellstat USING (ix, iy)
    WHERE n_observations = 0 AND total_obs = 0 AND n_dekads >= 10""", "mi", "cellstat"))
def empty(spark, d):
    return L.negatives_from_empty_cells(mi(spark, d)).select(*_ROW)


@query("distinct_negatives", sql("SELECT ix, iy, dekad FROM negs", "negs"))
def distinct(spark, d):
    m = mi(spark, d)
    both = L.negatives_from_birded_cells(m).unionByName(L.negatives_from_empty_cells(m)).unionByName(L.negatives_from_birded_cells(m))
    return L.distinct_negatives(both).select(*_ROW)


_H = hashed(42, "ix", "iy", "dekad")
CTES["npos"] = ("SELECT count(*) AS n FROM mi WHERE n_observations > 0", ["mi"])
CTES["negsample"] = (f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_H}) AS rn FROM negs)
    WHERE rn <= (SELECT n * 2 FROM npos)""", ["negs", "npos"])
CTES["tset"] = ("SELECT * EXCLUDE (rn), 0 AS label FROM negsample UNION ALL SELECT *, 1 AS label FROM mi WHERE n_observations > 0",
                ["negsample", "mi"])


@query("sample_negatives", sql("SELECT ix, iy, dekad FROM negsample", "negsample"))
def negatives(spark, d):
    m = mi(spark, d)
    return L.sample_negatives(L.reliable_negatives(m), m.where(L.has_birds())).select(*_ROW)


@query("union_labelled", sql("""SELECT label, count(*) AS n_rows, CAST(sum(n_observations) AS BIGINT) AS n_birds FROM (
    SELECT 1 AS label, n_observations FROM mi WHERE n_observations > 0 UNION ALL SELECT 0, n_observations FROM negs) GROUP BY label""",
                             "mi", "negs"))
def labelled(spark, d):
    m = mi(spark, d)
    return L.union_labelled(m.where(L.has_birds()), L.reliable_negatives(m)).groupBy("label").agg(
        F.count("*").alias("n_rows"), F.sum("n_observations").alias("n_birds"))


@query("build_training_set", sql(f"SELECT ix, iy, dekad, label, {rcols(['NDVI', 'EVI'])} FROM tset", "tset"))
def training_set(spark, d):
    return tidy(L.build_training_set(mi(spark, d)), [*_ROW, "label"], ["NDVI", "EVI"])


@query("training_features", sql("SELECT ix, iy, dekad, label, " + ", ".join(
    [r6(f'coalesce("{c}", 0e0)', c) for c in _I]
    + [r6(f'coalesce("{a}" * "{b}", 0e0)', n) for n, (a, b) in K.INTERACTIONS.items()]
    + [r6(f'coalesce("{a}" / (abs("{b}") + 0.01e0), 0e0)', n) for n, (a, b) in K.RATIOS.items()]
    + [r6(f'coalesce("{a}" * "{a}", 0e0)', n) for n, a in K.SQUARES.items()]
    + [r6("sin(2 * pi() * month / 12e0)", "month_sin"), r6("cos(2 * pi() * month / 12e0)", "month_cos"),
       rcols(["doy_sin", "doy_cos"])]) + " FROM train", "train"))
def features(spark, d):
    df = X.model_input(spark, d).withColumn("label", L.has_birds().cast("int"))
    return tidy(E.training_features(df, [*_ROW, "label"]), [*_ROW, "label"], K.MODEL_FEATURES)


@query("scoring_features", sql("SELECT ix, iy, " + ", ".join(
    [r6(f'coalesce("{c}", 0e0)', c) for c in _I]
    + [r6(f'coalesce("{a}" * "{b}", 0e0)', n) for n, (a, b) in K.INTERACTIONS.items()]
    + [r6("sin(2 * pi() * 6 / 12e0)", "month_sin"), r6("sin(2 * pi() * 181 / 365e0)", "doy_sin"),
       r6("cos(2 * pi() * 181 / 365e0)", "doy_cos")]) + " FROM latest", "latest"))
def score_features(spark, d):
    out = E.scoring_features(X.latest_sat(spark, d), X.NOW, ["ix", "iy"])
    return tidy(out, ["ix", "iy"], [*_I, *K.INTERACTIONS, "month_sin", "doy_sin", "doy_cos"])


@query("sample_cells", sql(f"""SELECT ix, iy, count(*) AS n_rows FROM mi JOIN (SELECT ix, iy FROM (SELECT DISTINCT ix, iy FROM mi)
    ORDER BY {hashed(42, 'ix', 'iy')} LIMIT 50) USING (ix, iy) GROUP BY ix, iy""", "mi"))
def sampled_cells(spark, d):
    return L.sample_cells(mi(spark, d), 50).groupBy("ix", "iy").agg(F.count("*").alias("n_rows"))


@query("subsample", sql(f"SELECT ix, iy, dekad FROM mi ORDER BY {_H} LIMIT 10000", "mi"))
def subsample(spark, d):
    return L.subsample(mi(spark, d), 10_000, _ROW).select(*_ROW)


@query("stratified_split", sql(f"""SELECT ix, iy, dekad, label, rn <= CAST(round(total * 0.2e0) AS BIGINT) AS is_test FROM (
    SELECT ix, iy, dekad, label, row_number() OVER (PARTITION BY label ORDER BY {_H}) AS rn,
    count(*) OVER (PARTITION BY label) AS total FROM train)""", "train"))
def split(spark, d):
    df = mi(spark, d).withColumn("label", L.has_birds().cast("int"))
    return L.stratified_split(df).select(*_ROW, "label", "is_test")


@query("kfold", sql(f"SELECT fold, label, count(*) AS n_rows FROM (SELECT CAST((row_number() OVER (PARTITION BY label ORDER BY {_H}) - 1) % 5 AS INTEGER) AS fold, label FROM train) "
                    "GROUP BY fold, label", "train"))
def folds(spark, d):
    df = X.model_input(spark, d).withColumn("label", L.has_birds().cast("int"))
    return L.kfold(df).groupBy("fold", "label").agg(F.count("*").alias("n_rows"))


_T = ["bird_present_mean", "bird_present_median", "bird_present_p25", "bird_present_p75", "bird_absent_mean", "bird_absent_median",
      "difference"]


def _threshold(c):
    y, n = f"\"{c}\") FILTER (WHERE label = 1)", f"\"{c}\") FILTER (WHERE label = 0)"
    q = [f'quantile_cont("{c}", {p}) FILTER (WHERE label = 1)' for p in (0.5, 0.25, 0.75)]
    exprs = [f"avg({y}", q[0], q[1], q[2], f"avg({n}", f'quantile_cont("{c}", 0.5) FILTER (WHERE label = 0)', f"avg({y} - avg({n}"]
    return f"SELECT '{c}' AS feature, " + ", ".join(r6(e, t) for e, t in zip(exprs, _T)) + " FROM train"


@query("feature_thresholds", sql(" UNION ALL ".join(_threshold(c) for c in _I), "train"))
def thresholds(spark, d):
    df = mi(spark, d).withColumn("label", L.has_birds().cast("int"))
    return tidy(L.feature_thresholds(df), ["feature"], _T)


_P = f"({pmod('ix * 37 + iy * 11 + day_of_year * 7', 1001)}) / 1000e0"
CTES["pred"] = (f"SELECT *, {_P} AS probability FROM train", ["train"])


def predicted(spark, d):
    """Labelled rows with a stand-in probability that includes 0 and 1."""
    p = F.pmod(F.col("ix") * 37 + F.col("iy") * 11 + F.col("day_of_year") * 7, F.lit(1001)) / F.lit(1000.0)
    return mi(spark, d).withColumns({"label": L.has_birds().cast("int"), "probability": p})


_BAND = "CASE " + " ".join(f"WHEN probability >= {num(lo)} THEN '{n}'" for n, lo, _ in K.PROBABILITY_BANDS) + " END"


@query("archetype_profiles", sql(f"""SELECT {_BAND} AS band, count(*) AS n_samples, count(*) FILTER (WHERE n_observations > 0) AS n_with_birds,
    round_even(coalesce(avg(n_species) FILTER (WHERE n_species > 0), 0e0), 1) AS avg_species_when_present, {', '.join(
        r6(f'avg("{c}")', f'{c}_mean') + ', ' + r6(f'stddev_samp("{c}")', f'{c}_std') for c in _I)} FROM pred GROUP BY 1""", "pred"))
def band_profiles(spark, d):
    out = L.archetype_profiles(predicted(spark, d))
    return tidy(out, ["band", "n_samples", "n_with_birds", "avg_species_when_present"],
                [f"{c}_{s}" for c in _I for s in ("mean", "std")])


CTES["curve"] = ("""SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
    SELECT probability, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY probability)
    WINDOW w AS (ORDER BY probability DESC)""", ["pred"])
_AP = "sum(CAST(pos AS DOUBLE) / p * tp / (tp + fp))"
_AUC = "sum(CAST(pos AS DOUBLE) * (n - fp + neg / 2e0)) / max(CAST(p AS DOUBLE) * n)"


@query("average_precision", sql(f"SELECT {r6(_AP, 'average_precision')} FROM curve", "curve"))
def ap(spark, d):
    return tidy(L.average_precision(predicted(spark, d), "probability"), [], ["average_precision"])


_CM = ["roc_auc", "average_precision", "accuracy", "absent_precision", "absent_recall", "absent_f1", "present_precision",
       "present_recall", "present_f1"]


@query("classifier_metrics", sql(f"""SELECT (SELECT {r6(_AUC)} FROM curve) AS roc_auc, (SELECT {r6(_AP)} FROM curve) AS average_precision,
    {r6('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {r6('tn / (tn + fn)', 'absent_precision')}, {r6('tn / (tn + fp)', 'absent_recall')},
    {r6('2 * tn / (2 * tn + fn + fp)', 'absent_f1')}, tn + fp AS absent_support, {r6('tp / (tp + fp)', 'present_precision')},
    {r6('tp / (tp + fn)', 'present_recall')}, {r6('2 * tp / (2 * tp + fp + fn)', 'present_f1')}, tp + fn AS present_support FROM (
    SELECT count(*) FILTER (WHERE probability > 0.5e0 AND label = 1) AS tp, count(*) FILTER (WHERE probability > 0.5e0 AND label = 0) AS fp,
    count(*) FILTER (WHERE probability <= 0.5e0 AND label = 1) AS fn, count(*) FILTER (WHERE probability <= 0.5e0 AND label = 0) AS tn
    FROM pred)""", "pred", "curve"))
def metrics(spark, d):
    return tidy(L.classifier_metrics(predicted(spark, d), "probability"), ["absent_support", "present_support"], _CM)


@query("regressor_metrics", sql(f"""SELECT {r6('avg(abs(probability - shannon_diversity))', 'mae')},
    {r6('1 - sum((probability - shannon_diversity) ** 2) / (var_pop(shannon_diversity) * count(*))', 'r2')} FROM pred WHERE label = 1""", "pred"))
def errors(spark, d):
    return tidy(L.regressor_metrics(predicted(spark, d).where("label = 1"), "probability", "shannon_diversity"), [], ["mae", "r2"])


# --- areas -----------------------------------------------------------------------------
def matched(spark, d):
    """Scored cells with their profile columns inside each area."""
    return A.spatial_join(with_centers(results(spark, d), X.GRID), X.aois(spark, d), X.GRID)


def matched_profiles(spark, d, orders=()):
    return A.spatial_join(with_centers(X.profiles(spark, d, orders), X.GRID), X.aois(spark, d), X.GRID)


@query("spatial_join", sql("""SELECT aoi_id, CAST(sum(n) AS BIGINT) AS n_pixels, count(DISTINCT site) AS n_sites FROM (
    SELECT aoi_id, lon, lat, site, n FROM (SELECT lon, lat, site, count(*) AS n FROM pix GROUP BY ALL)
    JOIN aoi_b ON lon BETWEEN west AND east AND lat BETWEEN south AND north JOIN aoi_e USING (aoi_id)
    GROUP BY aoi_id, lon, lat, site, n HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat)
    AND lon < (x2 - x1) * (lat - y1) / (CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END) + x1) % 2 = 1) GROUP BY aoi_id""",
    "pix", "aoi_b", "aoi_e"))
def pixel_areas(spark, d):
    points = X.pixels(spark, d).select("site", "lon", "lat")
    return A.point_counts(points, X.aois(spark, d), X.GRID, "site").withColumnRenamed("n_points", "n_pixels")


@query("aoi_profile_join", sql(f"SELECT aoi_id, ix, iy, trajectory, {rcols(['NDVI_mean', 'n_observations_sum'])} FROM aoires", "aoires"))
def profile_join(spark, d):
    p = profiles(spark, d)
    found = A.spatial_join(with_centers(H.habitat_results(p), X.GRID), X.aois(spark, d), X.GRID)
    return tidy(A.aoi_profile_join(found, p.select("ix", "iy", "NDVI_mean", "n_observations_sum")), ["aoi_id", "ix", "iy", "trajectory"],
                ["NDVI_mean", "n_observations_sum"])


CTES["aoiprof"] = ("SELECT aoi_id, prof.* FROM hits JOIN prof USING (ix, iy)", ["hits", "prof"])
_TOT = "CAST(sum(n_observations_sum) AS BIGINT) AS total_sightings, CAST(max(n_species_max) AS BIGINT) AS species_count"


@query("aoi_totals", sql(f"SELECT aoi_id, {_TOT} FROM aoiprof GROUP BY aoi_id", "aoiprof"))
def totals(spark, d):
    return A.aoi_totals(matched_profiles(spark, d))


CTES["aoiorder"] = ("""SELECT aoi_id, "order", count(*) AS n, row_number() OVER (PARTITION BY aoi_id ORDER BY count(*) DESC, "order") AS rank
    FROM hits JOIN (SELECT obs.* FROM obs JOIN mi USING (ix, iy, dekad)) USING (ix, iy) JOIN toporder USING ("order")
    GROUP BY aoi_id, "order\"""", ["hits", "obs", "mi", "toporder"])


@query("aoi_top_orders", sql('SELECT aoi_id, CAST(rank AS INTEGER) AS rank, "order", n AS "count" FROM aoiorder WHERE rank <= 5', "aoiorder"))
def best_orders(spark, d):
    names = B.top_order_names(X.observations(spark, d))
    return A.aoi_top_orders(matched_profiles(spark, d, names))


CTES["aoicond"] = ("""SELECT aoi_id, trajectory AS condition, 100e0 * n / total AS condition_pct FROM (SELECT aoi_id, trajectory, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY aoi_id) AS total, row_number() OVER (PARTITION BY aoi_id ORDER BY count(*) DESC, trajectory) AS rn
    FROM aoires GROUP BY aoi_id, trajectory) WHERE rn = 1""", ["aoires"])


@query("aoi_condition", sql(f"SELECT aoi_id, condition, {rcols(['condition_pct'])}, {condition_sql('condition', 'condition_pct')} AS condition_detail "
                            "FROM aoicond", "aoicond"))
def condition(spark, d):
    return tidy(A.aoi_condition(matched(spark, d)), ["aoi_id", "condition", "condition_detail"], ["condition_pct"])


CTES["aoitrend"] = (f"SELECT aoi_id, {avgs(_TRENDS)} FROM aoiprof GROUP BY aoi_id", ["aoiprof"])
_VT, _WT = trend_text('"NDVI_trend"', "Vegetation"), trend_text('"NDWI_trend"', "Water presence")


@query("aoi_trends", sql(f"SELECT aoi_id, {_VT} AS vegetation_trend, {_WT} AS water_trend FROM aoitrend", "aoitrend"))
def trends(spark, d):
    return A.aoi_trends(matched_profiles(spark, d))


CTES["aoinote"] = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY abs(v) DESC, name) AS rn FROM ("
                   + " UNION ALL ".join(f"SELECT aoi_id, '{c}' AS name, \"{c}\" AS v FROM aoitrend" for c in _TRENDS)
                   + ") WHERE v IS NOT NULL) WHERE rn = 1", ["aoitrend"])


@query("aoi_notable_change", sql(f"SELECT aoi_id, {notable_text('name', 'v')} AS notable_change FROM aoinote", "aoinote"))
def notable(spark, d):
    return A.aoi_notable_change(matched_profiles(spark, d))


CTES["aoidiv"] = ("SELECT aoi_id, avg(shannon_diversity_mean) FILTER (WHERE shannon_diversity_mean > 0) AS h, "
                  "100e0 * avg(has_bird_data) AS covered FROM aoiprof GROUP BY aoi_id", ["aoiprof"])


@query("aoi_diversity", sql(f"SELECT aoi_id, {r6('h', 'mean_shannon')}, {diversity_text('h')} AS diversity_level FROM aoidiv", "aoidiv"))
def diversity(spark, d):
    return tidy(A.aoi_diversity(matched_profiles(spark, d)), ["aoi_id", "diversity_level"], ["mean_shannon"])


@query("aoi_coverage", sql(f"SELECT aoi_id, {r6('covered', 'covered_pct')}, {coverage_sql('covered')} AS data_coverage FROM aoidiv", "aoidiv"))
def coverage(spark, d):
    return tidy(A.aoi_coverage(matched_profiles(spark, d)), ["aoi_id", "data_coverage"], ["covered_pct"])


CTES["aoiarea"] = (AREA_SQL, ["aoi_v"])
CTES["aoitop"] = ("""SELECT aoi_id, string_agg("order" || ':' || n, '|' ORDER BY rank) AS top_species FROM aoiorder WHERE rank <= 5
    GROUP BY aoi_id""", ["aoiorder"])


@query("analyze_aoi", sql(f"""SELECT aoi_id, total_sightings, species_count, coalesce(top_species, '') AS top_species, condition,
    {condition_sql('condition', 'condition_pct')} AS condition_detail, {_VT} AS vegetation_trend, {_WT} AS water_trend,
    {notable_text('name', 'v')} AS notable_change, {diversity_text('h')} AS diversity_level, {coverage_sql('covered')} AS data_coverage, area_km2
    FROM (SELECT aoi_id, {_TOT} FROM aoiprof GROUP BY aoi_id) JOIN aoicond USING (aoi_id) JOIN aoitrend USING (aoi_id)
    JOIN aoinote USING (aoi_id) JOIN aoidiv USING (aoi_id) JOIN aoiarea USING (aoi_id) LEFT JOIN aoitop USING (aoi_id)""",
                          "aoiprof", "aoicond", "aoitrend", "aoinote", "aoidiv", "aoiarea", "aoitop"))
def analyze(spark, d):
    p = profiles(spark, d, B.top_order_names(X.observations(spark, d)))
    out = areas.analyze_aoi(H.habitat_results(p), p, X.aois(spark, d), X.GRID)
    return out.withColumn("top_species", F.array_join(F.transform(
        "top_species", lambda s: F.concat(s["order"], F.lit(":"), s["count"].cast("string"))), "|"))


_SC = {"ow": K.OPEN_WATER, "hi": "Highly suitable", "mo": "Moderately suitable", "ma": "Marginal", "un": "Unsuitable"}
CTES["aoisum"] = ("SELECT aoi_id, count(*) AS n_cells, avg(suitability_probability) AS mp, max(suitability_probability) AS xp, " + ", ".join(
    f"count(*) FILTER (WHERE archetype = '{v}') AS {k}" for k, v in _SC.items()) + " FROM aoiscored GROUP BY aoi_id", ["aoiscored"])
CTES["aoibest"] = ("""SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY suitability_probability DESC, ix, iy) AS rank
    FROM aoiscored""", ["aoiscored"])


def aoi_scored(spark, d):
    return A.spatial_join(X.scored_cells(spark, d), X.aois(spark, d), X.GRID)


@query("top_cells", sql("SELECT aoi_id, CAST(rank AS INTEGER) AS rank, ix, iy, archetype, suitability_probability FROM aoibest WHERE rank <= 5", "aoibest"))
def best_cells(spark, d):
    return A.top_cells(aoi_scored(spark, d)).select("aoi_id", "rank", "ix", "iy", "archetype", "suitability_probability")


_BREAK = " || ".join(f"CASE WHEN {k} > 0 THEN '{v}=' || {k} || ';' ELSE '' END" for k, v in _SC.items())


@query("score_summary", sql(f"""SELECT aoi_id, n_cells, round_even(mp * 100, 1) AS mean_suitability, round_even(xp * 100, 1) AS max_suitability,
    {score_text('(100e0 * hi / n_cells)', '(100e0 * mo / n_cells)', '(100e0 * un / n_cells)', 'mp')} AS summary, {_BREAK} AS breakdown,
    best.cells AS best_cells FROM aoisum JOIN (SELECT aoi_id, string_agg(archetype, '|' ORDER BY rank) AS cells FROM aoibest WHERE rank <= 5
    GROUP BY aoi_id) best USING (aoi_id)""", "aoisum", "aoibest"))
def summary(spark, d):
    out = A.score_summary(aoi_scored(spark, d))
    parts = [F.coalesce(F.concat(F.lit(f"{v}="), F.try_element_at("archetype_breakdown", F.lit(v))["count"].cast("string"), F.lit(";")),
                        F.lit("")) for v in _SC.values()]
    return out.select("aoi_id", "n_cells", "mean_suitability", "max_suitability", "summary", F.concat(*parts).alias("breakdown"),
                      F.array_join(F.transform("top_cells", lambda c: c["archetype"]), "|").alias("best_cells"))


@query("cells_to_geojson", sql(f"""SELECT ix, iy, 'Feature' AS kind, archetype, suitability_pct AS suitability,
    {r6(f'{cx()} - {num(X.GRID.cell_lon / 2)}', 'west')}, {r6(f'{cy()} + {num(X.GRID.cell_lat / 2)}', 'north')} FROM scored""", "scored"))
def geojson(spark, d):
    f = F.col("feature")

    def at(path):
        return F.get_json_object(f, path)

    return A.cells_to_geojson(X.scored_cells(spark, d), X.GRID, ["ix", "iy"]).select(
        "ix", "iy", at("$.type").alias("kind"), at("$.properties.archetype").alias("archetype"),
        at("$.properties.suitability").cast("double").alias("suitability"),
        rounded(at("$.geometry.coordinates[0][0][0]").cast("double")).alias("west"),
        rounded(at("$.geometry.coordinates[0][2][1]").cast("double")).alias("north"))
