"""Queries for fitted models and streams (checked by rows and properties)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, tidy
from catalog.sqlkit import CTES, avgs, iy, num, r6, rcols, sql
from marshline import constants as K
from marshline.functions import features as E
from marshline.operators import archetypes as M, suitability as U, training as L
from marshline.plans import areas, habitat as H
from marshline.session import new_path, stage
from marshline.streaming import refresh as R


def _profiles(spark, d):
    mi = stage(X.model_input(spark, d), "model_input")
    return stage(H.cell_profiles(mi), "cell_profiles")


def _vectors(spark, d):
    p = _profiles(spark, d)
    scaler = M.fit_scaler(p, M.clustering_features(p.columns))
    return stage(M.scaled_vectors(p, scaler).select("ix", "iy", "scaled"), "vectors")


def _components(spark, d):
    v = _vectors(spark, d)
    pca, n, _ = M.pca_variance(v)
    return stage(M._components(v, pca, n), "components"), n


def _train(spark, d):
    mi = stage(X.model_input(spark, d), "model_input")
    t = L.build_training_set(mi)
    keep = ["ix", "iy", "dekad", "label", "n_observations", "n_species", "shannon_diversity"]
    return stage(E.training_features(t, keep), "train")


def _suitability(spark, d):
    return U.train_suitability(_train(spark, d))


def _archetypes(spark, d):
    p = _profiles(spark, d)
    model, results = M.train_archetypes(p)
    return p, model, results


@query("pca_variance")
def pca(spark, d):
    _, n, shares = M.pca_variance(_vectors(spark, d))
    rows = [(i + 1, s, i < n) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, variance double, kept boolean")


@query("gmm_search")
def gmm(spark, d):
    comps, n = _components(spark, d)
    rows, _ = M.gmm_search(comps, n)
    return spark.createDataFrame(rows, M.SEARCH_SCHEMA)


@query("cluster_assign")
def assign(spark, d):
    comps, n = _components(spark, d)
    _, models = M.gmm_search(comps, n, [K.MIN_CLUSTERS])
    return M.cluster_assign(comps, models[K.MIN_CLUSTERS]).select("ix", "iy", "cluster", "cluster_confidence")


@query("silhouette")
def silhouette(spark, d):
    comps, n = _components(spark, d)
    _, models = M.gmm_search(comps, n, [K.MIN_CLUSTERS])
    value = M.silhouette(M.cluster_assign(comps, models[K.MIN_CLUSTERS]))
    return spark.createDataFrame([("euclidean", float(value))], "distance string, silhouette double")


@query("train_archetypes")
def archetypes(spark, d):
    return _archetypes(spark, d)[2]


@query("score_profiles")
def rescored(spark, d):
    p, model, _ = _archetypes(spark, d)
    path = new_path(spark, "archetype_model")
    model.save(path)
    return M.score_profiles(M.ArchetypeModel.load(spark, path), p, norm="trained")


@query("model_diagnostics")
def diagnostics(spark, d):
    p, model, results = _archetypes(spark, d)
    out = M.model_diagnostics(model, stage(model.cluster(p), "clustered"), results)
    return out.select("n_cells", "best_k", "n_pca_components", "suitability_diversity_correlation",
                      F.to_json(F.struct(*out.columns)).alias("report"))


@query("train_presence_classifier")
def classifier(spark, d):
    t = L.stratified_split(_train(spark, d))
    model = U.train_presence_classifier(t.where("NOT is_test"))
    held = stage(U.presence_probability(t.where("is_test"), model, K.MODEL_FEATURES, "score"), "scored")
    return L.classifier_metrics(held)


@query("calibrate_isotonic")
def calibrated(spark, d):
    t = _train(spark, d)
    pairs = U.calibrate_isotonic(t)
    return U.calibrated_probability(t, pairs, K.MODEL_FEATURES, "probability").select("ix", "iy", "dekad", "label", "probability")


@query("train_diversity_regressor")
def regressor(spark, d):
    t = _train(spark, d).where("label = 1")
    model = U.train_diversity_regressor(t)
    out = U.diversity_prediction(t, model, K.MODEL_FEATURES, "prediction")
    return L.regressor_metrics(out, "prediction", "shannon_diversity")


@query("feature_importance_rank")
def importance(spark, d):
    return U.feature_importance_rank(spark, U.train_presence_classifier(_train(spark, d)))


@query("cross_validate")
def cross(spark, d):
    return U.cross_validate(_train(spark, d))


@query("score_cells")
def score_cells(spark, d):
    cells = X.latest_sat(spark, d).withColumn("acquisition_date", F.lit(X.NOW))
    return U.score_cells(cells, _suitability(spark, d)).select(
        "ix", "iy", "suitability_probability", "suitability_pct", "archetype", "predicted_diversity")


@query("score_aoi")
def score_aoi(spark, d):
    model = _suitability(spark, d)
    scenes, pixels, aois = X.scenes(spark, d), X.pixels(spark, d), stage(X.aois(spark, d), "aois")
    cells = areas.latest_cells(scenes, pixels, X.BOX, X.NOW, X.GRID)
    live = areas.live_cells(scenes, pixels, aois, X.NOW, X.GRID)
    _, summary = areas.score_aoi(cells, aois, X.GRID, X.NOW, model.score, live)
    return summary.select("aoi_id", "n_cells", "mean_suitability", "max_suitability", "summary")


_MONTH = f"BETWEEN DATE '{X.NOW - dt.timedelta(days=30)}' AND DATE '{X.NOW}'"
CTES |= {
    "live_in": (f"""SELECT aoi_id, (south + north) / 2 AS mid_lat, datetime, idx.* FROM idx
        JOIN (SELECT scene_id, datetime FROM scn WHERE datetime {_MONTH} AND cloud_cover < 30) USING (scene_id)
        JOIN aoi_b ON lon BETWEEN west AND east AND lat BETWEEN south AND north WHERE time {_MONTH}""", ["idx", "scn", "aoi_b"]),
    "live_used": ("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY datetime DESC, scene_id) AS rn FROM (
        SELECT DISTINCT aoi_id, scene_id, datetime FROM live_in))""", ["live_in"]),
    "live_date": ("""SELECT aoi_id, datetime AS acquisition_date, n AS n_scenes FROM (SELECT aoi_id, datetime,
        row_number() OVER (PARTITION BY aoi_id ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY aoi_id) AS n FROM live_used)
        WHERE pos = n // 2""", ["live_used"]),
    "live_med": ("SELECT aoi_id, mid_lat, lon, lat, " + ", ".join(
        f'median(CASE WHEN scl IN (4, 5, 6, 7, 11) THEN "{c}" END) AS "{c}"' for c in K.INDICES)
        + " FROM live_in SEMI JOIN live_used USING (aoi_id, scene_id) GROUP BY aoi_id, mid_lat, lon, lat", ["live_in", "live_used"]),
    "live_cell": (f"""SELECT aoi_id, CAST(floor(lon / ({num(X.GRID.cell_km)} / ({num(K.KM_PER_DEG_LON)} * cos(radians(mid_lat))))) AS BIGINT) AS cix,
        {iy()} AS ciy, {avgs(K.INDICES)} FROM live_med GROUP BY 1, 2, 3 HAVING avg(water_mask) IS NOT NULL""", ["live_med"]),
}


@query("live_cells", sql(f"""SELECT aoi_id, cix AS ix, ciy AS iy, acquisition_date, n_scenes, {rcols(K.INDICES)}
    FROM live_cell JOIN live_date USING (aoi_id)""", "live_cell", "live_date"))
def live(spark, d):
    out = areas.live_cells(X.scenes(spark, d), X.pixels(spark, d), stage(X.aois(spark, d), "aois"), X.NOW, X.GRID)
    return tidy(out, ["aoi_id", "ix", "iy", "acquisition_date", "n_scenes"], K.INDICES)


#: Rows of a file that a stream reads; more rows arrive as more files, so no task writes or reads more as tables grow.
FILE_ROWS = 500_000


def _files(df) -> int:
    """How many files ``df`` arrives as: an even number, four at least, so that two batches take half each."""
    return 2 * max(2, -(-df.count() // (2 * FILE_ROWS)))


@query("stream_latest_cells", sql(f"SELECT ix, iy, {rcols(K.INDICES)} FROM latest_merged", "latest_merged"))
def stream_cells(spark, d):
    """Pixels arrive as files; the folded result equals the batch plan."""
    source, out, check = (new_path(spark, n) for n in ("stream_in", "stream_out", "stream_check"))
    px = X.pixels(spark, d)
    n = _files(px)
    px.repartition(n, "scene_id").write.parquet(source)
    R.stream_latest_cells(spark, source, px.schema, out, check, X.BOX, X.GRID, max_files=n // 2).awaitTermination()
    cells = R.read_latest_cells(spark, out, X.scenes(spark, d), X.BOX, X.NOW, X.GRID)
    return tidy(cells, ["ix", "iy"], K.INDICES)


def event_sightings(spark, d):
    site = F.col("user_id") % 240
    return X.table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(-90.60) + (site % 20) * F.lit(0.0103)).alias("lon"),
        (F.lit(29.00) + F.floor(site / 20) * F.lit(0.0091)).alias("lat"),
        F.col("event_type").alias("species"), F.lit(1).cast("long").alias("count"))


_EVENT_CTE = """WITH ev AS (SELECT CAST(floor((-90.60e0 + ((user_id % 240) % 20) * 0.0103e0) / {lon}) AS BIGINT) AS ix,
    CAST(floor((29.00e0 + ((user_id % 240) // 20) * 0.0091e0) / {lat}) AS BIGINT) AS iy,
    make_date(year(ts), month(ts), CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 11 ELSE 21 END) AS dekad,
    event_type AS species FROM events),
  sp AS (SELECT ix, iy, dekad, species, count(*) AS n FROM ev GROUP BY ix, iy, dekad, species),
  tot AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY ix, iy, dekad) AS p FROM sp)
"""


def _event_sql() -> str:
    head = _EVENT_CTE.format(lon=num(X.GRID.cell_lon), lat=num(X.GRID.cell_lat))
    return head + (f"SELECT ix, iy, dekad, CAST(sum(n) AS BIGINT) AS n_observations, count(*) AS n_species, "
                   f"CAST(sum(n) AS BIGINT) AS n_individuals, {r6('-sum(p * ln(p + 1e-10))', 'shannon_diversity')} "
                   "FROM tot GROUP BY ix, iy, dekad")


@query("stream_bird_metrics", _event_sql())
def stream_birds(spark, d):
    """Sightings arrive as files, the latest days first; the roll-up equals a batch run."""
    source, out, check = (new_path(spark, n) for n in ("events_in", "events_out", "events_check"))
    ev = event_sightings(spark, d)
    n = _files(ev)
    ev.repartitionByRange(n, F.desc("ts")).write.parquet(source)
    R.stream_bird_metrics(spark, source, ev.schema, out, check, X.GRID, max_files=n // 2).awaitTermination()
    return tidy(R.read_bird_metrics(spark, out), ["ix", "iy", "dekad", "n_observations", "n_species", "n_individuals"],
                ["shannon_diversity"])
