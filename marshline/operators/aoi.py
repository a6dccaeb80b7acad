"""Areas of interest: spatial join and summaries for many polygons at once.

``aois`` has one row per area: ``aoi_id`` and ``polys`` (see
``functions.geometry``). Every summary is one aggregation by ``aoi_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marshline import constants as K
from marshline.functions import geometry as G, labels as L
from marshline.grid import GridSpec, cell_polygon
from marshline.operators.covers import box_cover, inside, slab_cover
from marshline.operators.scoring import trend_columns
from marshline.session import stage

# Largest covering table to broadcast, in slabs and edges (about 60 bytes each).
BROADCAST_EDGES = 200_000


def outlines(aois: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each different outline once (``_shape``, ``polys``), and the areas by outline: ``_shape`` and their other columns."""
    keyed = stage(aois.withColumn("_shape", F.sha2(F.to_json("polys"), 256)), "areas")
    return keyed.select("_shape", "polys").dropDuplicates(["_shape"]), keyed.drop("polys")


def _join_outlines(points: DataFrame, shapes: DataFrame, grid: GridSpec, x: str, y: str, refine: bool = True) -> DataFrame:
    """Points inside each outline, with the outline's other columns."""
    cover = stage(slab_cover(shapes, grid) if refine else box_cover(shapes, grid), "cover")
    size = cover.agg(F.coalesce(F.sum("_cost"), F.lit(0)).alias("edges"), F.collect_set("_size").alias("used")).first()
    cover = F.broadcast(cover) if size["edges"] <= BROADCAST_EDGES else cover.hint("merge")
    used = F.array(*[F.lit(s) for s in sorted(size["used"])]).cast("array<int>")
    keyed = (
        points.withColumn("_size", F.explode(used))
        .withColumns({"_cx": F.floor(grid.ix(F.col(x)) / F.col("_size")),
                      "_cy": F.floor(grid.iy(F.col(y)) / F.col("_size"))}))
    b = F.col("bounds")
    px, py = F.col(x), F.col(y)
    hit = px.between(b["west"], b["east"]) & py.between(b["south"], b["north"])
    found = keyed.join(cover, ["_size", "_cx", "_cy"]).where(hit)
    if refine:
        found = found.where(inside(px, py))
    return found.drop("_size", "_cx", "_cy", "bounds", "_cost", "_slabs", "_first", "_height")


def spatial_join(points: DataFrame, aois: DataFrame, grid: GridSpec, x: str = "cell_x", y: str = "cell_y",
                 refine: bool = True) -> DataFrame:
    """Points inside each area, with ``aoi_id`` and the area's other columns.

    An equi join on covering index cells, then the bounding box, then strict
    containment (``refine=False`` stops at the box). The cover says for each slab of
    an area within a cell whether it is inside, outside or which few edges decide
    (see ``operators.covers``), so most points need no test. It is
    staged and measured first: up to ``BROADCAST_EDGES`` slabs and edges it is
    broadcast and the points never move. Beyond that both sides shuffle on the
    index cell, where adaptive execution splits hot cells; the hint keeps a wrong
    size estimate from broadcasting the exploded table. Areas of one outline are covered
    and tested once; what was found is joined to all of them.
    """
    shapes, members = outlines(aois)
    return _join_outlines(points, shapes, grid, x, y, refine).join(members, "_shape").drop("_shape")


def point_counts(points: DataFrame, aois: DataFrame, grid: GridSpec, site: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Number of points and of different sites inside each area that has any; areas need an ``aoi_id``.

    Equal points are counted before they are tested, and areas of one outline are counted once, so the tests
    grow with the different points and outlines, not with the rows.
    """
    shapes, members = outlines(aois)
    places = points.groupBy(F.col(site).alias("_site"), x, y).agg(F.count("*").alias("_n"))
    # Few bytes may need many tests: the places are dealt to all cores.
    dealt = places.repartition(4 * points.sparkSession.sparkContext.defaultParallelism)
    sites = _join_outlines(dealt, shapes, grid, x, y).groupBy("_shape", "_site").agg(F.sum("_n").alias("_n"))
    return members.join(sites, "_shape").groupBy("aoi_id").agg(F.sum("_n").alias("n_points"), F.count_distinct("_site").alias("n_sites"))


def aoi_profile_join(matched: DataFrame, profiles: DataFrame, how: str = "inner") -> DataFrame:
    """Attach profiles to matched cells on the cell key."""
    extra = [c for c in profiles.columns if c in ("ix", "iy") or c not in matched.columns]
    return matched.join(profiles.select(*extra), ["ix", "iy"], how)


def _order_totals(df: DataFrame) -> list[str]:
    skip = ("observation", "species", "individual")
    return [c for c in df.columns if c.startswith("n_") and c.endswith("_total") and not any(s in c for s in skip)]


def _has(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _total_exprs(df: DataFrame) -> list[Column]:
    seen, species = _has(df, "n_observations_sum", "n_observations_mean"), _has(df, "n_species_max", "n_species_mean")
    zero = F.lit(0).cast("long")
    return [
        (F.coalesce(F.sum(seen).cast("long"), zero) if seen else F.max(zero)).alias("total_sightings"),
        (F.coalesce(F.max(species).cast("long"), zero) if species else F.max(zero)).alias("species_count"),
    ]


_TRAJECTORIES = ["degrading", "improving", "stable", "unknown"]


def _condition_exprs() -> list[Column]:
    return [F.count("*").alias("_n")] + [
        F.count(F.when(F.col("trajectory") == t, 1)).alias(f"_n_{t}") for t in _TRAJECTORIES]


def _condition_columns() -> dict[str, Column]:
    """Majority trajectory; equal counts by name."""
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(f"_n_{t}")).alias("neg"), F.lit(t).alias("name")) for t in _TRAJECTORIES]))
    top = F.element_at(ranked, 1)
    pct = -top["neg"] / F.col("_n") * 100
    return {"condition": top["name"], "condition_pct": pct, "condition_detail": L.condition_text(top["name"], pct)}


def _trend_exprs(cols: list[str]) -> list[Column]:
    return [F.avg(c).alias(f"_avg_{c}") for c in cols]


def _trend_texts(cols: list[str], horizon: int) -> dict[str, Column]:
    def text(c: str, name: str) -> Column:
        return L.describe_trend(F.col(f"_avg_{c}"), name, horizon) if c in cols else F.lit(K.TREND_NO_DATA)
    return {"vegetation_trend": text("NDVI_trend", "Vegetation"), "water_trend": text("NDWI_trend", "Water presence")}


def _notable(cols: list[str], horizon: int) -> Column:
    """Largest absolute mean trend; equal sizes by name."""
    ranked = F.array_sort(F.filter(F.array(*[
        F.struct((-F.abs(F.col(f"_avg_{c}"))).alias("neg"), F.lit(c).alias("name"), F.col(f"_avg_{c}").alias("v"))
        for c in cols]), lambda s: s["v"].isNotNull()))
    top = F.get(ranked, F.lit(0))
    return F.coalesce(L.notable_change(top["name"], top["v"], horizon), F.lit(K.NOTABLE_NONE))


def _diversity_expr() -> Column:
    h = F.col("shannon_diversity_mean")
    return F.avg(F.when(h > 0, h)).alias("_shannon")


def _coverage_expr() -> Column:
    return (100.0 * F.avg(F.col("has_bird_data").cast("double"))).alias("_covered")


def _top_orders(cols: list[str], n: int) -> Column:
    pairs = F.array(*[F.struct((-F.col(f"_sum_{c}")).alias("neg"), F.lit(c[2:-6]).alias("order")) for c in cols])
    best = F.slice(F.array_sort(F.filter(pairs, lambda s: s["neg"] < 0)), 1, n)
    return F.transform(best, lambda s: F.struct(s["order"].alias("order"), (-s["neg"]).cast("long").alias("count")))


def aoi_totals(df: DataFrame) -> DataFrame:
    """Total sightings and largest species count per area."""
    return df.groupBy("aoi_id").agg(*_total_exprs(df))


def aoi_top_orders(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest order totals per area, positive only, one row each."""
    cols = _order_totals(df)
    sums = df.groupBy("aoi_id").agg(*[F.sum(c).alias(f"_sum_{c}") for c in cols])
    return (sums.select("aoi_id", F.posexplode(_top_orders(cols, n)).alias("pos", "o"))
            .select("aoi_id", (F.col("pos") + 1).alias("rank"), "o.order", "o.count"))


def aoi_condition(df: DataFrame) -> DataFrame:
    """Majority trajectory, its share and sentence per area."""
    cols = _condition_columns()
    return df.groupBy("aoi_id").agg(*_condition_exprs()).select("aoi_id", *[c.alias(n) for n, c in cols.items()])


def aoi_trends(df: DataFrame, horizon_years: int = 6) -> DataFrame:
    """Vegetation and water trend sentences per area."""
    cols = trend_columns(df)
    texts = _trend_texts(cols, horizon_years)
    return df.groupBy("aoi_id").agg(*_trend_exprs(cols)).select("aoi_id", *[c.alias(n) for n, c in texts.items()])


def aoi_notable_change(df: DataFrame, horizon_years: int = 6) -> DataFrame:
    """Sentence on the strongest mean trend per area."""
    cols = trend_columns(df)
    return df.groupBy("aoi_id").agg(*_trend_exprs(cols)).select(
        "aoi_id", _notable(cols, horizon_years).alias("notable_change"))


def aoi_diversity(df: DataFrame) -> DataFrame:
    """Mean diversity of surveyed cells and its level per area."""
    return df.groupBy("aoi_id").agg(_diversity_expr()).select(
        "aoi_id", F.col("_shannon").alias("mean_shannon"), L.diversity_level(F.col("_shannon")).alias("diversity_level"))


def aoi_coverage(df: DataFrame) -> DataFrame:
    """Share of cells with bird data and its sentence per area."""
    return df.groupBy("aoi_id").agg(_coverage_expr()).select(
        "aoi_id", F.col("_covered").alias("covered_pct"),
        L.coverage_text(F.coalesce(F.col("_covered"), F.lit(0.0))).alias("data_coverage"))


def summarise_aois(df: DataFrame, top_n: int = 5, horizon_years: int = 6) -> DataFrame:
    """All summary fields per area from matched cells with profiles attached."""
    trends, orders = trend_columns(df), _order_totals(df)
    area = [F.max("area_km2").alias("area_km2")] if "area_km2" in df.columns else []
    stats = df.groupBy("aoi_id").agg(
        *_total_exprs(df), *_condition_exprs(), *_trend_exprs(trends), _diversity_expr(), _coverage_expr(),
        *[F.sum(c).alias(f"_sum_{c}") for c in orders], *area)
    cols = {
        "total_sightings": F.col("total_sightings"), "species_count": F.col("species_count"),
        "top_species": _top_orders(orders, top_n) if orders else F.array(),
        **{k: v for k, v in _condition_columns().items() if k != "condition_pct"},
        **_trend_texts(trends, horizon_years),
        "notable_change": _notable(trends, horizon_years),
        "diversity_level": L.diversity_level(F.col("_shannon")),
        "data_coverage": L.coverage_text(F.coalesce(F.col("_covered"), F.lit(0.0))),
    }
    return stats.select("aoi_id", *[c.alias(n) for n, c in cols.items()], *(["area_km2"] if area else []))


_CLASSES = [K.OPEN_WATER] + [name for name, _, _ in K.PROBABILITY_BANDS]


def top_cells(scored: DataFrame, n: int = 5, keys: list[str] = ("aoi_id",)) -> DataFrame:
    """The ``n`` most suitable cells per area (or overall); equal cells by key.

    The rank limit is applied before the shuffle, so a huge area sends only
    ``n`` rows per task.
    """
    best = [F.desc("suitability_probability"), F.asc("ix"), F.asc("iy")]
    if not keys:
        return scored.orderBy(*best).limit(n)
    w = Window.partitionBy(*keys).orderBy(*best)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def score_summary(scored: DataFrame, top_n: int = 5) -> DataFrame:
    """Counts, means, class shares, best cells and a headline per area."""
    counts = [F.count(F.when(F.col("archetype") == c, 1)).alias(f"_n{i}") for i, c in enumerate(_CLASSES)]
    stats = scored.groupBy("aoi_id").agg(
        F.count("*").alias("n_cells"), F.avg("suitability_probability").alias("_mean"),
        F.max("suitability_probability").alias("_max"), *counts)

    def share(i: int) -> Column:
        return F.col(f"_n{i}") / F.col("n_cells") * 100

    breakdown = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(c).alias("k"), F.struct(F.col(f"_n{i}").alias("count"), F.bround(share(i), 1).alias("pct")).alias("v"))
        for i, c in enumerate(_CLASSES)]), lambda e: e["v"]["count"] > 0))
    high, moderate, unsuitable = (share(_CLASSES.index(n)) for n in
                                  ("Highly suitable", "Moderately suitable", "Unsuitable"))
    best = top_cells(scored, top_n).groupBy("aoi_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("cell_x").alias("lon"), F.col("cell_y").alias("lat"),
        F.bround("suitability_probability", 3).alias("probability"), "archetype",
        F.bround("predicted_diversity", 1).alias("predicted_diversity")))).alias("top_cells"))
    return stats.select(
        "aoi_id", "n_cells",
        F.bround(F.col("_mean") * 100, 1).alias("mean_suitability"),
        F.bround(F.col("_max") * 100, 1).alias("max_suitability"),
        L.score_summary_text(high, moderate, unsuitable, F.col("_mean")).alias("summary"),
        breakdown.alias("archetype_breakdown"),
    ).join(best, "aoi_id")


def cells_to_geojson(scored: DataFrame, grid: GridSpec, keep: list[str] = ()) -> DataFrame:
    """One GeoJSON Feature string per scored cell.

    Features stay rows (newline-delimited GeoJSON), so an area of any size is
    written by many tasks.
    """
    ring = F.transform(cell_polygon(F.col("ix"), F.col("iy"), grid), lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(
            F.bround("suitability_pct", 1).alias("suitability"),
            F.bround("suitability_probability", 3).alias("probability"),
            F.col("archetype"),
            F.bround("predicted_diversity", 1).alias("predicted_diversity")).alias("properties"))
    return scored.select(*keep, F.to_json(feature).alias("feature"))
