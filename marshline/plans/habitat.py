"""From pixels and sightings to the cell-by-dekad table, profiles and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marshline import constants as K
from marshline.functions.dates import assign_dekad, temporal_columns
from marshline.grid import GridSpec, assign_grid_cell, with_centers
from marshline.operators import pixels as P, profiles as R, scoring as S, sightings as B
from marshline.session import stage


def temporal_features(df: DataFrame, date: str = "dekad", doy_period: float = K.DAYS_PER_YEAR) -> DataFrame:
    """Add year, month, day_of_year, bird_season, doy_sin and doy_cos."""
    return df.withColumns(temporal_columns(F.col(date), doy_period))


def pixel_indices(pixels: DataFrame, policy: str | None = None) -> DataFrame:
    """Named bands, reflectance, indices and (optionally) the scene-class mask."""
    df = P.spectral_indices(P.scale_reflectance(P.canonical_bands(pixels, coordinates=False)))
    return P.scl_mask(df, policy) if policy else df


def cell_dekads(pixels: DataFrame, grid: GridSpec, factor: int = 1, policy: str | None = None, sparse: bool = False) -> DataFrame:
    """Mean indices per cell and dekad.

    Stages are block mean, mean of blocks per tile image, mean over tiles and
    images. Each reduces map-side, so only the first sees pixels.

    ``sparse`` is for tables with few pixels per image and cell. There a task combines
    next to nothing, and would pass on a sum and a count of every index for
    nearly every pixel. The bands, half as wide, are dealt by cell and dekad instead,
    and both means follow in one stage. Blocks are combined map-side either way.
    """
    image = ["tile_id", "time", "ix", "iy"]
    if sparse and factor == 1:
        dated = assign_grid_cell(pixels, grid).withColumn("dekad", assign_dekad(F.col("time")))
        located = pixel_indices(dated.repartition(*B.CELL_DEKAD), policy)
        return P.dedupe_overlaps(P.drop_missing_all(P.cell_means(located, [*image, "dekad"])))
    df = pixel_indices(pixels, policy)
    if factor > 1:
        df = P.coarsen_blocks(df, factor, K.INDICES)
    located = assign_grid_cell(df, grid)
    # Means skip missing pixels, so empty rows are dropped after the first
    # reduction: before it, the test would evaluate every index a second time
    # in one method too large for the JIT compiler.
    # The dekad follows from the image's time, so images get it, not pixels.
    per_image = P.drop_missing_all(P.cell_means(located, image))
    return P.dedupe_overlaps(per_image.withColumn("dekad", assign_dekad(F.col("time"))))


def model_input(pixels: DataFrame, observations: DataFrame | None, grid: GridSpec, factor: int = 1,
                years: tuple[int, int] = (K.YEAR_MIN, K.YEAR_MAX), tiles: list[int] | None = None,
                order_names: list[str] | None = None, policy: str | None = None, sparse: bool = False) -> DataFrame:
    """One row per cell and dekad: indices, calendar features, bird metrics.

    ``order_names`` fixes the order columns; when None they are looked up once
    from the observations. ``sparse`` as in ``cell_dekads``.
    """
    px = B.filter_years(pixels, *years, date="time")
    if tiles is not None:
        px = px.where(F.col("tile_id").isin(tiles))
    sat = temporal_features(cell_dekads(px, grid, factor, policy, sparse))
    if observations is not None:
        names = B.top_order_names(observations) if order_names is None else order_names
        sat = B.join_bird_metrics(sat, B.bird_metrics(observations, names))
    return with_centers(sat, grid)


def cell_timeseries(pixels: DataFrame, factor: int = 1, source: Column | None = None) -> DataFrame:
    """Long table of blocks over time with bands, indices and calendar features."""
    df = pixel_indices(pixels)
    bands = [b for b in K.BANDS if b in df.columns]
    blocks = P.coarsen_blocks(df, factor, [*bands, *K.INDICES])
    tagged = blocks.withColumn("source_tile", source if source is not None else F.concat(
        F.lit("tile"), F.col("tile_id").cast("string"), F.lit("_"), F.year("time").cast("string")))
    return temporal_features(P.drop_missing_all(tagged, [*bands, *K.INDICES]), "time")


def cell_profiles(mi: DataFrame) -> DataFrame:
    """One row per cell with every feature, gaps filled by column medians.

    The raw profiles are staged once because the gap check and the medians read
    them again.
    """
    return R.finish_profiles(stage(R.raw_profiles(mi), "profiles"))


def score_results(profiles: DataFrame, scores: DataFrame, percentiles: tuple[float, float] | None = None,
                  trend_bounds: tuple[float, float] | None = None,
                  priority_bounds: tuple[float, float] | None = None) -> DataFrame:
    """Suitability, trajectory and priority of clustered profiles.

    ``scores`` is the per-cluster suitability. Saved percentiles and bounds make
    scores comparable with the training run; without them the batch's own are used.
    """
    rated = S.map_cluster_scores(profiles, scores)
    moved = S.trajectory(S.trend_composite(rated), percentiles)
    return S.conservation_priority(
        S.minmax_scale(moved, "trend_composite", "trend_score", bounds=trend_bounds), priority_bounds)


RESULT_COLUMNS = ["ix", "iy", "cluster", "cluster_confidence", "habitat_suitability", "trend_composite",
                  "trajectory", "trend_score", "conservation_priority"]


def habitat_results(clustered: DataFrame) -> DataFrame:
    """Scores from profiles that carry ``cluster`` and ``cluster_confidence``.

    Every global range and percentile reads the profiles again, so they are
    staged once, and so are the scores of the few clusters.
    """
    cells = stage(clustered, "clustered")
    scores = stage(S.habitat_suitability(S.cluster_bird_scores(cells)), "suitability")
    out = score_results(cells, scores)
    return out.select(*RESULT_COLUMNS, *S.trend_columns(out))
