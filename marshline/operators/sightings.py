"""Species sightings: cleaning, unification and per-cell metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marshline import constants as K
from marshline.functions.casting import coerce_count, coerce_date, read_once
from marshline.functions.dates import assign_dekad
from marshline.grid import GridSpec, assign_grid_cell, in_bbox

CELL_DEKAD = ["ix", "iy", "dekad"]


def unwrap_quoted_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Trim trailing blanks and commas, then one enclosing pair of quotes."""
    bare = F.regexp_replace(F.regexp_replace(F.col(line), r"\s+$", ""), ",+$", "")
    wrapped = bare.startswith('"') & bare.endswith('"')
    inner = F.when(F.length(bare) > 1, bare.substr(F.lit(2), F.length(bare) - 2)).otherwise("")
    return df.withColumn(line, F.when(wrapped, inner).otherwise(bare))


def resolve_column_aliases(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Select the known sighting columns under their short names, and ``keep`` as they are.

    Header names match whatever their case; of several matches the last wins.
    Absent optional columns become NULL strings.
    """
    chosen: dict[str, str] = {}
    for name in df.columns:
        clean = name.strip().strip('"').strip("'").lower()
        for short, aliases in K.SIGHTING_ALIASES.items():
            if clean in aliases:
                chosen[short] = name
    missing = [c for c in K.SIGHTING_REQUIRED if c not in chosen]
    if missing:
        raise ValueError(f"no column found for {missing} among {df.columns}")
    return df.select(*[
        F.col(f"`{chosen[s]}`").alias(s) if s in chosen else F.lit(None).cast("string").alias(s)
        for s in K.SIGHTING_ALIASES
    ], *keep)


def filter_years(df: DataFrame, lo: int = K.YEAR_MIN, hi: int = K.YEAR_MAX, date: str = "date") -> DataFrame:
    """Rows whose year lies in ``lo..hi``; a ``year`` column is tested too, so tables partitioned by year are pruned."""
    rows = df.where(F.col(date).between(F.make_date(F.lit(lo), F.lit(1), F.lit(1)),
                                        F.make_date(F.lit(hi), F.lit(12), F.lit(31))))
    return rows.where(F.col("year").between(lo, hi)) if "year" in df.columns else rows


def filter_taxon(df: DataFrame, taxon: str = "Aves", col: str = "iconic_taxon_name") -> DataFrame:
    return df.where(F.col(col) == taxon)


def _located(df: DataFrame, grid: GridSpec, years: tuple[int, int]) -> DataFrame:
    """Cheap spatial filter first, then dates, then cell and dekad.

    Range tests are false for missing and NaN values alike, so they also drop
    rows without coordinates or a readable date. Texts are read once a row:
    reading them again for every bound and column took most of a scan's time.
    """
    near = read_once(df, "lon", "lat").where(in_bbox(F.col("lon"), F.col("lat"), grid.buffered))
    dated = filter_years(read_once(near.withColumn("date", coerce_date(F.col("date"))), "date"), *years)
    return assign_grid_cell(dated, grid).withColumn("dekad", assign_dekad(F.col("date")))


_OUT = [*CELL_DEKAD, "species", "order", "family", "count", "source"]


def clean_ebird(raw: DataFrame, grid: GridSpec, years=(K.YEAR_MIN, K.YEAR_MAX), keep: list[str] = ()) -> DataFrame:
    """String columns of source A to unified observations.

    ``keep`` names further columns that are passed on, such as a key: what it stands for can then be looked up for the rows that are left.
    """
    short = resolve_column_aliases(raw, keep).withColumns({
        c: F.trim(F.col(c)).try_cast("double") for c in ("lat", "lon")})
    return _located(short, grid, years).withColumns({
        "count": coerce_count(F.col("count")), "source": F.lit("ebird")}).select(*_OUT, *keep)


def clean_inat(raw: DataFrame, grid: GridSpec, years=(K.YEAR_MIN, K.YEAR_MAX), taxon: str = "Aves", keep: list[str] = ()) -> DataFrame:
    """Rows of source B to observations; order and family are not recorded there. ``keep`` as in ``clean_ebird``."""
    birds = filter_taxon(raw, taxon).select(
        F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"),
        F.col("observed_on").alias("date"), F.col("scientific_name").alias("species"), *keep)
    return _located(birds, grid, years).withColumns({
        "count": coerce_count(None), "source": F.lit("inat")}).select(
        *CELL_DEKAD, "species", "count", "source", *keep)


def union_sightings(ebird: DataFrame, inat: DataFrame) -> DataFrame:
    """Both sources stacked; columns one source lacks are missing there."""
    return ebird.unionByName(inat, allowMissingColumns=True)


def top_orders(obs: DataFrame, n: int = K.TOP_ORDERS) -> DataFrame:
    """The ``n`` orders with most rows; equal counts by name."""
    return (obs.where(F.col("order").isNotNull()).groupBy("order").agg(F.count("*").alias("n_rows"))
            .orderBy(F.desc("n_rows"), F.asc("order")).limit(n))


def top_order_names(obs: DataFrame, n: int = K.TOP_ORDERS) -> list[str]:
    """Names for pivot columns: an eager look-up of at most ``n`` strings."""
    return [r["order"] for r in top_orders(obs, n).collect()]


def order_column(name: str) -> str:
    return "n_" + name.replace(" ", "_")


def _species_counts(obs: DataFrame, keys: list[str], extra: dict[str, Column]) -> DataFrame:
    """First level of every metric: one row per key and species.

    Splitting a busy cell by species before the second shuffle bounds what one
    key can hold by the species list.
    """
    return obs.groupBy(*keys, "species").agg(
        F.count("*").alias("n"), F.sum("count").alias("individuals"),
        *[F.sum(c).alias(name) for name, c in extra.items()])


def _shannon(n: Column, total: Column, eps: float) -> Column:
    p = n / total
    return F.coalesce(-F.sum(F.when(total > 0, p * F.log(p + F.lit(eps)))), F.lit(0.0))


def species_roll_up(species: DataFrame, keys: list[str] = CELL_DEKAD, extra: list[str] = (),
                    eps: float = K.SHANNON_EPS) -> DataFrame:
    """Metrics from (key, species, n, individuals) rows.

    Unnamed sightings count as observations and individuals but not as species
    and not in the diversity.
    """
    named = F.col("species").isNotNull()
    with_total = species.withColumn(
        "_total", F.sum(F.when(named, F.col("n"))).over(Window.partitionBy(*keys)))
    return with_total.groupBy(*keys).agg(
        F.sum("n").alias("n_observations"),
        F.count(F.when(named, 1)).alias("n_species"),
        F.sum("individuals").alias("n_individuals"),
        _shannon(F.when(named, F.col("n")), F.col("_total"), eps).alias("shannon_diversity"),
        *[F.sum(c).alias(c) for c in extra])


def cell_bird_metrics(obs: DataFrame, keys: list[str] = CELL_DEKAD) -> DataFrame:
    """Rows, distinct named species and individuals per key."""
    return species_roll_up(_species_counts(obs, keys, {}), keys).drop("shannon_diversity")


def shannon_diversity(obs: DataFrame, eps: float = K.SHANNON_EPS, keys: list[str] = CELL_DEKAD) -> DataFrame:
    """Shannon index of species shares per key; 0 where no species is named."""
    return species_roll_up(_species_counts(obs, keys, {}), keys, eps=eps).select(*keys, "shannon_diversity")


def _order_hits(names: list[str]) -> dict[str, Column]:
    return {order_column(n): F.when(F.col("order") == n, 1).otherwise(0) for n in names}


def top_order_pivot(obs: DataFrame, names: list[str], keys: list[str] = CELL_DEKAD) -> DataFrame:
    """One zero-filled count column per order name."""
    return obs.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in _order_hits(names).items()])


def bird_metrics(obs: DataFrame, order_names: list[str] = (), keys: list[str] = CELL_DEKAD) -> DataFrame:
    """All metrics and order counts in one two-level aggregation."""
    hits = _order_hits(order_names)
    return species_roll_up(_species_counts(obs, keys, hits), keys, list(hits))


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def join_bird_metrics(sat: DataFrame, birds: DataFrame, keys: list[str] = CELL_DEKAD) -> DataFrame:
    """Left join on cell and dekad; no sighting means zero, not missing.

    Both sides are unique on the key and come hash-partitioned by it from their
    last aggregation, so the join adds no shuffle.
    """
    cols = [c for c in birds.columns if c not in keys]
    return fill_zero(sat.join(birds, keys, "left"), cols)
