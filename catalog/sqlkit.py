"""The same derived tables as SQL, composed as common table expressions."""

from __future__ import annotations

from catalog.fixtures import BOX, GRID, NOW, OUTLINES, SHIFT_MONTHS
from catalog.registry import nudge
from marshline import constants as K


def num(x: float) -> str:
    """A double literal (plain decimals would be DECIMAL)."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def r6(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f'round(CAST({expr} AS DOUBLE) + {num(nudge(digits))}, {digits}) + 0e0' + (f' AS "{name}"' if name else "")


def rcols(cols: list[str], digits: int = 6) -> str:
    return ", ".join(r6(f'"{c}"', c, digits) for c in cols)


def shift(col: str) -> str:
    return f"CAST({col} + INTERVAL {SHIFT_MONTHS} MONTH AS DATE)"


def dekad(c: str) -> str:
    return (f"make_date(year({c}), month({c}), CASE WHEN day({c}) <= 10 THEN 1 "
            f"WHEN day({c}) <= 20 THEN 11 ELSE 21 END)")


def season(m: str) -> str:
    whens = " ".join(f"WHEN {m} IN ({','.join(map(str, ms))}) THEN '{n}'" for n, ms in K.SEASON_MONTHS.items())
    return f"CASE {whens} ELSE 'unknown' END"


def ix(c: str = "lon") -> str:
    return f"CAST(floor({c} / {num(GRID.cell_lon)}) AS BIGINT)"


def iy(c: str = "lat") -> str:
    return f"CAST(floor({c} / {num(GRID.cell_lat)}) AS BIGINT)"


def cx(c: str = "ix") -> str:
    return f"({c} * {num(GRID.cell_lon)} + {num(GRID.cell_lon / 2)})"


def cy(c: str = "iy") -> str:
    return f"({c} * {num(GRID.cell_lat)} + {num(GRID.cell_lat / 2)})"


def nd(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"


def pmod(e: str, n: int) -> str:
    return f"((({e}) % {n}) + {n}) % {n}"


_dead = "(l_linenumber = 7 AND l_orderkey % 10 = 0)"
_site = "(l_partkey % 240)"
_lon = f"-90.60e0 + ({_site} % 20) * 0.0103e0 + (l_orderkey % 5) * 0.0001e0"
_lat = f"29.00e0 + ({_site} // 20) * 0.0091e0 + l_linenumber * 0.0001e0"
_evi_d = "(nir + 6e0 * red - 7.5e0 * blue + 1e0)"
_tc = " + ".join(f"({num(w)}) * {b}" for b, w in K.TC_WETNESS.items())
_w, _s, _e, _n = GRID.buffered
_sum_w = sum(K.TREND_WEIGHTS.get(f"{c}_trend", K.OTHER_TREND_WEIGHT) for c in K.TREND_INDICES)
IDX = ", ".join(f'"{c}"' for c in K.INDICES)


def avgs(cols: list[str]) -> str:
    return ", ".join(f'avg("{c}") AS "{c}"' for c in cols)


DAYS = "CAST(date_diff('day', DATE '2020-01-01', {d}) AS DOUBLE)"


def slope(c: str, d: str, least: int, per: float) -> str:
    t = DAYS.format(d=d)
    return (f'CASE WHEN count(*) >= {least} AND count("{c}") >= {least} AND max({t}) > min({t}) '
            f'THEN regr_slope("{c}", {t}) * {num(per)} END')


def stat_list(cols: list[str], median: bool = True) -> list[tuple[str, str]]:
    out = []
    for c in cols:
        out += [(f"{c}_mean", f'avg("{c}")'), (f"{c}_std", f'stddev_samp("{c}")'),
                (f"{c}_min", f'min("{c}")'), (f"{c}_max", f'max("{c}")')]
        if median:
            out.append((f"{c}_median", f'median("{c}")'))
    return out


def season_list(cols: list[str]) -> list[tuple[str, str]]:
    return [(f"{c}_{s}", f"avg(\"{c}\") FILTER (WHERE bird_season = '{s}')") for s in K.SEASONS for c in cols]


def trend_list() -> list[tuple[str, str]]:
    return [(f"{c}_trend", slope(c, "dekad", 6, K.DAYS_PER_YEAR)) for c in K.TREND_INDICES]


def daily_list(d: str) -> list[tuple[str, str]]:
    return [(f"{c}_trend", slope(c, d, 3, 1.0)) for c in K.DAILY_TREND_INDICES]


def amplitude_list() -> list[tuple[str, str]]:
    g, q = "','".join(K.GROWING), "','".join(K.DORMANT)
    return [(f"{c}_seasonal_amplitude",
             f"avg(\"{c}\") FILTER (WHERE bird_season IN ('{g}')) - avg(\"{c}\") FILTER (WHERE bird_season IN ('{q}'))")
            for c in K.AMPLITUDE_INDICES]


def bird_list() -> list[tuple[str, str]]:
    out = []
    for c in K.BIRD_METRICS:
        out += [(f"{c}_mean", f"avg({c})"), (f"{c}_max", f"max({c})"), (f"{c}_sum", f"sum({c})")]
    return out


def as_list(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in pairs)


def temporal(d: str, period: float = K.DAYS_PER_YEAR) -> str:
    import math
    two_pi = num(2 * math.pi)
    return (f"CAST(year({d}) AS INTEGER) AS year, CAST(month({d}) AS INTEGER) AS month, "
            f"CAST(dayofyear({d}) AS INTEGER) AS day_of_year, {season(f'month({d})')} AS bird_season, "
            f"sin({two_pi} * dayofyear({d}) / {num(period)}) AS doy_sin, "
            f"cos({two_pi} * dayofyear({d}) / {num(period)}) AS doy_cos")


def suit_class(p: str, water: str) -> str:
    whens = " ".join(f"WHEN {p} >= {num(lo)} THEN '{n}'" for n, lo, _ in K.PROBABILITY_BANDS[:-1])
    return f"CASE WHEN {water} > 0.5e0 THEN '{K.OPEN_WATER}' {whens} ELSE '{K.PROBABILITY_BANDS[-1][0]}' END"


def pct(e: str) -> str:
    return f"CAST(round_even({e}, 0) AS BIGINT)"


def trend_text(slope_: str, name: str) -> str:
    return (f"CASE WHEN {slope_} IS NULL THEN '{K.TREND_NO_DATA}' WHEN abs({slope_}) < {num(K.TREND_EPS)} "
            f"THEN '{K.TREND_STABLE}' ELSE printf('{K.TREND_TEXT}', '{name}', "
            f"CASE WHEN {slope_} > 0 THEN 'increased' ELSE 'declined' END, {pct(f'abs({slope_} * 6) * 100')}, 6) END")


def notable_text(name: str, v: str) -> str:
    label = f"upper(replace(replace({name}, '_trend', ''), '_', ' '))"
    return (f"CASE WHEN abs({v}) > {num(K.TREND_EPS)} THEN printf('{K.NOTABLE_TEXT}', {label}, "
            f"CASE WHEN {v} > 0 THEN 'increasing' ELSE 'decreasing' END, {pct(f'abs({v} * 6) * 100')}, 6) "
            f"ELSE '{K.NOTABLE_NONE}' END")


def diversity_text(h: str) -> str:
    whens = " ".join(f"WHEN {h} >= {num(lo)} THEN '{n}'" for lo, n in K.DIVERSITY_LEVELS)
    return f"CASE WHEN {h} IS NULL THEN '{K.DIVERSITY_NO_DATA}' {whens} ELSE '{K.DIVERSITY_LOWEST}' END"


def coverage_sql(p: str) -> str:
    return (f"CASE WHEN {p} >= 20 THEN printf('{K.COVERAGE_WELL}', {pct(p)}) "
            f"WHEN {p} >= 5 THEN printf('{K.COVERAGE_MODERATE}', {pct(p)}) "
            f"WHEN {p} > 0 THEN printf('{K.COVERAGE_SPARSE}', {pct(p)}) ELSE '{K.COVERAGE_NONE}' END")


def condition_sql(label: str, p: str) -> str:
    t = K.CONDITION_TEXT
    return (f"CASE WHEN {label} = 'degrading' THEN printf('{t['degrading']}', {pct(p)}) "
            f"WHEN {label} = 'improving' THEN printf('{t['improving']}', {pct(p)}) "
            f"ELSE printf('{t['stable']}', {pct(p)}) END")


def score_text(h: str, m: str, u: str, mean: str) -> str:
    return (f"CASE WHEN {h} > 30 THEN printf('{K.SCORE_STRONG}', {pct(h)}) "
            f"WHEN {h} + {m} > 50 THEN printf('{K.SCORE_MIXED}', {pct(h)}, {pct(m)}) "
            f"WHEN {u} > 70 THEN printf('{K.SCORE_LIMITED}', {pct(u)}) "
            f"ELSE printf('{K.SCORE_MODERATE}', {pct(f'{mean} * 100')}) END")


def ladder_sql(v: str, steps, lowest: str) -> str:
    whens = " ".join(f"WHEN {v} > {num(e)} THEN '{n}'" for e, n in steps)
    return f"CASE {whens} ELSE '{lowest}' END"


def cluster_label_sql(flood: str, veg: str, trend: str) -> str:
    return (f"{ladder_sql(f'coalesce({flood}, 0)', K.FLOOD_LABELS, K.FLOOD_LOWEST)} || ' — ' || "
            f"{ladder_sql(f'coalesce({veg}, 0)', K.VEGETATION_LABELS, K.VEGETATION_LOWEST)} || "
            f"CASE WHEN {trend} > {num(K.GREENING_EPS)} THEN ' {K.GREENING}' "
            f"WHEN {trend} < -{num(K.GREENING_EPS)} THEN ' {K.BROWNING}' ELSE '' END")


def scale(v: str, lo: str, hi: str, top: float = 100.0) -> str:
    return f"({v} - {lo}) / (CASE WHEN {hi} > {lo} THEN {hi} - {lo} ELSE 1e0 END) * {num(top)}"


def tile_span(lo: str, hi: str, origin: float, step: float, n: int) -> str:
    first = f"greatest(CAST(ceil(({lo} - ({num(origin)})) / {num(step)}) AS BIGINT) - 1, 0)"
    last = f"least(CAST(floor(({hi} - ({num(origin)})) / {num(step)}) AS BIGINT), {n - 1})"
    return f"range({first}, {last} + 1)"


def tiles_sql(src: str, w: str, e: str, s: str, n: str, cols: str = "*", nx: int = 3, ny: int = 3) -> str:
    bw, bs, be, bn = BOX
    return (f"SELECT {cols}, CAST(ti * {ny} + tj AS INTEGER) AS tile FROM (SELECT *, unnest("
            f"{tile_span(s, n, bs, (bn - bs) / ny, ny)}) AS tj FROM (SELECT *, unnest("
            f"{tile_span(w, e, bw, (be - bw) / nx, nx)}) AS ti FROM {src} WHERE {e} >= {num(bw)} AND {w} <= {num(be)} "
            f"AND {n} >= {num(bs)} AND {s} <= {num(bn)}))")


_outline_rows = ", ".join(
    f"({k}, {p}, {r}, {i}, {pt[0]}, {pt[1]})"
    for k, polys in enumerate(OUTLINES) for p, poly in enumerate(polys)
    for r, ring in enumerate(poly) for i, pt in enumerate(ring))

# name -> (body, names it needs)
CTES: dict[str, tuple[str, list[str]]] = {
    "pix": (f"""SELECT CAST(l_suppkey % 9 AS INTEGER) AS tile_id, l_orderkey AS scene_id, {shift('l_shipdate')} AS time,
        {_site} AS site, {_lon} AS lon, {_lat} AS lat, l_orderkey % 50 AS px, l_partkey % 43 AS py,
        300 + (l_orderkey * 31 + l_linenumber * 17) % 900 AS blue,
        CASE WHEN {_dead} THEN 0 ELSE 400 + (l_orderkey * 13 + l_partkey * 7) % 1500 END AS green,
        CASE WHEN {_dead} THEN 0 ELSE 300 + (l_partkey * 11 + l_linenumber * 101) % 1500 END AS red,
        CASE WHEN {_dead} THEN 0 ELSE 500 + (l_orderkey * 19 + l_suppkey * 53) % 3500 END AS nir,
        CASE WHEN {_dead} THEN 0 ELSE 500 + (l_orderkey * 19 + l_suppkey * 53) % 3500 END AS nir_narrow,
        CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN {_dead} THEN 0
             ELSE 300 + (l_partkey * 5 + l_orderkey * 3) % 2500 END AS swir1,
        200 + (l_orderkey * 23) % 1800 AS swir2, CAST((l_orderkey + l_linenumber * 3) % 12 AS INTEGER) AS scl,
        ((l_orderkey * 37 + l_linenumber * 11) % 1001) / 1000e0 AS score, l_returnflag AS flag,
        l_linenumber AS line FROM lineitem""", []),
    "refl": ("SELECT * REPLACE (" + ", ".join(f"CAST({b} AS DOUBLE) / 10000e0 AS {b}" for b in K.BANDS)
             + ") FROM pix", ["pix"]),
    "nds": (f"""SELECT *, {nd('nir', 'red')} AS "NDVI", {nd('green', 'nir')} AS "NDWI",
        {nd('green', 'swir1')} AS "MNDWI", {nd('nir', 'swir1')} AS "NDMI",
        CASE WHEN {_evi_d} <> 0 THEN 2.5e0 * (nir - red) / {_evi_d} END AS "EVI",
        CASE WHEN nir + red + 0.5e0 <> 0 THEN 1.5e0 * (nir - red) / (nir + red + 0.5e0) END AS "SAVI",
        {nd('nir', 'swir1')} AS "LSWI",
        CASE WHEN nir + swir1 <> 0 THEN (green + red) / (nir + swir1) END AS "WRI",
        {_tc} AS tc_wetness, CASE WHEN green <> 0 THEN nir / green - 1 END AS "GCVI" FROM refl""", ["refl"]),
    "idx": (f"""SELECT *, ("NDWI" + "NDMI" + "MNDWI") / 3e0 AS wetland_moisture_index,
        CASE WHEN "MNDWI" > 0 AND "NDVI" < 0.2e0 THEN 1e0 ELSE 0e0 END AS water_mask,
        {ix()} AS ix, {iy()} AS iy, {dekad('time')} AS dekad FROM nds""", ["nds"]),
    "img": (f"SELECT tile_id, time, ix, iy, dekad, {avgs(K.INDICES)} FROM idx "
            f"WHERE year(time) BETWEEN {K.YEAR_MIN} AND {K.YEAR_MAX} GROUP BY ALL", ["idx"]),
    "sat": (f"SELECT *, {temporal('dekad')} FROM (SELECT ix, iy, dekad, {avgs(K.INDICES)} FROM img GROUP BY ALL)",
            ["img"]),
    "rawsight": (f"""SELECT CASE WHEN l_orderkey % 37 = 0 OR {_site} % 3 = 0 THEN {_lon} - 5e0 ELSE {_lon} END AS lon, {_lat} AS lat,
        {shift('l_shipdate')} AS day, l_orderkey % 53 <> 0 AS dated,
        CASE WHEN l_orderkey % 41 <> 0 THEN p_name END AS species, p_brand AS brand, p_type AS type,
        CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS cnt,
        CASE WHEN l_orderkey % 29 = 0 AND l_linenumber > 5 THEN 'Insecta' ELSE 'Aves' END AS taxon,
        l_linenumber <= 5 AS is_ebird, l_orderkey, l_quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey""", []),
    "obs": (f"""SELECT {ix()} AS ix, {iy()} AS iy, {dekad('day')} AS dekad, species,
        CASE WHEN is_ebird THEN brand END AS "order", CASE WHEN is_ebird THEN type END AS family,
        CASE WHEN is_ebird THEN cnt ELSE 1 END AS "count", CASE WHEN is_ebird THEN 'ebird' ELSE 'inat' END AS source
        FROM rawsight WHERE dated AND (is_ebird OR taxon = 'Aves')
        AND lon BETWEEN {num(_w)} AND {num(_e)} AND lat BETWEEN {num(_s)} AND {num(_n)}
        AND year(day) BETWEEN {K.YEAR_MIN} AND {K.YEAR_MAX}""", ["rawsight"]),
    "spc": ('SELECT ix, iy, dekad, species, count(*) AS n, sum("count") AS ind FROM obs GROUP BY ALL', ["obs"]),
    "bird": ("""SELECT ix, iy, dekad, CAST(sum(n) AS BIGINT) AS n_observations, count(species) AS n_species,
        CAST(sum(ind) AS BIGINT) AS n_individuals,
        coalesce(-sum(CASE WHEN species IS NOT NULL THEN n / tot * ln(n / tot + 1e-10) END), 0e0) AS shannon_diversity
        FROM (SELECT *, sum(n) FILTER (WHERE species IS NOT NULL) OVER (PARTITION BY ix, iy, dekad) AS tot FROM spc)
        GROUP BY ALL""".replace("n / tot", "CAST(n AS DOUBLE) / CAST(tot AS DOUBLE)").replace("GROUP BY ALL",
        "GROUP BY ix, iy, dekad"), ["spc"]),
    "mi": ("SELECT sat.*, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in K.BIRD_METRICS)
           + " FROM sat LEFT JOIN bird USING (ix, iy, dekad)", ["sat", "bird"]),
    "toporder": ('SELECT "order", count(*) AS n_rows FROM obs WHERE "order" IS NOT NULL GROUP BY 1 '
                 'ORDER BY 2 DESC, 1 LIMIT 10', ["obs"]),
    "prof": (f"""SELECT ix, iy, avg("NDVI") AS "NDVI_mean", {as_list(trend_list())},
        avg(water_mask) AS flood_frequency, {as_list(bird_list())},
        CAST(sum(n_observations) > 0 AS INTEGER) AS has_bird_data,
        CAST({pmod('ix * 7 + iy * 3', 6)} AS INTEGER) AS cluster FROM mi GROUP BY ix, iy""", ["mi"]),
    "cbs": ("""SELECT cluster, count(*) FILTER (WHERE has_bird_data = 1) AS cells_with_data, count(*) AS total_cells,
        median(n_species_mean) FILTER (WHERE has_bird_data = 1) AS median_species,
        median(shannon_diversity_mean) FILTER (WHERE has_bird_data = 1) AS median_diversity,
        median(n_observations_mean) FILTER (WHERE has_bird_data = 1) AS median_observations
        FROM prof GROUP BY cluster""", ["prof"]),
    "suit": (f"""SELECT cluster, {scale('d', '(SELECT min(d) FROM filled)', '(SELECT max(d) FROM filled)')}
        AS habitat_suitability FROM filled""", ["filled"]),
    "filled": ("""SELECT cluster, coalesce(median_diversity, (SELECT median(median_diversity) FROM cbs), 0e0) AS d
        FROM cbs""", ["cbs"]),
    "comp": ("SELECT *, 0e0 + " + " + ".join(
        f'coalesce("{c}_trend", 0e0) * {num(K.TREND_WEIGHTS.get(f"{c}_trend", K.OTHER_TREND_WEIGHT) / _sum_w)}'
        for c in K.TREND_INDICES) + " AS trend_composite FROM prof", ["prof"]),
    "traj": (f"""SELECT *, CASE WHEN trend_composite > (SELECT quantile_cont(trend_composite, 0.75) FROM comp) THEN 'improving'
        WHEN trend_composite < (SELECT quantile_cont(trend_composite, 0.25) FROM comp) THEN 'degrading'
        ELSE 'stable' END AS trajectory,
        {scale('trend_composite', '(SELECT min(trend_composite) FROM comp)', '(SELECT max(trend_composite) FROM comp)')}
        AS trend_score FROM comp JOIN suit USING (cluster)""", ["comp", "suit"]),
    "rawpri": ("""SELECT *, 0.4e0 * (habitat_suitability / 100) + 0.3e0 * (1 - trend_score / 100)
        + 0.3e0 * (habitat_suitability / 100 * (1 - trend_score / 100)) AS raw FROM traj""", ["traj"]),
    "res": (f"""SELECT *, {scale('raw', '(SELECT min(raw) FROM rawpri)', '(SELECT max(raw) FROM rawpri)')}
        AS conservation_priority FROM rawpri""", ["rawpri"]),
    "scn": (f"""SELECT o_orderkey AS scene_id, CAST(o_custkey % 9 AS INTEGER) AS tile_id, {shift('o_orderdate')} AS datetime,
        CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS cloud_cover,
        -90.60e0 + (o_custkey % 12) * 0.01e0 AS west, 29.00e0 + (o_custkey % 7) * 0.01e0 AS south,
        -90.60e0 + (o_custkey % 12) * 0.01e0 + 0.05e0 AS east, 29.00e0 + (o_custkey % 7) * 0.01e0 + 0.05e0 AS north,
        o_orderstatus AS status_code FROM orders""", []),
    "outline": (f"SELECT * FROM (VALUES {_outline_rows}) AS v(kind, poly, ring, seq, fx, fy)", []),
    "aoi_v": ("""SELECT s_suppkey AS aoi_id, poly, ring, seq,
        (-906050 + (((s_suppkey * 7) % 240) % 20) * 103 - CASE WHEN s_suppkey % 11 = 0 THEN 20000 ELSE 0 END
         + fx * (10 + 5 * (s_suppkey % 5))) / 10000e0 AS x,
        (289950 + (((s_suppkey * 7) % 240) // 20) * 91 + fy * (10 + 5 * (s_suppkey % 3))) / 10000e0 AS y
        FROM supplier JOIN outline ON kind = s_suppkey % 4""", ["outline"]),
    "aoi_e": ("""SELECT * FROM (SELECT aoi_id, poly, ring, x AS x1, y AS y1,
        lead(x) OVER (PARTITION BY aoi_id, poly, ring ORDER BY seq) AS x2,
        lead(y) OVER (PARTITION BY aoi_id, poly, ring ORDER BY seq) AS y2 FROM aoi_v) WHERE x2 IS NOT NULL""", ["aoi_v"]),
    "aoi_b": ("SELECT aoi_id, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM aoi_v GROUP BY aoi_id",
              ["aoi_v"]),
    "latest": (f"SELECT ix, iy, {avgs(K.INDICES)} FROM idx GROUP BY ix, iy", ["idx"]),
    "cellpts": (f"SELECT ix, iy, {cx()} AS cell_x, {cy()} AS cell_y FROM (SELECT DISTINCT ix, iy FROM idx)", ["idx"]),
    "hits": ("""SELECT aoi_id, ix, iy FROM cellpts JOIN aoi_b ON cell_x BETWEEN west AND east AND cell_y BETWEEN south AND north
        JOIN aoi_e USING (aoi_id) GROUP BY aoi_id, ix, iy
        HAVING count(*) FILTER (WHERE (y1 > cell_y) <> (y2 > cell_y)
            AND cell_x < (x2 - x1) * (cell_y - y1) / (CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END) + x1) % 2 = 1""",
             ["cellpts", "aoi_b", "aoi_e"]),
    "aoires": ("SELECT aoi_id, res.* FROM hits JOIN res USING (ix, iy)", ["hits", "res"]),
    "scored": (f"""SELECT *, round_even(suitability_probability * 100, 1) AS suitability_pct,
        {suit_class('suitability_probability', 'water_mask')} AS archetype FROM (
        SELECT ix, iy, {cx()} AS cell_x, {cy()} AS cell_y, water_mask,
        ({pmod('ix * 37 + iy * 11', 1001)}) / 1000.7e0 AS suitability_probability,
        round_even(({pmod('ix * 5 + iy * 13', 301)}) / 100e0, 2) AS predicted_diversity FROM latest)""", ["latest"]),
    "aoiscored": ("SELECT aoi_id, scored.* FROM hits JOIN scored USING (ix, iy)", ["hits", "scored"]),
    "train": ("SELECT *, CASE WHEN n_observations > 0 THEN 1 ELSE 0 END AS label FROM mi", ["mi"]),
    "cellstat": ("""SELECT ix, iy, count(*) AS n_dekads, sum(n_observations) AS total_obs,
        count(*) FILTER (WHERE n_observations > 0) AS n_positive FROM mi GROUP BY ix, iy""", ["mi"]),
    "negs": ("""SELECT mi.* FROM mi JOIN cellstat USING (ix, iy) WHERE n_observations = 0
        AND (n_positive > 0 OR (total_obs = 0 AND n_dekads >= 10))""", ["mi", "cellstat"]),
    "now": (f"SELECT DATE '{NOW}' AS today", []),
}


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order)
    return f"WITH {head}\n{body}" if order else body


def hashed(seed: int, *cols: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"
