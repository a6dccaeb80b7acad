"""Fixed values that define results: bounds, names, thresholds and texts."""

# --- fixed values: study area and grid -------------------------------------
AOI_BOUNDS = (-90.628342, 28.927421, -89.067224, 30.106372)  # west, south, east, north
CELL_KM = 1.0
KM_PER_DEG_LON = 111.32
KM_PER_DEG_LAT = 110.57
BUFFER_KM = 5.0
BUFFER_KM_PER_DEG = 111.0
M_PER_DEG = 111_000.0
YEAR_MIN, YEAR_MAX = 2020, 2025
TILES_X = TILES_Y = 3

# --- fixed values: bands and indices ----------------------------------------
REFLECTANCE_SCALE = 10000.0
REQUIRED_BANDS = ["blue", "green", "red", "nir", "swir1", "swir2"]
BANDS = ["blue", "green", "red", "nir", "nir_narrow", "swir1", "swir2"]
BAND_ALIASES = {
    "B02": "blue", "B03": "green", "B04": "red", "B08": "nir",
    "B8A": "nir_narrow", "nir08": "nir_narrow",
    "B11": "swir1", "swir16": "swir1",
    "B12": "swir2", "swir22": "swir2",
}
COORD_ALIASES = [("longitude", "x"), ("lon", "x"), ("latitude", "y"), ("lat", "y"), ("t", "time")]
INDICES = [
    "NDVI", "NDWI", "MNDWI", "NDMI", "EVI", "SAVI", "LSWI", "WRI",
    "wetland_moisture_index", "water_mask", "tc_wetness", "GCVI",
]
TC_WETNESS = {
    "blue": 0.1509, "green": 0.1973, "red": 0.3279,
    "nir": 0.3406, "swir1": -0.7112, "swir2": -0.4572,
}

# --- fixed values: scene classification policies ----------------------------
SCL_KEEP = {"live": [4, 5, 6, 7, 11]}
SCL_DROP = {"prefetch": [0, 1, 8, 9], "composite": [0, 1, 2, 3, 8, 9, 10]}
SCL_CLOUD = [8, 9, 10]

# --- fixed values: calendar --------------------------------------------------
SEASON_MONTHS = {
    "spring_migration": [3, 4, 5],
    "breeding": [6, 7],
    "fall_migration": [8, 9, 10],
    "winter": [11, 12, 1, 2],
}
SEASONS = list(SEASON_MONTHS)
GROWING = ["spring_migration", "breeding"]
DORMANT = ["fall_migration", "winter"]
DAYS_PER_YEAR = 365.25

# --- fixed values: sightings --------------------------------------------------
SIGHTING_ALIASES = {
    "lat": ["decimallatitude", "decimal_latitude", "latitude"],
    "lon": ["decimallongitude", "decimal_longitude", "longitude"],
    "date": ["eventdate", "event_date", "observed_on", "date"],
    "species": ["species"],
    "count": ["individualcount", "individual_count"],
    "order": ["order"],
    "family": ["family"],
}
SIGHTING_REQUIRED = ["lat", "lon", "date"]
INAT_COLUMNS = ["latitude", "longitude", "observed_on", "scientific_name", "iconic_taxon_name"]
BIRD_METRICS = ["n_observations", "n_species", "n_individuals", "shannon_diversity"]
SHANNON_EPS = 1e-10
TOP_ORDERS = 10

# --- fixed values: profiles, scoring, models ----------------------------------
TREND_INDICES = ["NDVI", "NDWI", "NDMI", "wetland_moisture_index", "water_mask", "EVI"]
DAILY_TREND_INDICES = ["NDVI", "NDWI", "NDMI", "wetland_moisture_index", "water_mask"]
AMPLITUDE_INDICES = ["NDVI", "NDWI", "EVI"]
TREND_WEIGHTS = {
    "NDVI_trend": 0.30, "EVI_trend": 0.20, "NDMI_trend": 0.15,
    "wetland_moisture_index_trend": 0.15, "NDWI_trend": 0.10, "water_mask_trend": 0.10,
}
OTHER_TREND_WEIGHT = 0.05
PRIORITY_WEIGHTS = (0.40, 0.30, 0.30)
PCA_VARIANCE = 0.95
MIN_CLUSTERS, MAX_CLUSTERS = 4, 20
NEGATIVE_RATIO = 2
MIN_DEKADS_FOR_NEGATIVE = 10
INTERACTIONS = {
    "NDVI_x_NDWI": ("NDVI", "NDWI"),
    "NDVI_x_MNDWI": ("NDVI", "MNDWI"),
    "EVI_x_NDMI": ("EVI", "NDMI"),
    "GCVI_x_wetmoist": ("GCVI", "wetland_moisture_index"),
}
RATIOS = {"veg_water_ratio": ("NDVI", "MNDWI"), "moisture_per_veg": ("NDMI", "NDVI")}
RATIO_OFFSET = 0.01
SQUARES = {"NDVI_sq": "NDVI", "NDWI_sq": "NDWI", "EVI_sq": "EVI"}
MODEL_FEATURES = INDICES + list(INTERACTIONS) + list(RATIOS) + list(SQUARES) + [
    "month_sin", "month_cos", "doy_sin", "doy_cos",
]
CLASSIFIER = {"trees": 500, "depth": 5, "step": 0.05, "subsample": 0.8, "min_leaf": 20}
REGRESSOR = {"trees": 300, "depth": 4, "step": 0.05, "subsample": 0.8, "min_leaf": 15}
MIN_REGRESSION_ROWS = 50

# Lower edges of the probability bands, best first.
PROBABILITY_BANDS = [
    ("Highly suitable", 0.7, 1.0),
    ("Moderately suitable", 0.4, 0.7),
    ("Marginal", 0.15, 0.4),
    ("Unsuitable", 0.0, 0.15),
]
OPEN_WATER = "Open water"

# --- fixed values: scene search ------------------------------------------------
LIVE_MAX_CLOUD, LIVE_DAYS = 30, 30
PREFETCH_SCENE_CLOUD, PREFETCH_AOI_CLOUD, PREFETCH_DAYS = 40, 15, 180

# --- fixed values: report texts --------------------------------------------------
TREND_STABLE = "Stable"
TREND_TEXT = "%s has %s ~%d%% over %d years"
TREND_EPS = 0.005
TREND_NO_DATA = "No data"
NOTABLE_NONE = "No significant changes detected."
NOTABLE_TEXT = "%s is the most significant change — %s by ~%d%% over %d years."
DIVERSITY_LEVELS = [(2.0, "High"), (1.0, "Moderate"), (0.3, "Low")]
DIVERSITY_LOWEST = "Very low"
DIVERSITY_NO_DATA = "No survey data"
CONDITION_TEXT = {
    "degrading": "This area is predominantly degrading — %d%% of the landscape shows declining trends.",
    "improving": "This area is mostly improving — %d%% of the landscape shows positive trends.",
    "stable": "This area is largely stable — %d%% of the landscape shows steady conditions.",
}
COVERAGE_WELL = "Well surveyed — %d%% of this area has bird observation data"
COVERAGE_MODERATE = "Moderately surveyed — %d%% coverage. Deeper analysis recommended."
COVERAGE_SPARSE = "Sparsely surveyed — only %d%% coverage. Results rely heavily on satellite indicators."
COVERAGE_NONE = "No bird surveys on record. Assessment based entirely on satellite data."
SCORE_STRONG = "This area shows strong habitat potential — %d%% of cells are highly suitable for avian species."
SCORE_MIXED = "Mixed habitat quality — %d%% highly suitable and %d%% moderately suitable."
SCORE_LIMITED = "Limited habitat potential — %d%% of the area is unsuitable, likely open water or bare ground."
SCORE_MODERATE = "Moderate habitat potential — mean suitability probability of %d%%."
FLOOD_LABELS = [(0.7, "Persistently flooded"), (0.4, "Seasonally flooded"), (0.15, "Intermittently wet")]
FLOOD_LOWEST = "Dry upland"
VEGETATION_LABELS = [(0.5, "dense vegetation"), (0.25, "moderate vegetation"), (0.05, "sparse vegetation")]
VEGETATION_LOWEST = "bare/water"
GREENING, BROWNING, GREENING_EPS = "(greening)", "(browning)", 0.01

# --- fixed values: texts read as missing in delimited sources ----------------------
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
