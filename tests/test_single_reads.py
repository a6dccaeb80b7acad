"""Values that are dear to read are read once a row, and reading them once changes nothing."""

import re

import numpy as np
from pyspark.sql import functions as F

from catalog import fixtures as X
from marshline import constants as K
from marshline.functions import casting as A
from marshline.operators import sightings as B
from marshline.plans import habitat as H

from conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_read_once(spark):
    plan = _plan(B.bird_metrics(B.clean_ebird(X.ebird_raw(spark, SF), X.GRID)))
    tests = [line for line in plan.splitlines() if re.search(r"\bFilter\b", line)]
    assert tests and not any("try_cast" in t or "gettimestamp" in t for t in tests)
    # latitude, longitude, date and count
    assert plan.count("try_cast(") == 4


def test_bad_coordinates_and_dates_are_dropped(spark):
    raw = spark.createDataFrame([
        (" 29.5 ", "-90.1", "2024-05-17", "a", "2"), ("29.5", "-90.1", "2024/05/17", "a", "NaN"), ("29.5", "-90.1", " 05/17/2024 ", "a", None),
        ("x", "-90.1", "2024-05-17", "b", "1"), (None, "-90.1", "2024-05-17", "b", "1"), ("NaN", "-90.1", "2024-05-17", "b", "1"),
        ("29.5", "10", "2024-05-17", "b", "1"), ("29.5", "-90.1", "17.05.2024", "b", "1"), ("29.5", "-90.1", "1/2/3", "b", "1"),
        ("29.5", "-90.1", None, "b", "1"), ("29.5", "-90.1", "1999-05-17", "b", "1")],
        "lat string, lon string, date string, species string, count string")
    named = raw.toDF("decimalLatitude", "decimalLongitude", "eventDate", "species", "individualCount")
    rows = B.clean_ebird(named, X.GRID).collect()
    assert sorted(r["count"] for r in rows) == [1, 1, 2]
    assert {r["species"] for r in rows} == {"a"} and {str(r["dekad"]) for r in rows} == {"2024-05-11"}


def test_formats_are_tried_on_texts_that_can_match(spark):
    texts = ["2024/03/01", "03/01/2024", "2024-03-01", "20240301", "not-a-date", "a/b", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.coalesce(F.trim("t").try_cast("date"), *[F.try_to_timestamp(F.trim("t"), F.lit(f)).cast("date") for f in A.DATE_FORMATS])
    assert all(r.a == r.b for r in df.select(A.coerce_date(F.col("t")).alias("a"), plain.alias("b")).collect())
    # A text without a slash meets no format with one; formats without slashes and those with optional parts see every text.
    assert _plan(df.select(A.coerce_date(F.col("t")))).count("Contains") == len(A.DATE_FORMATS)
    more = ["yyyyMMdd", "yyyy[/MM]/dd"]
    assert "Contains" not in _plan(df.select(A.coerce_date(F.col("t"), more)))
    assert [str(r[0]) for r in df.where("i = 3").select(A.coerce_date(F.col("t"), more)).collect()] == ["2024-03-01"]


def test_names_with_dots_survive(spark):
    df = spark.createDataFrame([(1, "2", 3)], ["a.b", "n", "c"]).withColumn("n", F.col("n").try_cast("double"))
    assert A.read_once(df, "n").collect() == [(1, 3, 2.0)]


def test_pixels_carry_no_dekad(spark):
    plan = _plan(H.cell_dekads(X.pixels(spark, SF), X.GRID))
    keys = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert "dekad" in keys[0] and "dekad" not in keys[-1].split("]")[0]


def test_sparse_pixels_are_dealt_once_as_bands(spark):
    """Few pixels per image and cell: bands move, not a sum and a count of every index; the means are those of the other form."""
    px = B.filter_years(X.pixels(spark, SF), date="time")
    got = H.cell_dekads(px, X.GRID, sparse=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "avg" not in plan[plan.index("Exchange "):]
    key = lambda r: (r["ix"], r["iy"], r["dekad"])
    for policy in (None, "composite"):
        a = sorted(H.cell_dekads(px, X.GRID, policy=policy, sparse=True).collect(), key=key)
        b = sorted(H.cell_dekads(px, X.GRID, policy=policy).collect(), key=key)
        assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 1000
        for c in K.INDICES:
            np.testing.assert_allclose(np.array([r[c] for r in a], float), np.array([r[c] for r in b], float), rtol=1e-9, atol=1e-12)
    # the calendar features and sightings join without another exchange of pixels
    whole = X.model_input(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert whole.count("REPARTITION_BY_COL") == 1
