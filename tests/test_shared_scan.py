"""The scan that model queries share: names are looked up for cleaned sightings, and tasks after a shuffle stay small."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from marshline.operators import sightings as B
from marshline.session import tune

from conftest import SF


def _rows(df) -> list:
    return sorted(map(repr, df.select(*B._OUT).collect()))


def test_parts_are_joined_once_and_last(spark):
    got = X.observations(spark, SF)
    want = B.union_sightings(B.clean_ebird(X.ebird_raw(spark, SF), X.GRID), B.clean_inat(X.inat_raw(spark, SF), X.GRID))
    assert _rows(got) == _rows(want) and got.count() > 1000
    assert got.dtypes == want.select(*got.columns).dtypes
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(lines) if "Join Inner" in line]
    # every text is read, and every line from outside or without a date dropped, below the one join
    assert len(joins) == 1 and all(i > joins[0] for i, line in enumerate(lines) if "Generate stack" in line or "Filter" in line)


def test_kept_columns_pass_through(spark):
    raw = spark.createDataFrame([("29.5", "-90.1", "2024-05-17", 7), ("29.5", "-90.1", "never", 8)], "latitude string, longitude string, observed_on string, k int")
    kept = B.clean_ebird(raw, X.GRID, keep=["k"])
    assert [r["k"] for r in kept.collect()] == [7] and kept.columns == [*B._OUT, "k"]
    inat = raw.withColumns({"scientific_name": F.lit("a"), "iconic_taxon_name": F.lit("Aves")})
    assert [r["k"] for r in B.clean_inat(inat, X.GRID, keep=["k"]).collect()] == [7]
    assert "k" not in B.clean_ebird(raw, X.GRID).columns


def test_partitions_after_a_shuffle(spark):
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"]
    try:
        tune(spark)
        assert [spark.conf.get(n) for n in names] == ["16m", "16m"]
        tune(spark, partition=None)
        assert [spark.conf.get(n) for n in names] == ["67108864b", "0b"]
    finally:
        tune(spark)
