"""Numbered queries against SQL on a small folder, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

from conftest import SF

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from marshline.llm import queries  # noqa: E402


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare.compare(spark, compare.duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(900001, None, None, None, None), (900002, "1234 !!", "en", "s", 7), (900003, "", "en", "s", 0)], docs.schema)
    again = docs.where("doc_id = 7")
    docs = docs.unionByName(more).unionByName(again)
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        seen[name] = (docs, out)
        docs = out
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
    ids = {n: ([r[0] for r in a.select("doc_id").collect()], [r[0] for r in b.select("doc_id").collect()]) for n, (a, b) in seen.items()}
    a, b = ids["language_id"]
    assert set(a) - set(b) == {900001, 900002, 900003}
    a, b = ids["near_dedup"]
    assert len(b) == len(set(b)) and a.count(7) == 2 and b.count(7) == 1
    texts = {r["doc_id"]: set(zip(*[r["text"].split()[i:] for i in range(5)])) for r in seen["near_dedup"][0].collect()}
    for x in set(a) - set(b):  # each one that goes is near to one that was there before
        assert any(y < x and len(texts[x] & texts[y]) >= 0.7 * len(texts[x] | texts[y]) for y in texts)
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in seen["decontaminate"])
    assert {i for i, t in before.items() if any(p in t for p in benchmark)} == set(before) - set(after)
    assert all(r["n_chars"] == len(r["text"]) and "@mail" not in r["text"] for r in seen["pii"][1].collect())
    assert set(ids["packing"][0]) == set(ids["packing"][1])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() >= 150


def test_documents_stay_where_no_language_is_known(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    more = spark.createDataFrame([(1, "12 !!", None, "s", 5), (2, None, None, "s", 0), (3, "\u4e2d", None, None, None)], docs.schema)
    left = [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), SF).collect()]
    assert len(left) == docs.where(docs["text"].rlike(r"\p{L}")).count() + 1 and corpus_pipeline.language_id(spark, docs.limit(0), SF).count() == 0
