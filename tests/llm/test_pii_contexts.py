"""The words before a match come from the text, whatever they hold."""

import re

import pytest
from pyspark.sql import functions as F

from marshline.llm import pii
from marshline.llm.queries import QUERIES


def test_pattern_that_holds_a_digit(spark, tmp_path):
    rows = [(i, f"the ipv4 address 10.0.0.{i} and more") for i in range(5)] + [(i, f"my line2 phone +1 632 555 482{i} ok") for i in range(5, 9)]
    rows += [(10, "the ipv4 address 99-4411-AB was lost"), (11, "item 12 of line2 phone X77-12"), (12, "the ipv6 address 99-4411-AB")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in QUERIES["op7_context_bootstrap"](spark, str(tmp_path)).collect()}
    assert got[10] == "id:17:27" and got[11] == "id:23:29" and got[12] == "" and got[0] == "ip:17:25"
    masked = {r["doc_id"]: r["text"] for r in pii.redact(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert masked[10] == "the ipv4 address [ID] was lost"


@pytest.mark.parametrize("pattern", ["[0-9]+", pii._TOKEN])
def test_characters_before_a_match(spark, pattern):
    texts = ["", "1", "é1 2 x33", " ".join(f"é{i} w" for i in range(700)), "a" * 200 + " 7" + "b" * 71 + " 8", "1 " * 129]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pii.found(F.col("t"), pattern).alias("x"))
    plain = pattern.replace("*+", "*")
    for r in df.collect():
        want = [(m.start(), m.end(), m[0], r["t"][max(m.start() - 70, 0):m.start()]) for m in re.finditer(plain, r["t"])]
        assert [tuple(x) for x in r["x"]] == want


def test_words_of_any_length_and_distance(spark):
    """Contexts against Python's own split of the text before each match."""
    long = "w" * 90
    texts = ["", "x 11aa", f"{long} {long}z 22bb", f"one {long} 33cc", f"A  B{' ' * 200}44dd tail", f"{long}{long} 5e5e", "p q\n\t" * 40 + "66ff", f"a é{long} 77 88gg"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in pii.scan(df, "doc_id", "text").collect():
        for x in r["_tokens"]:
            before = texts[r["_id"]][:x["s"]].lower().split()
            assert (x["c"]["w1"], x["c"]["w2"]) == tuple(before[-2:]), x
        assert len(r["_tokens"]) == (0, 0, 1, 1, 1, 0, 1, 1)[r["_id"]]


def test_the_token_rule_is_a_parameter(spark):
    rows = [(i, f"the ipv4 address 10.0.0.{i} and more") for i in range(5)] + [(9, "the ipv4 address x7 here")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    added = {p: {r["_id"]: len(r["_added"]) for r in pii.personal_data(df, identifier=p).collect()}[9] for p in (pii.IDENTIFIER, "[0-9]")}
    assert added == {pii.IDENTIFIER: 0, "[0-9]": 1}
