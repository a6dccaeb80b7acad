"""Personal data: base spans against Python's expressions, bootstrapped spans, masking, plan."""

import hashlib
import re

import pytest

from marshline.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(int(c) for c in reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def spans(text):
    found = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


TEXTS = [None, "", "a@b.c+x@y.zz, q@r a@b.c@d.e _%a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 é 10.0.0.1 1..2.3.4", "4111 1111 1111 1111 x 4111-1111-1111-1112 " + "1" * 3000,
         "+1 (632) 555-4827 +4930 123456 +12 +1+1+1 +123456789012345678 5", "a" * 20000 + "@x 😀é x@y.zz", "9" * 20000, " ".join(f"10.0.{i}.1" for i in range(400)), "1 " * 5000,
         "٣٤ 1٢.2.3.4 é@b.co x\x0b@y.z\n4111\n1111"]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1), (None, TEXTS[3], 1)], "doc_id long, text string, n_ip int")
    got = pii.report(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = spans(TEXTS[3 if r["doc_id"] is None else r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in BASE] == [want.count(f"{k}:") for k in BASE]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii.report(df.limit(0)).count() == 0


CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "340000000000009", "30000000000004"]


@pytest.fixture(scope="module")
def cued(spark):
    rows = [(i, f"her card number {c} and one day in may 1999 or in may 2001") for i, c in enumerate(CARDS)]
    rows += [(9, "the Card  number 9911-22AB, was lost"), (10, "my 12345 the thing in may 1234"), (11, None), (9, "the Card  number 9911-22AB, was lost")]
    rows += [(20 + i, f"go to the x{i} " * 3 + f"go to u{i}@x.org") for i in range(5)]  # a pattern of seeds that mostly precedes other words
    rows += [(30, "go to 5577-AB")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_of_seeds_find_identifiers(cued):
    got = {r["doc_id"]: r["spans"] for r in pii.report(cued).collect()}
    assert got[9] == "id:17:26" and got[10] == "" and got[30] == "" and got[0] == "card:16:35" and pii.report(cued).count() == 15


def test_masking(cued):
    wide = cued.selectExpr("*", "'k' as _h", "1 as s")
    got = pii.redact(wide)
    assert got.columns == wide.columns and got.count() == 15
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert rows[9] == "the Card  number [ID], was lost" and rows[11] is None and rows[20].endswith("go to [EMAIL]") and rows[1].startswith("her card number [CARD] and")


def test_main_path_is_native(cued):
    plan = pii.report(cued)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
