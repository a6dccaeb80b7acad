"""Manifests against a plain recomputation, with nulls, repeated rows, clashing names and other arities."""

import hashlib
import zlib

import pytest

from marshline.llm import merkle
from marshline.llm.queries import QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, arity):
    """The root, and the path of each leaf as (left, right) pairs."""
    paths, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, up_owners = [], []
        for a in range(0, len(level), arity):
            run = level[a:a + arity]
            for j in range(len(run)):
                for i in owners[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(h(*run))
            up_owners.append(sum(owners[a:a + arity], []))
        level, owners = up, up_owners
    return level[0] if level else None, paths


def expected(rows, arity):
    """(doc_id, leaf, subroot, root, path) of rows given as in FIELDS."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = (own, *tree([d for _, d in own], arity))
    root, tops = tree([trees[g][1] for g in names], arity)
    return sorted((str(i), d, trees[g][1], root, p + tops[k]) for k, g in enumerate(names) for (i, d), p in zip(trees[g][0], trees[g][2]))


def rows_with_everything():
    rows = [(i, "hot", "en", i % 7, f"Text {i} Ä") for i in range(300)] + [(5, "hot", "en", 5, "Text 5 Ä")] * 40  # repeated rows
    rows += [(None, "hot", None, None, None)] * 3 + [(None, None, "de", 1, "")] + [(1, None, "de", 1, "x" * 200_000)]
    rows += [(7, "", "en", 0, "B"), (8, "b", "en", 0, "C"), (9, "é", "en", 0, "D"), (10, "Z", "en", 0, "E"), (10, "Z", "en", 0, "F"), (10, "Z", "fr", 0, "E")]
    return rows + [(1000 + i, f"s{i}", "en", 0, "one") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    order = [FIELDS.index(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    return spark.createDataFrame([tuple(r[i] for i in order) for r in rows_with_everything()], KIND)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest(docs, arity):
    wide = docs.selectExpr("*", "1 as g", "2 as idx", "'x' as digest", "3 as n", "4 as _order", "'p' as path", "text as root")  # names that clash
    rows = merkle.manifest(wide, FIELDS, arity=arity)
    got = sorted((str(r["doc_id"]), r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), [(p["left"].hex(), p["right"].hex()) for p in r["path"]]) for r in rows.collect())
    assert got == expected(rows_with_everything(), arity)
    assert rows.where(merkle.fold(rows["leaf"], rows["path"]) != rows["root"]).count() == 0


def write(spark, df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return QUERIES["op13_merkle_manifest"](spark, str(path)).collect()


def test_query(spark, docs, tmp_path):
    got = write(spark, docs, tmp_path)
    want = expected(rows_with_everything(), 16)
    texts = {leaf(r): r for r in rows_with_everything()}
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == sorted(
        (i, d, s, root, h(*[x for p in path for x in p])) for i, d, s, root, path in want)
    for r in got:
        doc_id, *_, text = texts[r["leaf"]]
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None and text != "".join(c.lower() if c.isascii() else c for c in text)
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    assert any(not r["verified"] for r in got)


@pytest.mark.parametrize("rows", [[], [(3, "Only", "en", "s", 4)], [(None, None, None, None, None)]])
def test_few_rows(spark, tmp_path, rows):
    got = write(spark, spark.createDataFrame(rows, KIND), tmp_path)
    assert len(got) == len(rows)
    for r in got:  # a lone leaf is its source's root and the whole tree's
        assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h()


def test_equal_rows_of_one_group_are_dealt_to_many_tasks(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(merkle, "stage", lambda df, name: staged.append(df.persist()) or staged[-1])
    rows = spark.range(4000).selectExpr("'hot' as g", "cast(null as long) as _order", "unhex(sha2('same', 256)) as digest")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = merkle.numbered(rows, ["_order", "digest"])
        assert sorted(r["idx"] for r in placed.collect()) == list(range(4000))
        sizes = [r["count"] for r in staged[0].groupBy((staged[0]["_pos"] / 2**33).cast("long").alias("p")).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_node_a_run_is_needed(docs):
    with pytest.raises(ValueError):
        merkle.manifest(docs, FIELDS, arity=1)
