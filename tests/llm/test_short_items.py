"""Benchmark items of few words, and of scripts written without blanks, in the query and in the pipeline's stage."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from marshline.llm import decontaminate
from marshline.llm.queries import QUERIES

ITEMS = [(0, "What is the capital of France?"), (1, "中国的首都是哪里？"), (2, "日本の首都はどこですか"), (3, "เมืองหลวงของประเทศไทยคืออะไร"), (4, "Yes"), (5, "..."), (6, None),
         (7, "水"), (8, "the one long item that has more than eight words in it"), (9, "𠀀𠀁𠀂")]
DOCS = [(0, "He asked: what is the Capital of France? Paris.", {(0, 0, 8)}), (1, "请问中国的首都是哪里呢", {(1, 0, 10)}), (2, "問題、日本の首都はどこですか。答え", {(2, 0, 13)}),
        (3, "คำถามเมืองหลวงของประเทศไทยคืออะไรครับ", {(3, 0, 33)}), (4, "yes yes, YES", {(4, 0, 1)}), (5, "What is the capital of Spain? yesterday", set()), (6, "中国的首都不是这里", set()),
        (7, "xx水yy the one long item that has more THAN nine words in it", {(7, 0, 2), (8, 1, 15)}), (8, None, set()), (9, "... ?", set()), (10, "a𠀀𠀁𠀂b", {(9, 0, 4)}),
        (11, "中国的首都，是那里", {(1, 1, 8)}), (12, "水 水 " * 500 + "yes", {(7, 0, 1), (4, 0, 1001)})]


def test_no_item_is_dropped(spark, tmp_path):
    spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t, _ in DOCS], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["end_word"]) for r in QUERIES["op1_edit_leaks"](spark, str(tmp_path)).collect()}
    assert got == {(i, *x) for i, _, found in DOCS for x in found}
    left = corpus_pipeline.decontaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == {i for i, _, found in DOCS if not found}


def test_code_points_as_words():
    texts = pa.array(["zz", "ab中é文c", "", "ไทย", "한국어 텍스트", "中", "q"]).slice(1)
    words, starts = decontaminate.comparable(texts)
    assert np.diff(starts).tolist() == [5, 0, 3, 2, 1, 1] and words[starts[4]] == words[1]


def test_the_rate_alone_sets_the_edits(spark):
    """Items of seven words may differ by one at 0.15; found against all alignments of small texts."""
    def distance(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            row, old = [i], row
            for j, b in enumerate(text, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        return min(row)

    rng = np.random.default_rng(2)
    items = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in range(1, 22)]
    docs = [[f"w{x}" for x in rng.integers(0, 9, 10)] + [w if rng.random() > 0.12 else "zz" for w in item] for item in items for _ in range(3)] + [[]]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for rate in (0.15,) for r in decontaminate.leaks(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id int, text string"),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string"), error_rate=rate, min_words=1).collect()}
    want = {(i, j, distance(x, d)) for i, d in enumerate(docs) for j, x in enumerate(items) if distance(x, d) <= int(0.15 * len(x)) and len(d)}
    assert got == want and any(k == 7 - 1 for _, k, _ in want)


def test_budget_by_rate_and_by_pieces():
    for m in range(1, 300):
        assert decontaminate.budget(m, 0.15) == min(int(m * 0.15), m - 1)
        assert decontaminate.budget(m, 0.4, 4) == max(0, min(int(m * 0.4), m // 4 - 1))
