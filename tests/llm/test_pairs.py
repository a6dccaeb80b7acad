"""Near-duplicates, repeats, vectors, leaks and revisits: against brute force."""

import datetime as dt
import hashlib
import itertools
import re

import numpy as np
import pytest

from marshline.llm import decontaminate, graph, multiindex, repeats, sketch, warc


def closed(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, k):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [[str(x) for x in rng.choice(words, n)] for n in (3, 30, 60, 90, 120)]
    texts = [None, "", " \n ", "One", "one", "one two", "É one", "é one"]
    for own in base:
        texts.append(" ".join(own))
        for _ in range(14):  # from near to far copies, many of them linked to some and not to others
            new = list(own)
            for i in rng.choice(len(own), int(rng.integers(0, max(2, len(own) // 8))), replace=False):
                new[i] = str(rng.choice(words))
            texts.append(("  " if rng.random() < 0.2 else " ").join(new).upper() if rng.random() < 0.2 else " ".join(new))
    return list(enumerate(texts))


@pytest.mark.parametrize("k", [2, 5])
def test_sketches_find_all_links(spark, copies, k, monkeypatch):
    monkeypatch.setattr(sketch, "BLOCK_SHINGLES", 500)  # families of several blocks
    sets = {i: shingle_set(t, k) for i, t in copies}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(sets, links)
    rows = [(i, t, 1) for i, t in copies] + [(copies[20][0], copies[20][1], 2), (None, copies[9][1], 3)]
    got = sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int"), k=k).collect()
    assert len(got) == len(rows) and len(links) > 50
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])


def test_sketch_of_an_empty_table(spark):
    assert sketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    s = sketch.sketches(np.concatenate([a, b, a[:1]]), np.array([0, 2000, 4000, 4001]), 512)
    assert (s != np.uint64(2 ** 64 - 1)).all() and abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.08


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 40, 40, 90)]
    assert (sketch.intersections(sets) >= 0).all()
    for i, j in itertools.combinations(range(5), 2):
        assert sketch.intersections(sets)[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, i) for i in range(301, 400)]
    df = spark.createDataFrame(links + [(5, 5), (None, 3)], "a long, b long")
    want = closed({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == {n: want[n] for n in linked}


def brute_repeats(docs, window):
    first = {}
    for i, t in docs:
        w = words_of(t)
        for p in range(len(w) - window + 1):
            first[tuple(w[p:p + window])] = min(i, first.get(tuple(w[p:p + window]), i))
    out = {}
    for i, t in docs:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,seed", [(50, 12), (10, 3), (5, 5)])
def test_repeats(spark, window, seed):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)] + ["É", "ok!", "x" * 200]
    say = lambda n: [str(x) for x in rng.choice(words, n)]
    shared = [say(n) for n in (49, 50, 51, 90, 200)]
    docs = [(0, None), (1, ""), (2, " \t ")]
    for i in range(3, 60):
        parts = [x for _ in range(int(rng.integers(1, 4))) for x in (say(int(rng.integers(0, 40))), shared[rng.integers(0, 5)][int(rng.integers(0, 5)):])]
        docs.append((i, ("\n" if i % 5 else " \x0b ").join(" ".join(p) for p in parts)))
    docs += [(60, docs[10][1]), (61, docs[10][1]), (62, "a " * 300), (63, "a " * 200)]
    want = brute_repeats(docs, window)
    rows = [(i, t, "q") for i, t in docs] + [(60, docs[10][1], "q"), (None, docs[10][1], "q")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, _at string"), window=window, seed=seed).collect()
    assert len(got) == len(rows) and sum(n > 0 for _, n, _ in want.values()) > 30
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        else:
            assert r["n_removed"] == 0
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24))
    for i in range(300, 500):
        x[i] = x[i % 30] + rng.normal(size=24) * 0.12  # groups around the threshold
    x[500:520] = x[7]
    x[520:530] = 3 * x[8]
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    rows += [(700, None, "l"), (701, [0.0] * 24, "l"), (702, [float("nan")] * 24, "l"), (703, [None] * 24, "l"), (704, [], "l"), (705, [1.0, 2.0], "l"), (706, [2.0, 4.0], "l")]
    got = multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    links = [(a, b) for a, b in itertools.combinations(range(700), 2) if cos[a, b] >= 0.95]
    assert len(links) > 1000 and len(got) == 707
    found = sum(r["n_links"] for r in got if r["vec_id"] < 700) / 2
    assert 0.99 * len(links) <= found <= len(links)
    want = closed(range(700), links)
    assert np.mean([r["component_id"] == want[r["vec_id"]] for r in got if r["vec_id"] < 700]) > 0.98
    odd = {r["vec_id"]: r for r in got if r["vec_id"] >= 700}
    assert all(odd[i]["n_links"] == 0 and odd[i]["kept"] for i in range(700, 705)) and odd[706]["component_id"] == 705 and odd[705]["n_links"] == 1
    assert multiindex.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, v in enumerate(text, 1):
            row[j] = min(last[j - 1] + (w != v), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bit_vectors_give_edit_distances():
    rng = np.random.default_rng(6)
    for _ in range(200):
        item, text = rng.integers(0, 4, int(rng.integers(1, 90))).tolist(), rng.integers(0, 4, int(rng.integers(0, 60))).tolist()
        assert decontaminate.best_match(item, text)[0] == brute_distance(item, text)


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate((8, 12, 20, 33, 70, 90, 7))] + [(7, None), (8, "")]
    docs = [(0, None), (1, ""), (2, "w1")]
    for i in range(3, 80):
        own = items[i % 7][1].split()
        for _ in range(int(rng.integers(0, 1 + len(own) // 5))):
            p = int(rng.integers(0, len(own)))
            own[p:p + int(rng.integers(0, 2))] = rng.choice(words, int(rng.integers(0, 2))).tolist()
        docs.append((i, " ".join([*rng.choice(words, 20), *own, *rng.choice(words, 20)]).upper().replace(" ", ", " if i % 3 else "\n")))
    clean = lambda t: re.sub(r"[^0-9a-z]", " ", (t or "").lower()).split()
    want = {}
    for (d, t), (i, b) in itertools.product(docs, items):
        m = len(clean(b))
        if m >= 8:
            k, n = decontaminate.budget(m, 0.15, 4), brute_distance(clean(b), clean(t))
            if n <= k:
                want[d, i] = n
    df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(5, docs[5][1], 0)], "doc_id long, text string, distance int")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    for block in (8 << 20, 100):  # one block, and several
        got = decontaminate.leaks(df, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want and len(want) > 30
        left = {r["doc_id"] for r in decontaminate.without_leaks(df, bench, block_chars=block).collect()}
        assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.without_leaks(df, bench.limit(0)).count() == len(docs) + 1


def test_revisits(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "http://www.A.org:80/x/", at(1), 200, {"ETag": '"a"', "Content-Length": "5", "X": "1"}), (2, "https://a.org/x?utm_source=q", at(3), 200, {"ETag": '"b"'}),
            (3, "HTTPS://A.org:443/x", at(3), 200, {"etag": '"c"', "Date": "old"}), (4, "https://a.org/x#f", at(2), 304, {"etag": 'W/"a"', "content-length": "0", "DATE": "new"}),
            (5, "https://a.org/x", at(3), 304, {"ETag": '"a"'}), (6, "https://a.org/x", at(4), 304, {"ETag": '"zzz"'}), (7, "https://a.org/x", at(5), 304, None),
            (8, "https://a.org/y", at(5), 304, None), (9, None, at(5), 304, {}), (10, "https://a.org/x", None, 304, {}), (11, "https://a.org/x", at(1), 304, {}),
            (7, "https://a.org/x", at(5), 304, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "record_id long, url string, time timestamp, status int, headers map<string,string>, outcome int")
    for size in (1_000_000, 1):
        got = sorted(warc.resolve_revisits(df, size).collect(), key=lambda r: r["record_id"])
        assert [(r["record_id"], r["outcome"], r["response_id"]) for r in got] == [
            (4, "resolved", 1), (5, "resolved", 1), (6, "validator_mismatch", 3), (7, "resolved", 3), (7, "resolved", 3), (8, "no_response", None),
            (9, "no_response", None), (10, "no_response", None), (11, "no_response", None)]
        assert got[0]["headers"] == ["content-length: 5", "date: new", 'etag: W/"a"', "x: 1"] and got[3]["headers"] == ["date: old", 'etag: "c"']
    assert warc.resolve_revisits(df.limit(0)).count() == 0
