"""Repeated passages across documents: seeds on winnowed anchors, extended both ways to whole windows.

A window is ``window`` consecutive words. Every window holds an anchor: the least hash among its ``seed``-word runs (winnowing), so equal windows hold
equal anchors at equal places. Documents are joined on anchors; only windows around an anchor that several documents share can
repeat. There the match is extended both ways: each such window's whole word sequence (128 bits: the
anchor's and the window's hash) is grouped, and a window whose sequence also starts in a document of smaller id is covered. Runs of covered windows
are the maximal repeats of at least ``window`` words.

Documents of equal word sequences are one class before seeds are joined; all but the smallest id repeat as a whole. All groupings
combine before the shuffle, and the joins are equi joins that adaptive execution can split, so a passage that a third of the documents share is no
single task.

Defined results: a null text has no words. Rows with a null id neither cover others nor lose words. Repeated rows (same id and
text) do not cover each other; each gives its row. The id is taken to identify a text. Words are bytes other than ASCII white space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marshline.llm.arrow import by_bytes, filled, map_arrow
from marshline.llm.words import Rolling, hash_words, mix, set_keys, split_words
from marshline.session import stage

CALL_BYTES = 2 << 20


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width`` values, by doubling."""
    place = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        if len(place) <= step:
            return place[:0]
        a, b = place[:-step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        have += step
    return place


class Anchored:
    """Words, windows and anchors of a batch of texts laid end to end."""

    def __init__(self, texts: pa.Array, window: int, seed: int):
        self.window = window
        self.words, self.starts = split_words(texts)
        self.hashes = hash_words(self.words)
        self.roll = Rolling(self.hashes)
        grams = self.roll.runs(seed)
        size = np.diff(self.starts)
        self.anchor_hash = grams
        # Anchor of the window at each word; windows that run over the end of their text are left out.
        least = sliding_argmin(grams, window - seed + 1)
        inside = np.zeros(len(self.hashes) + 1, np.int64)
        long = np.flatnonzero(size >= window)
        np.add.at(inside, self.starts[long], 1)
        np.add.at(inside, self.starts[long] + size[long] - window + 1, -1)
        self.at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        self.anchor = least[self.at]
        self.owner = np.searchsorted(self.starts, self.at, side="right") - 1

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return self.roll.span(at, at + self.window)


def ragged(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def anchors(df: DataFrame, window: int, seed: int) -> DataFrame:
    """Of each text: number of words, 128-bit key of its sequence, checksum of its words, and its anchors."""
    kind = dict(df.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", CALL_BYTES):
            texts = Anchored(filled(b.column("_text")), window, seed)
            n = b.num_rows
            places, first = np.unique(texts.anchor, return_index=True)
            owner = texts.owner[first]
            order = np.arange(len(texts.hashes), dtype=np.uint64) - np.repeat(texts.starts[:-1], np.diff(texts.starts)).astype(np.uint64)
            k1, k2 = set_keys(mix(texts.hashes ^ mix(order)), texts.starts)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(np.diff(texts.starts)), pa.array(k1), pa.array(k2), pa.array(digests(texts.words, texts.starts)),
                 ragged(texts.anchor_hash[places].view(np.int64), owner, n)],
                names=["_id", "n_words", "_k1", "_k2", "_sha", "_anchors"])

    return map_arrow(df, run, f"_id {kind}, n_words long, _k1 long, _k2 long, _sha string, _anchors array<long>")


def digests(words: pa.Array, starts: np.ndarray) -> list[str]:
    """Checksums of each text's words joined by one blank."""
    _, offsets, data = words.buffers()
    raw = memoryview(data) if data is not None else memoryview(b"")
    ends = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    size = np.diff(ends)
    # Each word is laid out with a blank after it.
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    if len(size):
        filled_bytes = np.ones(len(out), bool)
        filled_bytes[np.cumsum(size + 1) - 1] = False
        out[filled_bytes] = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]]
    at = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)[starts]
    view = out.tobytes()
    return [hashlib.sha256(view[a:max(b - 1, a)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def candidate_windows(df: DataFrame, kind: str, window: int, seed: int) -> DataFrame:
    """(_w, _a, _id, _at): windows whose anchor is among the row's ``_shared`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", CALL_BYTES):
            texts = Anchored(filled(b.column("_text")), window, seed)
            shared = b.column("_shared")
            known = shared.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(b.num_rows), np.diff(shared.offsets.to_numpy()))
            # One number for a text and a hash: equal numbers of other texts are as unlikely as equal hashes.
            pair = np.sort(mix(known ^ mix(of.astype(np.uint64))))
            own = mix(texts.anchor_hash[texts.anchor] ^ mix(texts.owner.astype(np.uint64)))
            near = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            hit = pair[near] == own if len(pair) else np.zeros(len(own), bool)
            at, owner = texts.at[hit], texts.owner[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts.window_hashes(at).view(np.int64)), pa.array(texts.anchor_hash[texts.anchor[hit]].view(np.int64)),
                 b.column("_id").take(pa.array(owner)), pa.array((at - texts.starts[owner]).astype(np.int32))], names=["_w", "_a", "_id", "_at"])

    return map_arrow(df, run, f"_w long, _a long, _id {kind}, _at int")


def removals(df: DataFrame, kind: str, window: int) -> DataFrame:
    """Rows with the places of covered windows (``_covered``), judged: number and checksum of the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", CALL_BYTES):
            words, starts = split_words(filled(b.column("_text")))
            lists = b.column("_covered")
            of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy() + starts[of]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            keep = np.cumsum(change[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[starts]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(np.diff(starts) - np.diff(kept)), pa.array(digests(words.filter(pa.array(keep)), kept))],
                names=["_id", "n_removed", "kept_sha256"])

    return map_arrow(df, run, f"_id {kind}, n_removed long, kept_sha256 string")


def covered_windows(texts: DataFrame, docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(_id, _covered): starts of the windows whose sequence also starts in a document of smaller id. ``docs``: one row a class."""
    kind = dict(texts.dtypes)["_id"]
    seeds = docs.select("_id", F.explode("_anchors").alias("_a"))
    # Groups are written before they are joined back: adaptive execution splits a hot key only between two plain exchanges.
    joined = stage(seeds.groupBy("_a").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("_a"), "joined")
    shared = seeds.join(joined, "_a", "left_semi").groupBy("_id").agg(F.collect_set("_a").alias("_shared"))
    windows = stage(candidate_windows(texts.join(shared, "_id").select("_id", "_text", "_shared"), kind, window, seed), "windows")
    firsts = stage(windows.groupBy("_w", "_a").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("_w", "_a", "lo"), "firsts")
    return (windows.join(firsts, ["_w", "_a"]).where("_id > lo").groupBy("_id").agg(F.collect_set("_at").alias("_covered")))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, seed: int = 12) -> DataFrame:
    """``key``, n_words, n_removed and kept_sha256 of every row: words of repeats of at least ``window`` words go, except where they come first."""
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = dict(texts.dtypes)["_id"]
    docs = stage(anchors(texts, window, seed), "anchors")
    long = docs.where(F.col("n_words") >= window).where("_id is not null")
    classes = long.groupBy("_k1", "_k2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    classes = stage(classes, "classes")
    copies = long.join(classes, ["_k1", "_k2"]).where("_id > _first").select("_id").distinct()
    firsts = long.select("_id", "_anchors").join(copies, "_id", "left_anti")
    covered = stage(covered_windows(texts, firsts, window, seed), "covered")
    cut = removals(texts.join(covered, "_id").select("_id", "_text", "_covered"), kind, window).dropDuplicates(["_id"])
    whole = copies.select("_id", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    judged = stage(cut.unionByName(whole), "judged")
    kept = docs.select("_id", "n_words", "_sha").join(judged, "_id", "left")
    removed = F.when(F.col("kept_sha256").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", "n_words"))
    return kept.select(F.col("_id").alias(key), "n_words", removed.cast("long").alias("n_removed"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"))
