"""Packing token pieces into sequences of fixed capacity.

Lengths are at most the capacity, so their histogram has at most that many rows whatever
the corpus. The packing is planned on the histogram: the largest length left opens a sequence; single lengths, pairs and triples whose
sums equal the gap are looked up in indexes of available sums, and a combination that fills the gap exactly is consumed as
often as all its lengths are available; where none exists the best fitting length goes in and the search goes on. A plan
is a list of (pattern, times). Each piece then finds its place from its rank among the pieces of its length. Ranks are counted in
hash buckets of bounded size whose offsets are summed, so a length that a third of all pieces share is no single task.

Defined results: a null text is an empty one and gives one piece with the end id only. Repeated rows give pieces of their own. An
empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marshline.llm.arrow import by_bytes, filled, map_arrow
from marshline.llm.tokens import Encoder, encoder
from marshline.llm.words import split_words
from marshline.session import stage

CALL_BYTES = 2 << 20
_KNOWN_WORDS, _NEW_WORDS = 300_000, 10_000


class Codes(dict):
    """Numbers of words in order of their first look-up, with the words that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = code = len(self)
        return code


class WordIds:
    """Ids of whole texts by way of their words, for tokenizers whose tokens never span a blank.

    Words met before are remembered, up to a bound, so that the library sees each about once.
    """

    def __init__(self, enc: Encoder):
        self._enc = enc
        self._clear()

    def _clear(self) -> None:
        self._code = Codes()
        self._stems: dict[str, tuple[int, ...]] = {}
        self._pool = np.zeros(0, np.uint32)
        self._end = np.zeros(1, np.int64)

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self._code) > _KNOWN_WORDS:
            self._clear()
        codes = np.fromiter(map(self._code.__getitem__, words), np.int64, len(words))
        new, self._code.new = self._code.new, []
        pools, sizes = [self._pool], []
        for i in range(0, len(new), _NEW_WORDS):
            ids = self._enc.word_ids(new[i:i + _NEW_WORDS], self._stems)
            sizes += map(len, ids)
            pools.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        if new:
            self._pool = np.concatenate(pools)
            self._end = np.concatenate([self._end, self._end[-1] + np.cumsum(sizes, dtype=np.int64)])
        return codes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's start (one more entry than texts)."""
        words, starts = split_words(texts)
        coded = words.dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())
        at = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        first, size = self._end[at], self._end[at + 1] - self._end[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
        return self._pool[where], ends[starts]


def text_ids(texts: pa.Array, enc: Encoder, words: WordIds) -> tuple[np.ndarray, np.ndarray]:
    if enc.cuttable:
        return words.ids(texts)
    ids = enc.ids(texts.to_pylist())
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return np.array([x for xs in ids for x in xs], np.uint32), ends


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key``, piece, start, length and the checksum of its ids. Only texts of over ``capacity`` ids are cut."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        words = WordIds(enc)  # of this task only: workers live on and share their memory with other tasks
        for b in by_bytes(batches, "_text", CALL_BYTES):
            ids, ends = text_ids(filled(b.column("_text")), enc, words)
            rows = []
            for i in range(b.num_rows):
                own = np.append(ids[ends[i]:ends[i + 1]], np.uint32(end_id)).astype("<u4")
                for p, s in enumerate(range(0, len(own), capacity)):
                    part = own[s:s + capacity]
                    rows.append((i, p, s, len(part), zlib.crc32(part)))
            i, p, s, n, c = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [b.column("_key").take(pa.array(i)), pa.array(p.astype(np.int32)), pa.array(s), pa.array(n), pa.array(c)],
                names=[key, "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return map_arrow(rows, run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Indexes of the available single, pair and triple sums. They may list sums that are used up by now, so finds are confirmed."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.refresh()

    def refresh(self) -> None:
        self.misses = 0
        lengths = np.flatnonzero(self.left).tolist()
        ones = sum(1 << n for n in lengths)
        inside = (1 << len(self.left)) - 1
        self.pairs = self.triples = 0
        for n in lengths:
            self.pairs |= ones << n & inside
        for n in lengths:
            self.triples |= self.pairs << n & inside

    def pair(self, gap: int) -> list[int]:
        """Two available lengths of that sum, the larger one as large as can be."""
        if gap < 2 or not self.pairs >> gap & 1:
            return []
        low = np.arange(1, gap // 2 + 1)
        ok = (self.left[low] > 0) & (self.left[gap - low] > (low == gap - low))
        return [gap - int(low[ok][0]), int(low[ok][0])] if ok.any() else []

    def fill(self, gap: int) -> list[int]:
        """One, two or three available lengths that fill the gap exactly, or none."""
        if self.left[gap] > 0:
            return [gap]
        if two := self.pair(gap):
            return two
        if gap < 3 or not self.triples >> gap & 1:
            return []
        for n in np.flatnonzero(self.left[:gap - 1])[::-1].tolist():
            if self.pairs >> (gap - n) & 1:
                self.left[n] -= 1
                two = self.pair(gap - n)
                self.left[n] += 1
                if two:
                    return [n, *two]
                self.misses += 1
        if self.misses > 500:
            self.refresh()
        return []


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used. ``counts[n]``: pieces of length n; the last index is the capacity."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    sums = Sums(left)
    out = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        pattern, gap = [top], capacity - top
        left[top] -= 1
        while gap:
            found = sums.fill(gap)
            if not found:
                fits = np.flatnonzero(left[1:gap + 1])
                if not len(fits):
                    break
                found = [int(fits[-1]) + 1]  # best fit
            for n in found:
                left[n] -= 1
            pattern += found
            gap -= sum(found)
        uses = Counter(pattern)
        more = min(int(left[n]) // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= more * k
        out.append((pattern, 1 + more))


def places(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Columns: length, first rank, sequence of that rank, pieces of the length in a sequence, offset of the first. Sorted."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((n, used[n], sequence, k, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece"), bucket_rows: int = 50_000) -> DataFrame:
    """``pieces`` (with a column length in 1..capacity) and sequence_id and offset. It is read three times: stage it first."""
    hist = pieces.groupBy("length").agg(F.count("*").alias("_n"))
    known = hist.collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in known:
        counts[r["length"]] = r["_n"]
    slots = places(plan(counts))
    shared = pieces.sparkSession.sparkContext.broadcast(slots)
    split = F.create_map(*[F.lit(x) for n in np.flatnonzero(counts > bucket_rows).tolist() for x in (n, int(counts[n] // bucket_rows + 1))]) \
        if (counts > bucket_rows).any() else None
    salt = F.pmod(F.xxhash64(*order), F.coalesce(split[F.col("length").cast("int")], F.lit(1)) if split is not None else F.lit(1)).cast("int")
    placed = pieces.withColumn("_salt", salt)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
               .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = (placed.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_salt"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    names = pieces.columns
    kinds = dict(pieces.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, k, offset = shared.value.T
        start = (length << 44) | first
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(start, (n << 44) | rank, side="right") - 1
            own = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence[at] + own // k[at]), pa.array(offset[at] + own % k[at] * n)],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return map_arrow(ranked.select(*names, "_rank"), run, f"{schema}, sequence_id long, offset long")


def pack_texts(df: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(stage(token_pieces(df, tokenizer, capacity, key=key, text=text), "pieces"), capacity, (key, "piece"))
