"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Texts are compared as words: lower case, ASCII punctuation and control characters as blanks. In scripts that are written without blanks
between words (``_UNSPACED``) every code point is a word of its own, and CJK and full-width punctuation is a blank too, so an item is found
inside a longer run of characters. An item of m words may differ from a passage by k word edits. It is split into k + 1 pieces; a passage within k edits holds at least one piece unchanged. Documents are searched for
exact pieces by rolling hashes, and around each hit the edit distance of the
item to the best fitting passage is computed with Myers' bit vectors.

The benchmark is the query set. Its size is measured; blocks of items of at most ``block_chars`` characters are broadcast one after another, so a larger
benchmark takes more passes over the documents and never more memory.

Defined results: null or wordless documents match nothing, nor do items without a word. Items with fewer than ``min_words`` words are not
searched; with 1 every item is, and those too short for an edit at the rate are found as they are only. Very long texts are searched whole. Repeated benchmark rows count once; repeated documents each match. Of several passages that match an
item in one document the nearest is reported, the first of equally near ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marshline.llm.arrow import by_bytes, filled, map_arrow
from marshline.llm.words import Rolling, hash_words, split_words

CALL_BYTES = 2 << 20
_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[c for c in range(128) if not chr(c).isalnum()]] = 32
_SCREEN_BITS = 18
#: First and one past the last code point: Thai to Tibetan, Myanmar, Khmer, Tai and Balinese blocks, CJK, kana, Yi, Javanese and Myanmar
#: extensions, Tai Viet, compatibility ideographs, half-width kana, kana supplements, ideographs of planes 2 and 3.
_UNSPACED = np.array([(0x0E00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1A00), (0x1A20, 0x1AB0), (0x1B00, 0x1B80), (0x2E80, 0x3000),
                      (0x3005, 0x3008), (0x3021, 0x3030), (0x3031, 0x303D), (0x303E, 0x3130), (0x3190, 0xA4D0), (0xA980, 0xAA00), (0xAA60, 0xAAE0),
                      (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x16FE0, 0x18D90), (0x1AFF0, 0x1B170), (0x20000, 0x40000)]).ravel()
_WIDE_BLANKS = np.array([(0x3000, 0x3005), (0x3008, 0x3021), (0x3030, 0x3031), (0x303D, 0x303E), (0xFF01, 0xFF10), (0xFF1A, 0xFF21), (0xFF3B, 0xFF41),
                         (0xFF5B, 0xFF66)]).ravel()


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes with a blank on both sides of every code point of ``_UNSPACED``, and the texts' offsets in them."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return data, offsets
    lead = data[at].astype(np.int64)
    wide = lead >= 0xF0
    tail = [data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3)]
    code = np.where(wide, (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1])
    blank = at[np.searchsorted(_WIDE_BLANKS, code, side="right") % 2 == 1]
    if len(blank):
        data = data.copy()
        data[(blank[:, None] + np.arange(3)).ravel()] = 32
    own = np.searchsorted(_UNSPACED, code, side="right") % 2 == 1
    begin, end = at[own], at[own] + np.where(wide[own], 4, 3)
    if not len(begin):
        return data, offsets
    return np.insert(data, np.concatenate([begin, end]), 32), offsets + 2 * np.searchsorted(begin, offsets, side="left")


def comparable(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that are compared, and where each text's start."""
    low = pc.utf8_lower(texts)
    valid, offsets, data = low.buffers()
    if data is not None and data.size:
        ends = np.frombuffer(offsets, np.int32)[low.offset:low.offset + len(low) + 1].astype(np.int64)
        clean, ends = spaced(_BLANKS[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]], ends - ends[0])
        low = pa.StringArray.from_buffers(len(low), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(clean), None, 0)
    words, starts = split_words(low)
    return hash_words(words), starts


def budget(words: int, error_rate: float, min_piece: int = 1) -> int:
    """Allowed edits: the rate, as far as all pieces keep ``min_piece`` words. By default the rate alone: pieces are as short as it asks for, one word at least."""
    return max(0, min(int(words * error_rate), words // min_piece - 1))


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least number of word edits between the item and any part of the text, and one past that part's last word.

    Myers (1999): bit i of ``up``/``down`` says that the distance grows/falls by one from row i to i + 1 of the current column.
    """
    m = len(item)
    rows: dict[int, int] = {}
    for i, w in enumerate(item):
        rows[w] = rows.get(w, 0) | 1 << i
    all_rows, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = all_rows, 0, m, m, 0
    for j, w in enumerate(text, 1):
        same = rows.get(w, 0)
        diagonal = ((same & up) + up ^ up) | same | down
        right_up = down | ~(diagonal | up) & all_rows
        right_down = up & diagonal
        score += bool(right_up & last) - bool(right_down & last)
        right_up = right_up << 1 & all_rows
        right_down = right_down << 1 & all_rows
        up = right_down | ~(diagonal | right_up) & all_rows
        down = right_up & diagonal
        if score < best:
            best, at = score, j
    return best, at


@dataclass
class Pieces:
    """A block of items, ready for search: words, budgets, and for each piece length the sorted hashes with item and offset."""

    ids: list
    words: list[list[int]]
    edits: list[int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def split_items(ids: list, texts: list[str], error_rate: float, min_words: int) -> Pieces:
    hashes, starts = comparable(pa.array(texts, pa.string()))
    found: dict[int, list[tuple[int, int, int]]] = {}
    out = Pieces([], [], [])
    for i, item in enumerate(ids):
        own = hashes[starts[i]:starts[i + 1]]
        if len(own) < max(min_words, 1):
            continue
        k = budget(len(own), error_rate)
        cuts = [len(own) * p // (k + 1) for p in range(k + 2)]
        roll = Rolling(own)
        for a, b in zip(cuts[:-1], cuts[1:]):
            found.setdefault(b - a, []).append((int(roll.runs(b - a)[a]), len(out.ids), a))
        out.ids.append(item)
        out.words.append(own.tolist())
        out.edits.append(k)
    for size, rows in found.items():
        rows.sort()
        h = np.array([r[0] for r in rows], np.uint64)
        screen = np.zeros(1 << _SCREEN_BITS, bool)
        screen[(h >> np.uint64(64 - _SCREEN_BITS)).astype(np.int64)] = True
        out.by_length[size] = (h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), screen)
    return out


def search(hashes: np.ndarray, starts: np.ndarray, items: Pieces) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, one past the passage's last word) of every item found in a text within its budget."""
    windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out, edits = [], np.array(items.edits, np.int64)
    roll = Rolling(hashes)
    for size, (known, item, offset, screen) in items.by_length.items():
        runs = roll.runs(size)
        at = np.flatnonzero(screen[(runs >> np.uint64(64 - _SCREEN_BITS)).astype(np.int64)])
        left = np.searchsorted(known, runs[at], side="left")
        many = np.searchsorted(known, runs[at], side="right") - left
        p, hit = np.repeat(at, many), np.repeat(left - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        t = np.searchsorted(starts, p, side="right") - 1
        inside = p + size <= starts[t + 1]  # others run over the end of their text
        p, t, i, offset_of = p[inside], t[inside], item[hit[inside]], offset[hit[inside]]
        whole = edits[i] == 0
        # An item in one piece is found by its hits alone; of a text's hits the first counts, however many there are.
        _, first = np.unique(t[whole] * len(edits) + i[whole], return_index=True)
        out += [(a, b, 0, c) for a, b, c in zip(t[whole][first].tolist(), i[whole][first].tolist(), (p[whole] + size - starts[t[whole]])[first].tolist())]
        for p1, t1, i1, o1 in zip(*(x[~whole].tolist() for x in (p, t, i, offset_of))):
            k, begin = items.edits[i1], p1 - o1
            windows.setdefault((t1, i1), []).append((max(begin - k, int(starts[t1])), min(begin + len(items.words[i1]) + k, int(starts[t1 + 1]))))
    for (t, i), spans in windows.items():
        best, end, done = items.edits[i] + 1, 0, -1
        for a, b in sorted(spans):
            if b <= done:
                continue  # inside a window that was searched
            distance, at = best_match(items.words[i], hashes[a:b].tolist())
            done = max(done, b)
            if distance < best:
                best, end = distance, a + at - int(starts[t])
        if best <= items.edits[i]:
            out.append((t, i, best, end))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[tuple[list, list[str]]]:
    """The distinct items in blocks of about ``block_chars`` characters, chosen by hash so that each is read alone."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t")).distinct()
    n = -(-int(rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // block_chars)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield [r["i"] for r in own], [r["t"] for r in own]


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", error_rate: float = 0.15,
          min_words: int = 8, block_chars: int = 8 << 20) -> DataFrame:
    """One row per document and item it holds: ``key``, ``item``, distance, n_words (of the item) and end_word (of the passage)."""
    kinds = dict(df.dtypes) | {"_item": dict(benchmark.dtypes)[item]}
    item_kind = to_arrow_type(benchmark.schema[item].dataType)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = None
    for ids, texts in blocks(benchmark, item, text, block_chars):
        shared = df.sparkSession.sparkContext.broadcast(split_items(ids, texts, error_rate, min_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in by_bytes(batches, "_text", CALL_BYTES):
                found = search(*comparable(filled(b.column("_text"))), items)
                if found:
                    t, i, d, end = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("_key").take(pa.array(t)), pa.array([items.ids[x] for x in i], item_kind), pa.array(d, pa.int64()),
                         pa.array([len(items.words[x]) for x in i], pa.int64()), pa.array(end, pa.int64())],
                        names=[key, item, "distance", "n_words", "end_word"])

        part = map_arrow(rows, run, f"`{key}` {kinds[key]}, `{item}` {kinds['_item']}, distance long, n_words long, end_word long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.select(F.col("_key").alias(key), F.lit(None).cast(kinds["_item"]).alias(item), *[F.lit(0).cast("long").alias(c) for c in (
            "distance", "n_words", "end_word")]).where("false")
    return out


def without_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", error_rate: float = 0.15,
                  min_words: int = 8, block_chars: int = 8 << 20) -> DataFrame:
    """The rows of ``df``, all columns, whose text holds no item. Rows are dropped where they are read: no join, no shuffle."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    for ids, texts in blocks(benchmark, item, text, block_chars):
        shared = df.sparkSession.sparkContext.broadcast(split_items(ids, texts, error_rate, min_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in by_bytes(batches, text, CALL_BYTES):
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in search(*comparable(filled(b.column(text))), shared.value)]] = False
                yield b.filter(pa.array(keep))

        df = map_arrow(df, run, schema)
    return df
