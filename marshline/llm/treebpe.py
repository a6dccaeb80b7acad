"""Byte-level BPE encoding by concatenation in a tree, and decoding.

A text falls into units, each a run of white space and the run of other characters after it. No token of these tokenizers reaches over the end of a unit, so
units are encoded by themselves: the library sees each distinct unit of a task about once, and ids of a text are put together from its units.

Long texts are cut into pieces of whole units, or of the tokenizer's own words where a unit is long. A single word above the piece size is
split in halves, again and again, and its halves become pieces too. Pieces are dealt to all tasks, encoded in parallel and put together
in a tree: around each join, the text of the last tokens on the left and the first on the right is encoded again, in a window that grows until its
first token is the left's at that place and its last token is the right's. That is exact: ids are a BPE encoding just if every two neighbours encode to
themselves, and in the joined ids each pair of neighbours stands in one of the three encodings.

Ids are bytes, little-endian unsigned 32-bit integers (``numpy.frombuffer(ids, "<u4")``). Tokenizers of other kinds than byte-level BPE without a normalizer get
whole texts and decode by the library.

Defined results: a null text is an empty one, without ids. Repeated rows each give their row. Null or repeated keys are values like any
other. Special strings inside texts become their tokens, as the library does. Texts of any length are encoded whole. Ids that the vocabulary lacks decode to nothing, null ids to an empty text.
An empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marshline.llm.arrow import by_bytes, filled, map_arrow
from marshline.session import stage

CALL_BYTES, LONG_TEXT, PIECE = 1 << 20, 1 << 16, 1 << 14
_KNOWN_UNITS = 300_000
_OUT_BYTES = 8 << 20
#: The white space of the tokenizers' expressions.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c))
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_letters() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


#: A word of Latin letters with at most one blank before it and punctuation after it, which the tokenizers' expression takes apart just there.
_PLAIN = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")


class TreeEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._tok.no_truncation()
        self._tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_level = _is_byte_level(spec)
        self.decodes_bytes = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self._special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._letters = byte_letters()
        size = max(self._tok.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self._token = [self._tok.id_to_token(i) or "" for i in range(size)]
        self._shown = dict(enumerate(self._letters))
        self._tails: dict[str, list[int]] = {}
        value = {c: b for b, c in enumerate(self._letters)}
        self._bytes = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in self._token]

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tok.encode_batch(texts, add_special_tokens=False)]

    def merged(self, letters: str) -> list[int]:
        """Ids of one word, given in the vocabulary's letters."""
        return [t.id for t in self._tok.model.tokenize(letters)]

    def units(self, units: list[str]) -> list[list[int]]:
        """Ids of short units. Plain words go straight to the library's merge model, all others the whole way."""
        out, rest, blank = [], [], self._letters[32]
        for i, unit in enumerate(units):
            plain = _PLAIN.fullmatch(unit)
            if not plain:
                out.append(None)
                rest.append(i)
                continue
            lead, word, tail = plain.groups()
            if not word.isascii():
                word = word.encode("utf-8").decode("latin-1").translate(self._shown)
            ids = self.merged(blank + word if lead else word)
            if tail:
                if tail not in self._tails:
                    if len(self._tails) > _KNOWN_UNITS:
                        self._tails = {}
                    self._tails[tail] = self.merged(tail)
                ids = ids + self._tails[tail]
            out.append(ids)
        for i, ids in zip(rest, self.library([units[i] for i in rest])):
            out[i] = ids
        return out

    def words(self, unit: str) -> Iterator[tuple[str, str | None]]:
        """A unit's special strings, and its words as text and in the vocabulary's letters."""
        for part in self._cut.split(unit) if self._cut else [unit]:
            if part in self._special:
                yield part, None
            elif part:
                for letters, (a, b) in self._tok.pre_tokenizer.pre_tokenize_str(part):
                    yield part[a:b], letters

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one word from those of its two parts."""
        back = ahead = 4
        while True:
            a, b = max(len(left) - back, 0), min(ahead, len(right))
            window = self.merged("".join([self._token[i] for i in left[a:]] + [self._token[i] for i in right[:b]]))
            left_agrees = a == 0 or window[0] == left[a]
            right_agrees = b == len(right) or window[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return left[:a] + window + right[b:]
            back, ahead = back * (1 if left_agrees else 2), ahead * (1 if right_agrees else 2)

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Ids of one word from those of its parts in order."""
        while len(parts) > 1:
            parts = [self.joined(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def unit_ids(self, unit: str, size: int) -> list[int]:
        """Ids of a long unit within a task."""
        out = []
        for text, letters in self.words(unit):
            out += self.tree([self.merged(x) for x in halves(letters, size)]) if letters and len(letters) > size else self.library([text])[0]
        return out

    def decode(self, ids: np.ndarray) -> str:
        if self.decodes_bytes:
            known = ids[ids < len(self._bytes)].tolist()
            return b"".join(map(self._bytes.__getitem__, known)).decode("utf-8", "replace")
        return self._tok.decode(ids.tolist(), skip_special_tokens=False)


def _is_byte_level(spec: dict) -> bool:
    """Whether texts reach the merge model by the one expression that keeps white space at the front of words, and nothing else changes them."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or _UNIT.match(" " + a["content"]).end() != len(a["content"]) + 1)
                    for a in spec.get("added_tokens", [])))


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    """Loaded once in each Python worker."""
    return TreeEncoder(path)


def halves(text: str, size: int) -> list[str]:
    """The text in halves, and those in halves, until none is above ``size``."""
    if len(text) <= size:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], size) + halves(text[middle:], size)


class UnitIds:
    """Ids of texts by way of their units. Units met before are remembered, up to a bound."""

    def __init__(self, enc: TreeEncoder, size: int = PIECE):
        self._enc, self._size = enc, size
        self._clear()

    def _clear(self) -> None:
        self._code: dict[str, int] = {}
        self._pool, self._end = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= self._size]
        ids, calls, at = {}, [[]], 0
        for u in short:
            calls[-1].append(u)
            at += len(u)
            if at > CALL_BYTES // 8:
                calls.append([])
                at = 0
        for call in calls:
            ids.update(zip(call, self._enc.units(call)))
        for u in units:
            if len(u) > self._size:
                ids[u] = self._enc.unit_ids(u, self._size)
        rows = [ids[u] for u in units]
        self._code.update(zip(units, range(len(self._code), len(self._code) + len(units))))
        self._pool = np.concatenate([self._pool, np.array([x for r in rows for x in r], np.uint32)])
        self._end = np.concatenate([self._end, self._end[-1] + np.cumsum([len(r) for r in rows], dtype=np.int64)])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's start (one more entry than texts)."""
        if not self._enc.byte_level:
            rows = self._enc.library(texts)
            return np.array([x for r in rows for x in r], np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        per_text = [_UNIT.findall(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(us) for us in per_text])]).astype(np.int64)
        units = [u for us in per_text for u in us]
        if len(self._code) > _KNOWN_UNITS:
            self._clear()
        if new := [u for u in dict.fromkeys(units) if u not in self._code]:
            self._learn(new)
        at = np.fromiter(map(self._code.__getitem__, units), np.int64, len(units))
        first, size = self._end[at], self._end[at + 1] - self._end[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
        return self._pool[where], ends[starts]


def cut(text: str, enc: TreeEncoder, size: int) -> Iterator[tuple[int, str]]:
    """Pieces of a long text in order: 0 and a text that encodes by itself, or the number of a long word (from 1) and a part of it in letters."""
    held, length, long_words = [], 0, 0

    def flush():
        nonlocal held, length
        if held:
            yield 0, "".join(held)
        held, length = [], 0

    for unit in map(re.Match.group, _UNIT.finditer(text)):
        for part, letters in [(unit, "")] if len(unit) <= size else enc.words(unit):
            if letters and len(letters) > size:
                yield from flush()
                long_words += 1
                for half in halves(letters, size):
                    yield long_words, half
                continue
            apart = len(unit) > size and not part.strip(_SPACES)  # a word of white space depends on what follows: it stands alone
            if apart or length + len(part) > size:
                yield from flush()
            held.append(part)
            length += len(part)
            if apart:
                yield from flush()
    yield from flush()


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _rows(found: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last value is a text or bytes, of about equal bytes."""
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for row in found:
        out.append(row)
        size += len(row[-1]) + 32
        if size > _OUT_BYTES:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def encode_texts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", long_text: int = LONG_TEXT, piece: int = PIECE) -> DataFrame:
    """``key`` and ids of every text. Texts of over ``long_text`` bytes are cut into pieces of about ``piece`` characters and encoded by many tasks."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = UnitIds(tree_encoder(tokenizer), piece)  # of this task only
        for b in by_bytes(batches, "_text", CALL_BYTES):
            ids, ends = units.ids(filled(b.column("_text")).to_pylist())
            data = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array([data[4 * x:4 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())],
                                             names=[key, "ids"])

    schema = f"`{key}` {kind}, ids binary"
    if not tree_encoder(tokenizer).byte_level:
        return map_arrow(rows, whole, schema)
    is_long = F.coalesce(F.octet_length("_text") > long_text, F.lit(False))
    return map_arrow(rows.where(~is_long), whole, schema).unionByName(
        _encode_long(rows.where(is_long).withColumn("_row", F.monotonically_increasing_id()), tokenizer, piece, key, kind, schema))


def _encode_long(rows: DataFrame, tokenizer: str, piece: int, key: str, kind: str, schema: str) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, key_kind = tree_encoder(tokenizer), None

        def found():
            nonlocal key_kind
            for b in by_bytes(batches, "_text", CALL_BYTES):
                for k, t, r in zip(*(c.to_pylist() for c in b.columns)):
                    for i, (word, part) in enumerate(cut(t, enc, piece)):
                        yield r, i, word, k, part

        first = next(batches, None)
        if first is not None:
            key_kind = first.schema.field(0).type
            batches = _again(first, batches)
            yield from _rows(found(), ["_row", "_piece", "_word", "_key", "_part"], [pa.int64(), pa.int64(), pa.int64(), key_kind, pa.string()])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(tokenizer)
        units = UnitIds(enc, piece)
        for b in by_bytes(batches, "_part", CALL_BYTES):
            ids = []
            for word, part in zip(b.column("_word").to_pylist(), b.column("_part").to_pylist()):
                ids.append(_packed(enc.merged(part) if word else units.ids([part])[0]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], names=[*b.schema.names[:-1], "_ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, key_kind = tree_encoder(tokenizer), None

        def found():
            now, k, done, word, parts = None, None, [], 0, []
            for b in by_bytes(batches, "_ids", CALL_BYTES):
                for r, w, own, ids in zip(*(b.column(c).to_pylist() for c in ("_row", "_word", "_key", "_ids"))):
                    if parts and (r != now or w != word):
                        done.append(_packed(enc.tree(parts)))
                        parts = []
                    if r != now:
                        if now is not None:
                            yield k, b"".join(done)
                        now, k, done = r, own, []
                    word = w
                    if w:
                        parts.append(np.frombuffer(ids, "<u4").tolist())
                    else:
                        done.append(ids)
            if parts:
                done.append(_packed(enc.tree(parts)))
            if now is not None:
                yield k, b"".join(done)

        first = next(batches, None)
        if first is not None:
            key_kind = first.schema.field(first.schema.get_field_index("_key")).type
            batches = _again(first, batches)
            yield from _rows(found(), [key, "ids"], [key_kind, pa.binary()])

    names = f"_row long, _piece long, _word long, _key {kind}"
    pieces = stage(map_arrow(rows.select("_key", "_text", "_row"), split, f"{names}, _part string"), "pieces")
    encoded = map_arrow(pieces.repartition("_row", "_piece"), encode, f"{names}, _ids binary")
    dealt = encoded.repartition("_row").sortWithinPartitions("_row", "_piece")
    return map_arrow(dealt, join, schema)


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns of ``df`` and the text of ``ids``, special tokens included."""
    if out in df.columns:
        raise ValueError(f"name the result otherwise: {out} is a column already")
    kinds, names = dict(df.dtypes), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tree_encoder(tokenizer)
        for b in by_bytes(batches, ids, CALL_BYTES):
            texts = [enc.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, out])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return map_arrow(df, run, f"{schema}, `{out}` string")
