"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and each
assistant text's span is found among the tokens by binary search in their
sorted offsets. The template is, for each turn::

    <s>[INST] role [/INST]text</s>

Control strings inside roles and texts are broken up by a backslash after their
first character, and backslashes are doubled, so a rendered text holds control
strings only where the template put them and reading back is exact. The
tokenizer gets the control strings as special tokens, so no token spans the end of a text.

Defined results: turns sort by number, null first; equal numbers by role, then text. A null text or role is empty. Repeated
rows are turns of their own. Rows with a null conversation id form one conversation. Roles other than ``assistant`` are never under the mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marshline.llm.arrow import map_arrow

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
# The template's control strings and those that the tokenizer files know themselves.
_BREAK = re.compile(r"\\|</?s>|\[/?INST\]|<\|(?:start|end)oftext\|>")
_JOIN = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
_OUT_BYTES = 8 << 20


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _JOIN.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST] {escape(role)} [/INST]", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@lru_cache(maxsize=4)
def chat_encoder(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROL])
    return tok


def token_ranges(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and one past the last token that lies in each span. Both offset arrays are sorted."""
    if not spans:
        return []
    lo, hi = np.array(spans).T
    return list(zip(np.searchsorted(ends, lo, side="right").tolist(), np.searchsorted(starts, hi, side="left").tolist()))


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, ranges: list[tuple[int, int]]) -> str:
    """What stands under the mask, unescaped. Each range also covers what the tokenizer drops between its tokens and
    between the template's own tokens on either side."""
    out = []
    for a, b in ranges:
        left = int(ends[a - 1]) if a else 0
        right = int(starts[b]) if b < len(starts) else len(formatted)
        out.append(unescape(formatted[left:right]))
    return "".join(out)


def format_chats(df: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the formatted text, its token ids, and the loss mask as token and character ranges.

    Rows are dealt by conversation and sorted by turn on Spark's spilling sort; a task holds one conversation at a time.
    """
    kind = dict(df.dtypes)[conv]
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    dealt = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select("_conv", "_role", "_text")
    names = [conv, "formatted", "ids", "mask_tokens", "mask_chars"]
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def conversations(batches: Iterator[pa.RecordBatch]):
        key, turns = None, []
        for b in batches:
            for k, r, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if turns and k != key:
                    yield key, turns
                    turns = []
                key = k
                turns.append((r, t))
        if turns:
            yield key, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chat_encoder(tokenizer)
        out, size, types = [], 0, None

        def flush():
            keys, *rest = zip(*out)
            as_struct = lambda rs: [[{"first": a, "last": b} for a, b in r] for r in rs]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, types), pa.array(rest[0]), pa.array(rest[1], pa.list_(pa.int32())), pa.array(as_struct(rest[2]), span),
                 pa.array(as_struct(rest[3]), span)], names=names)

        def seen():
            nonlocal types
            for b in batches:
                types = b.schema.field(0).type
                yield b

        for key, turns in conversations(seen()):
            formatted, spans = render(turns)
            e = tok.encode(formatted, add_special_tokens=False)
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            starts, ends = np.maximum.accumulate(offsets[:, 0]), np.maximum.accumulate(offsets[:, 1])
            ranges = token_ranges(starts, ends, spans)
            chars = []
            for a, b in ranges:
                chars.append((int(ends[a - 1]) if a else 0, int(starts[b]) if b < len(starts) else len(formatted)))
            out.append((key, formatted, e.ids, ranges, chars))
            size += 8 * len(formatted)
            if size > _OUT_BYTES:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    pair = "array<struct<first:int,last:int>>"
    return map_arrow(dealt, run, f"`{conv}` {kind}, formatted string, ids array<int>, mask_tokens {pair}, mask_chars {pair}")


def digest_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from the output of ``format_chats``: turns by parsing, loss text through the mask."""
    kind = dict(formatted.dtypes)[conv]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, mask in zip(b.column("formatted").to_pylist(), b.column("mask_chars").to_pylist()):
                turns = read_back(f)
                loss = "".join(unescape(f[m["first"]:m["last"]]) for m in mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(f)))
            n, turns_sha, chars, loss_sha, size = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(conv), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()),
                 pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())],
                names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_arrow(formatted.select(conv, "formatted", "mask_chars"), run,
                     f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
