"""Token counts of whole texts with a given public tokenizer.

Texts go to the tokenizer library in batches of about equal bytes and only
lengths come back. Texts are cut where no token can span the cut:

* ``.json`` (tokenizers): at white space, if the file's pre-tokenizer drops white space and its normalizer is one of
  the known context-free ones. Then every word is a piece: the distinct words of a batch that the task has not met before go to the
  library in calls of equal bytes, and a text's count is the sum over its words. A text is left whole otherwise.
* ``.model`` (sentencepiece): texts are left whole.

What a task remembers of words is bounded (``_KNOWN_WORDS``) and starts anew beyond that.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); repeated rows each give their row; an empty
table gives an empty one. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marshline.llm.arrow import by_bytes, filled, map_arrow, text_sizes
from marshline.llm.words import split_words

#: Bytes of text in one call of the library, and the length from which a text is cut.
CALL_BYTES, LONG_TEXT = 1 << 20, 1 << 16
_KNOWN_WORDS = 300_000
# An ASCII blank between two visible ASCII characters: no normalization joins across it.
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Encoder:
    """One interface to both libraries. ``cuttable``: a blank always separates tokens and belongs to none."""

    def __init__(self, path: str):
        self.cuttable = self.merges_letters = False
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer
            self._tok = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.cuttable = _drops_blanks(spec)
            self.merges_letters = self.cuttable and _keeps_letters_together(spec)
            self._tok.no_truncation()
            self._tok.no_padding()
            self.ids = lambda texts: [e.ids for e in self._tok.encode_batch(texts, add_special_tokens=False)]
            self.counts = lambda texts: [len(e) for e in self._tok.encode_batch(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece
            self._tok = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda texts: self._tok.encode(texts, num_threads=1)
            self.counts = lambda texts: [len(x) for x in self.ids(texts)]
        else:
            raise ValueError(f"neither a .json nor a .model file: {path}")

    def word_ids(self, words: list[str], stems: dict[str, tuple[int, ...]] | None = None) -> list[Sequence[int]]:
        """Ids of single words, not to be changed; ``stems`` remembers those of letters from call to call, and is for the caller to bound. Words of Latin letters with closing punctuation go straight to the library's merge model, where normalizer and
        pre-tokenizer are known to pass them on as letters and punctuation in lower case; all others take the whole way."""
        if not self.merges_letters:
            return self.ids(words)
        merge, out, rest, tails = self._tok.model.tokenize, [], [], {"": ()}
        stems = {} if stems is None else stems
        for i, w in enumerate(words):
            known = _LATIN_WORD.fullmatch(w)
            if known:
                letters, tail = known.groups()
                ids = stems.get(letters)
                if ids is None:
                    low = letters.lower()
                    if not low.isascii():
                        low = low.encode("utf-8").decode("latin-1").translate(_SHOWN)
                    ids = stems[letters] = tuple([t.id for t in merge(low)])
                if tail not in tails:
                    tails[tail] = tuple([t.id for t in merge(tail)])
                out.append(ids + tails[tail] if tail else ids)
            else:
                out.append([])
                rest.append(i)
        for i, ids in zip(rest, self.ids([words[i] for i in rest])):
            out[i] = ids
        return out


_LATIN_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")
# How byte-level models write bytes that do not print: in order, from U+0100.
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def _keeps_letters_together(spec: dict) -> bool:
    """Whether a lower-case run of letters and a run of punctuation each reach the merge model as they are, as bytes."""
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers") or []]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    runs = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (steps == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and pre[0].get("pattern", {}).get("Regex", "").endswith(runs)
            and pre[1].get("type") == "ByteLevel" and not pre[1].get("use_regex", True) and not pre[1].get("add_prefix_space", True)
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"))


def _drops_blanks(spec: dict) -> bool:
    """Whether blanks only ever separate: the split pattern keeps no white space, and the steps before look at no neighbours."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {"type": "none"}]
    plain = all(s["type"] in ("none", "NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} for s in steps)
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = pre[0]
    split = (first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
             and not re.search(r"\\s[+*?]| |\.", re.sub(r"\[\^[^]]*\\s[^]]*\]", "", first["pattern"].get("Regex", " "))))
    added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"])) for a in spec.get("added_tokens", []))
    return bool(plain and split and added)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """Loaded once in each Python worker."""
    return Encoder(path)


def pieces(text: str, size: int) -> list[str]:
    """The text cut at safe blanks into pieces of about ``size`` characters; without such blanks a piece is longer."""
    out, start = [], 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size - 1)
        if not found:
            break
        out.append(text[start:found.start()])
        start = found.end()
    out.append(text[start:])
    return out


def counts_of(texts: list[str], enc: Encoder, long_text: int = LONG_TEXT) -> np.ndarray:
    parts, owner = [], []
    for i, text in enumerate(texts):
        cut = pieces(text, long_text) if enc.cuttable and len(text) > long_text else [text]
        parts += cut
        owner += [i] * len(cut)
    return np.bincount(owner, weights=enc.counts(parts), minlength=len(texts)).astype(np.int64) if parts else np.zeros(0, np.int64)


class WordCounts:
    """Token counts of whole texts by way of their words; see ``Encoder.cuttable``. One int is kept for each word met."""

    def __init__(self, enc: Encoder):
        self._enc = enc
        self._known: dict[str, int] = {}

    def _of(self, words: list[str]) -> np.ndarray:
        if len(self._known) > _KNOWN_WORDS:
            self._known = {}
        new, size = [], 0
        for w in words:
            if w not in self._known:
                new.append(w)
                size += len(w)
                if size > CALL_BYTES:
                    self._learn(new)
                    new, size = [], 0
        self._learn(new)
        return np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))

    def _learn(self, words: list[str]) -> None:
        self._known.update(zip(words, map(len, self._enc.word_ids(words))))

    def counts(self, texts: pa.Array) -> np.ndarray:
        words, starts = split_words(texts)
        coded = words.dictionary_encode()
        of_word = self._of(coded.dictionary.to_pylist())
        total = np.zeros(len(words) + 1, np.int64)
        if len(words):
            np.cumsum(of_word[coded.indices.to_numpy(zero_copy_only=False)], out=total[1:])
        return np.diff(total[starts])


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        words = WordCounts(enc)  # of this task only
        for b in by_bytes(batches, "_text", CALL_BYTES):
            texts = filled(b.column("_text"))
            n = words.counts(texts) if enc.cuttable else counts_of(texts.to_pylist(), enc)
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array(text_sizes(texts)), pa.array(n), pa.array(n > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return map_arrow(rows, run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
