"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are gathered by Spark for each language, the
log-probability matrix (languages x 2^bits doubles, so of a size that no corpus changes) is broadcast, and texts are scored in
numpy batches: every position looks up its row of the matrix and rows are summed by text.

Training reads a bounded sample: about ``per_language`` different labelled rows of each language, chosen by a hash of key and text; rows that
repeat count once there. Prior probabilities come from all labelled rows. Scoring covers whole texts of any length.

Defined results: a null text and one without any letter get ``und`` and score 0. Rows with a null label are not learned from. Ties go
to the language that sorts first. Repeated rows each get their result, null keys are values like any other, an empty table gives an empty one. Without labelled rows every text is ``und``. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from marshline.llm.arrow import by_bytes, filled, map_arrow

UNDETERMINED = "und"
BITS, ORDERS = 16, 3
CALL_BYTES, LONG_TEXT = 512 << 10, 256 << 10
_KEYS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x 2^bits


def gram_rows(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of the texts laid end to end: for each n one bucket per position, and where each text starts.

    A separator stands after each text; n-grams that touch one get bucket 2^bits.
    """
    code = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    outside = np.zeros(len(code), bool)
    outside[starts[1:] - 1] = True
    outside[-1] = True
    grams, h, off = [], np.zeros(len(code), np.uint32), np.zeros(len(code), bool)
    for n in range(ORDERS):
        if n < len(code):
            h[:len(code) - n] = (h[:len(code) - n] ^ code[n:]) * _KEYS[n]
            h ^= h >> np.uint32(15)
            off[:len(code) - n] |= outside[n:]
        off[max(len(code) - n, 0):] = True
        mixed = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
        grams.append(np.where(off, np.uint32(1 << BITS), mixed))
    return grams, starts


def lowered(texts: pa.Array) -> list[str]:
    return pc.utf8_lower(filled(texts)).to_pylist()


def segments(text: str) -> tuple[list[str], list[str]]:
    """Overlapping pieces of a long text, and the overlaps, whose n-grams count twice in the pieces."""
    step = LONG_TEXT
    cut = [text[i:i + step + ORDERS - 1] for i in range(0, max(len(text) - ORDERS + 1, 1), step)]
    return cut, [text[i:i + ORDERS - 1] for i in range(step, max(len(text) - ORDERS + 1, 1), step)]


def log_likelihoods(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows of each text's n-grams. ``table``: (2^bits + 1) x languages, last row zero."""
    if not texts:
        return np.zeros((0, table.shape[1]))
    long = [i for i, t in enumerate(texts) if len(t) > LONG_TEXT]
    if long:
        out = np.zeros((len(texts), table.shape[1]))
        rest = [i for i in range(len(texts)) if len(texts[i]) <= LONG_TEXT]
        out[rest] = log_likelihoods([texts[i] for i in rest], table)
        for i in long:
            cut, twice = segments(texts[i])
            out[i] = sum(_sums([c], table)[0] for c in cut) - (_sums(twice, table).sum(axis=0) if twice else 0)
        return out
    return _sums(texts, table)


def _sums(texts: list[str], table: np.ndarray) -> np.ndarray:
    grams, starts = gram_rows(texts)
    return sum(np.add.reduceat(table[g], starts, axis=0) for g in grams)


def train(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = 2000,
          smoothing: float = 0.5) -> LanguageModel:
    """Fit on the rows of ``df`` with a label."""
    labelled = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"), F.col(key).alias("_key"))
    found = labelled.groupBy("_lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("_key", "_text"), 0.02).alias("d")).collect()  # one row a language
    sizes = {r["_lang"]: r["n"] for r in found}
    distinct = {r["_lang"]: r["d"] for r in found}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros((0, 1 << BITS)))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, per_language / max(distinct[n], 1)))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "_key", "_text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    sample = labelled.where(draw < share[F.col("_lang")]).dropDuplicates(["_lang", "_key", "_text"]).select(place[F.col("_lang")].alias("_l"), "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(names), (1 << BITS) + 1), np.int64)
        for b in by_bytes(batches, "_text", CALL_BYTES):
            owners = b.column("_l").to_numpy(zero_copy_only=False)
            texts = lowered(b.column("_text"))
            for i in np.unique(owners):
                for g in gram_rows([t for t, o in zip(texts, owners) if o == i])[0]:
                    counts[i] += np.bincount(g, minlength=counts.shape[1])
        at = np.nonzero(counts[:, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(counts[at])], names=["l", "g", "n"])

    # At most languages x 2^bits rows reach the driver, however large the corpus.
    rows = map_arrow(sample, count, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(names), 1 << BITS), smoothing)
    counts[rows["l"].to_numpy(), rows["g"].to_numpy()] += rows["n"].to_numpy()
    total = np.array([sizes[n] for n in names], float)
    return LanguageModel(names, np.log(total / total.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)))


def predict(df: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None,
            label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``carry`` (all but ``text`` if None), the predicted language and its posterior probability."""
    carry = [c for c in df.columns if c != text] if carry is None else list(carry)
    if {label, score} & set(carry):
        raise ValueError(f"name the results otherwise: {sorted({label, score} & set(carry))} are columns already")
    kinds = dict(df.dtypes)
    table = np.vstack([model.log_prob.T, np.zeros((1, len(model.languages)))])
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, table = shared.value
        for b in by_bytes(batches, "_text", CALL_BYTES):
            texts = filled(b.column("_text"))
            known = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False) & bool(names)
            labels, scores = np.full(b.num_rows, UNDETERMINED, object), np.zeros(b.num_rows)
            if known.any():
                logs = log_likelihoods(lowered(texts.filter(pa.array(known))), table) + prior
                best = logs.argmax(axis=1)
                labels[known] = np.array(names, object)[best]
                scores[known] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(labels, pa.string()), pa.array(scores)], names=[*carry, label, score])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry)
    rows = df.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("_text"))
    return map_arrow(rows, run, f"{schema}, `{label}` string, `{score}` double")


def held_out(key: str = "doc_id", part: int = 2, parts: int = 4) -> Column:
    """Whether a row belongs to the part that is never learned from; rows without a key are learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))
