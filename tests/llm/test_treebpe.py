"""Tree concatenation and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from marshline.llm import treebpe
from marshline.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(BYTES)
ENC = treebpe.TreeEncoder(BYTES)
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()] + list("\x1c\x1d\x1e\x1f\u180e\u200b\ufeff")


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def unit_ids(text, size=treebpe.PIECE):
    return treebpe.UnitIds(ENC, size).ids([text])[0].tolist()


def test_every_kind_of_white_space():
    for c in SPACES:
        for text in (f"a{c}b, {c}b--", f"a{c}b", f"a{c}{c}b 's{c}", f"{c}a {c} b{c} ", f"!{c}'ll <|endoftext|>{c}x{c}\n{c}"):
            assert unit_ids(text) == ids_of(text), hex(ord(c))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a", "b", "'", "s", "l", " ", "\n", "1", "é", "<|endoftext|>", ".", "\u3000"]), st.characters(exclude_categories=["Cs"])), max_size=60),
       st.integers(1, 8))
def test_any_text_in_small_pieces(letters, size):
    text = "".join(letters)
    want = ids_of(text)
    assert unit_ids(text) == want and unit_ids(text, size) == want
    parts, out, word = [], [], 0
    for w, part in treebpe.cut(text, ENC, size):
        if parts and w != word:
            out += ENC.tree(parts)
            parts = []
        word = w
        if w:
            parts.append(ENC.merged(part))
        else:
            out += unit_ids(part)
    assert out + ENC.tree(parts) == want


@pytest.mark.parametrize("alphabet,length", [("a", 30_000), ("ab", 20_000), ("-=", 20_000), ("éa", 10_000), ("theringandof", 30_000), ("日本語", 9_000)])
def test_long_words_join_exactly(alphabet, length):
    rng = random.Random(length)
    text = "".join(rng.choice(alphabet) for _ in range(length))
    for size in (7, 100, 4096):
        assert unit_ids(text, size) == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB\u00e9\u00df\u00ff\u00d7\u00aa,.'!-<|>[]` \n1", max_size=30))
def test_plain_words(text):
    assert unit_ids(text) == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=40))
def test_decoding_any_ids(ids):
    assert ENC.decode(np.array(ids, "<u4")) == TOK.decode(ids, skip_special_tokens=False)


TEXTS = ["Don't  STOP!! <|endoftext|>x", "", None, " \t\n", "word " * 40_000, "x" * 150_000 + " tail\n", "ab" * 50_000 + "12" * 50_000 + "'s <|endoftext|>" + "!" * 70_000, "\n" * 90_000 + "a",
         "é😀" * 30_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_whole_table(spark, name):
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    rows = [(i, t, b"i", "k") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], b"", ""), (None, TEXTS[5], b"", ""), (5, TEXTS[5], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, _key string")  # names that clash
    got = treebpe.decode_ids(treebpe.encode_texts(docs, path, piece=5000), path).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        want = tok.encode(TEXTS[5 if r["doc_id"] is None else r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["text"] == tok.decode(want, skip_special_tokens=False)
    assert treebpe.decode_ids(treebpe.encode_texts(docs.limit(0), path), path).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_tree_concatenation"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ids_of(texts[r["doc_id"]])
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())


def test_columns_are_not_overwritten(spark):
    with pytest.raises(ValueError):
        treebpe.decode_ids(spark.createDataFrame([(b"", "x")], "ids binary, text string"), BYTES)
