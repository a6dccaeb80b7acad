"""Token counts, packing, language and chat: against the libraries and brute force."""

import bisect
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from marshline.llm import chat, langid, packing, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Don't STOP!! ÉCOLE naïve,. ß Ünter (a) [b] x*** y", "", None, "  \t\n ", "İstanbul ΣΑΣ <|endoftext|>x <|ENDOFTEXT|> 日本語 x́y \x1c a\x1cb",
         "ok " * 3000 + "\n" + "word" * 500, "a" * 9000, "12ab 3,4 ª º µm", "Don't STOP!! ÉCOLE naïve,. ß Ünter (a) [b] x*** y"]


def ids_of(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0, "x"), (None, "null id", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _text string")  # names that clash


def test_token_counts(spark, texts):
    got = tokens.token_counts(texts, WORDS).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len((t or "").encode()), len(ids_of(t)))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    assert tokens.token_counts(texts.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_long_texts_are_cut_only_where_it_is_safe(name):
    enc = tokens.Encoder(public_tokenizers.path(name))
    assert enc.cuttable == (name == "word_bpe_49k.json")
    given_texts = [t or "" for t in TEXTS]
    assert tokens.counts_of(given_texts, enc, long_text=50).tolist() == enc.counts(given_texts)


def test_words_give_the_counts_of_whole_texts(monkeypatch):
    given_texts = [t or "" for t in TEXTS]
    for known, call in ((300_000, 1 << 20), (3, 5)):  # also where memory is cleared and calls are short
        monkeypatch.setattr(tokens, "_KNOWN_WORDS", known)
        monkeypatch.setattr(tokens, "CALL_BYTES", call)
        words = tokens.WordCounts(tokens.Encoder(WORDS))
        for _ in range(2):
            assert words.counts(pa.array(given_texts)).tolist() == [len(ids_of(t)) for t in given_texts]
    assert words.counts(pa.array([], pa.string())).tolist() == []


def test_words_give_the_ids_of_whole_texts():
    words = packing.WordIds(tokens.Encoder(WORDS))
    given_texts = [t or "" for t in TEXTS]
    for _ in range(2):  # the second time from memory
        ids, ends = words.ids(pa.array(given_texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [ids_of(t) for t in given_texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_word_as_in_a_whole_text(text):
    enc = tokens.encoder(WORDS)
    ids, _ = packing.text_ids(pa.array([text]), enc, packing.WordIds(enc))
    assert ids.tolist() == ids_of(text)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by)


def test_packing_whole_texts(spark, texts):
    rows = packing.pack_texts(texts, WORDS, capacity=64).collect()
    check_packing(rows, 64)
    counted = {}
    for r in rows:
        t = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        ids = np.array(ids_of(t) + [1], "<u4")
        part = ids[r["start"]:r["start"] + r["length"]]
        assert r["start"] == 64 * r["piece"] and len(part) == r["length"] == min(64, len(ids) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        counted[r["doc_id"], r["piece"]] = counted.get((r["doc_id"], r["piece"]), 0) + 1
    assert counted[0, 0] == 2 and counted[2, 0] == 1  # repeated rows, null text
    assert packing.pack_texts(texts.limit(0), WORDS).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, gaps.pop(i) - n if i < len(gaps) else capacity - n)
    return len(gaps)


def test_packing_with_one_length_in_a_third_of_all_pieces(spark):
    rng = np.random.default_rng(3)
    lengths = np.concatenate([np.full(1000, 37), rng.integers(1, 101, 2000)]).tolist()
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 100, bucket_rows=50).collect()
    assert len(rows) == 3000 and check_packing(rows, 100) <= best_fit_decreasing(lengths, 100) + 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=51) if lengths else np.zeros(51, int)
    used = np.zeros(51, int)
    for pattern, times in packing.plan(counts):
        assert sum(pattern) <= 50 and times > 0
        for n in pattern:
            used[n] += times
    assert (used == counts).all()


def test_language_of_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train(docs.where("not held_out"), per_language=100)
    got = langid.predict(docs.where("held_out"), model, carry=["doc_id", "lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the hat of the", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "en"), (5, "", None), (6, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert got[6]["lang_pred"] == "en" and [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[3]["score"] == 0
    nothing = langid.train(docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(docs.withColumnRenamed("lang", "score"), model)


def test_long_texts_score_like_the_sum_of_their_parts(monkeypatch):
    table = np.vstack([np.random.default_rng(0).normal(size=(1 << langid.BITS, 3)), np.zeros((1, 3))])
    text = "".join(np.random.default_rng(1).choice(list("abc é"), 5000))
    whole = langid.log_likelihoods([text, "ab"], table)
    monkeypatch.setattr(langid, "LONG_TEXT", 700)
    assert np.allclose(langid.log_likelihoods([text, "ab"], table), whole)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[INST]", ""]), st.text(alphabet="ab\\</>s[]INT \n", max_size=30)), min_size=1, max_size=4))
def test_templates_read_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.read_back(formatted) == turns
    assert len(re.findall(r"</?s>|\[/?INST\]", formatted)) == 4 * len(turns)
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_masks(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 2, "assistant", " two </s"), (1, 1, "user", "hi"), (1, 3, "assistant", None), (1, 4, "assistant", "é😀 \\[INST]"), (2, 0, None, "x"),
            (2, 0, "assistant", said), (2, 0, "assistant", said), (None, None, "user", "y"), (3, 1, "assistant", ""), (4, 1, "assistant", "<|endoftext|>" * 3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(turns, BYTES)
    got = {r["conv_id"]: r for r in chat.digest_chats(formatted).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["loss_sha256"] == sha(" two </s" + "é😀 \\[INST]") and got[1]["turns_sha256"] == sha("user\nhi\nassistant\n two </s\nassistant\n\nassistant\né😀 \\[INST]\n")
    assert (got[2]["n_turns"], got[2]["loss_chars"]) == (3, 2 * len(said)) and got[None]["loss_chars"] == 0 and got[4]["loss_sha256"] == sha("<|endoftext|>" * 3)
    tok = chat.chat_encoder(BYTES)
    for r in formatted.collect():
        text = "".join(tok.decode(r["ids"][m["first"]:m["last"]], skip_special_tokens=False) for m in r["mask_tokens"])
        assert hashlib.sha256(chat.unescape(text).encode()).hexdigest() == got[r["conv_id"]]["loss_sha256"]
    assert chat.format_chats(turns.limit(0), BYTES).count() == 0


def plain_bayes(train_rows, texts, smoothing=0.5):
    """Language by naive Bayes, counting n-grams one by one in dictionaries."""
    from collections import Counter
    grams = lambda t: [g for n in range(1, langid.ORDERS + 1) for g in bucket(t.lower(), n)]

    def bucket(t, n):
        rows, _ = langid.gram_rows([t]) if t else ([np.zeros(0, int)] * 3, None)
        return [int(g) for g in rows[n - 1] if g < 1 << langid.BITS]

    counts, sizes = {}, Counter()
    for lang, text in train_rows:
        counts.setdefault(lang, Counter()).update(grams(text))
        sizes[lang] += 1
    out = []
    for t in texts:
        logs = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + smoothing * (1 << langid.BITS)
            logs[lang] = np.log(sizes[lang] / sum(sizes.values())) + sum(np.log((counts[lang][g] + smoothing) / total) for g in grams(t))
        out.append(max(sorted(logs), key=logs.get) if any(c.isalpha() for c in t) else "und")
    return out


def test_language_query_against_plain_counts(spark, tmp_path):
    from marshline.llm.queries import QUERIES
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect() if r["text"]]
    rows = [(r["doc_id"], r["text"][:400], r["lang"]) for r in docs] + [(1_000_001, "12 34", "en"), (1_000_002, None, "de"), (1_000_003, "wort und satz", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, str(tmp_path)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train = [(lang, text or "") for i, text, lang in rows if not held(i) and lang is not None]
    want = plain_bayes(train, [t or "" for _, t, _ in rows])
    assert [got[r[0]]["lang_pred"] for r in rows] == want and all(got[r[0]]["held_out"] == held(r[0]) for r in rows)


def test_training_draws_are_bounded_and_leave_no_language_out(spark):
    rows = [(None, "der hund und die katze", "de")] * 500 + [(7, "le chat et le chien", "fr")] * 300 + [(i, f"the cat number {i}", "en") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    spread = model.log_prob.max(axis=1) - model.log_prob.min(axis=1)
    assert model.languages == ["de", "en", "fr"] and (spread > 0).all()
    assert np.allclose(np.exp(model.log_prior), [500 / 1100, 300 / 1100, 300 / 1100])
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string, lang string"), model).count() == 0


def test_words_of_the_same_letters_are_merged_once():
    import public_tokenizers
    import pyarrow as pa

    from marshline.llm.packing import WordIds
    from marshline.llm.tokens import encoder

    enc, seen = encoder(public_tokenizers.path("word_bpe_49k.json")), []

    class Spy:
        def __init__(self, model):
            self.model = self
            self.tokenize = lambda word: seen.append(word) or model.tokenize(word)

    class Watched(type(enc)):
        def __init__(self):
            self.__dict__.update(enc.__dict__)
            self._tok = Spy(enc._tok.model)
            self.ids = enc.ids

    texts = ["River, river. River! river", "river? Ärger; Ärger, naïve 42nd", "", "River, Ärger. 42nd"]
    known = WordIds(Watched())
    for part in (texts[:2], texts[2:]):
        ids, ends = known.ids(pa.array(part))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == enc.ids(part)
    assert len(seen) > 0 and sum(w == "river" for w in seen) == 2  # as written and with a capital; five times before
