"""Operators that judge rows one by one: byte-pair encoding, quality rules, language identification."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbmark.llm import bpe, langid, quality
from ebbmark.llm.common import id_remainder
from tests.llm.conftest import TEXTS

PIECES = ["'s", "'ll", "'", "!", " ", "  ", "\n", "\t", "\r\n", "a", "Z", "é", "ñ", "1", "23", "<|endoftext|>", "<|", "|>", "...", " ", "　",
          "中文", "😀", "\u0085", "-", "'re", "²", "_", "ü ", "ü ", "Ö\n"]


def test_fragments_encode_like_the_whole_text():
    codec, library, rng = bpe.Codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path()), random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(14)))
        ids = codec.encode([text])[0]
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_no_token_spans_a_cut():
    codec = bpe.Codec(bpe.default_path())
    for token in codec.bytes_of.values():
        b = np.frombuffer(token, np.uint8)
        assert not codec.cuts[b[:-1], b[1:]].any()


def test_memo_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 4)
    codec, library = bpe.Codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    for text in ["one two three four", "five four", "a considerably longer word", "one two three four"] * 2:
        assert codec.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_encoding_of_odd_rows(docs, no_docs):
    library = Tokenizer.from_file(bpe.default_path())
    coded = bpe.encode(docs, bpe.default_path(), doc_id=F.col("doc_id"))
    assert coded.columns == ["doc_id", "ids"]
    assert [(r.doc_id, r.ids) for r in coded.collect()] == [
        (i, library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in TEXTS]
    assert [r.text for r in bpe.decode(coded, bpe.default_path()).collect()] == [t or "" for _, t, *_ in TEXTS]
    assert bpe.encode(no_docs, bpe.default_path(), doc_id=F.col("doc_id")).collect() == []


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    lines_with_word = [(i, x) for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    duplicate = sum(any(y == x for j, y in enumerate(lines[:i])) for i, x in lines_with_word)
    spans = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, s in enumerate(spans) if spans.count(s) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicate, len(covered))


def test_quality_counts_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", "#", " ", " ", "\n", "a b a b a b a b ", "\t", "<x>"]) for _ in range(rng.randrange(60)))
        assert quality.counts(text) == brute_counts(text), text


def test_quality_verdicts():
    compressor, rng = quality.Compressor(quality.Bands()), random.Random(1)
    syllables = ["an", "re", "the", "ti", "on", "ver", "le", "sha", "kom", "pi", "ou", "ent"]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(1500))
    assert compressor.verdict(prose.encode())[2]
    assert not compressor.verdict(b"buy now cheap " * 300)[2]
    assert not compressor.verdict("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000)).encode())[2]
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9000))
    for n, bad in ((2048, 2000), (5000, 5000), (9000, 9000)):  # prose, then noise or one phrase over and over
        assert compressor.verdict(prose[:n].encode())[2]
        assert not compressor.verdict((prose[:n] + noise[:bad]).encode())[2] and not compressor.verdict((prose[:n] + "buy now " * (bad // 8)).encode())[2]
    mixed = prose[:3000] + "x" * 12_000  # the whole passes its band, most chunks do not
    assert compressor.verdict(mixed.encode())[1] > 0.5 and not compressor.verdict(mixed.encode())[2]


def test_quality_of_odd_rows(docs, no_docs):
    rows = quality.judge(docs, doc_id=F.col("doc_id")).collect()
    assert [r.n_words for r in rows] == [len((t or "").split(" ")) if i == 5 else brute_counts(t or "")[0] for i, t, *_ in TEXTS]
    by = {r.doc_id: r for r in rows}
    assert by[1].base_failed and not by[1].kept and by[8].n_dup_lines == 2
    assert quality.judge(no_docs).collect() == []


def test_language_windows_count_each_gram_once():
    text = ("Großer Bär, kleiner Bär. " * 50).encode()
    a, b = langid.features(text, langid.Settings()), langid.features(text, langid.Settings(), window=7)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held), "text", "lang", "doc_id")
    assert {(l, a, b) for l, a, b in model.pairs} == {("family", "germanic", "romance"), ("germanic", "de", "en"), ("romance", "es", "fr")}
    rows = langid.predict(docs.where(held), model, lang=F.col("lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(docs, no_docs):
    model = langid.fit(docs, "text", "lang", "doc_id")
    by = {r.doc_id: r.lang_pred for r in langid.predict(docs, model, doc_id=F.col("doc_id")).collect()}
    assert by[1] == by[2] == by[3] == "und" and by[5] == "de" and set(by.values()) <= {"en", "de", "fr", "es", "und"}
    empty = langid.fit(no_docs, "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'de'"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"und", "de"}
    assert langid.predict(no_docs, model).collect() == []


@pytest.mark.parametrize("code,family", [("en", "germanic"), ("fr", "romance"), ("tlh", "tlh")])
def test_unknown_language_is_its_own_family(code, family):
    assert langid.family(code) == family
