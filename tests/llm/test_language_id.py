"""The forward sum against all segmentations, learning, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternary_rules.llm import language_id
from ternary_rules.llm.language_id import expected_counts, held_out, identify, log_probabilities, vocabulary, words_of

from .helpers import DOCS, SENTENCES, clashing

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


def segmentations(word, vocab, ids):
    if not word:
        return [[]]
    out = []
    for k in range(1, min(vocab.longest, len(word)) + 1):
        piece = ids.get(word[:k], vocab.unknown if k == 1 else None)
        if piece is not None:
            out += [[piece, *rest] for rest in segmentations(word[k:], vocab, ids)]
    return out


def test_forward_and_expectation():
    vocab = vocabulary(PATH)
    ids = {p: i for i, p in enumerate(vocab.pieces)}
    p = np.random.default_rng(0).random((vocab.size + 1, 2)) * 1e-3
    p[-1] = 0
    words = ["hello", "the", "ñandú", "x", "日本", "там", "responsibilities"]
    counts = np.array([[1.0, 2.0]] * len(words))
    total = np.zeros((vocab.size, 2))
    logs = []
    for w in words:
        ways = segmentations("▁" + w, vocab, ids)
        weight = np.array([np.prod(p[way], axis=0) for way in ways])
        logs.append(np.log(weight.sum(axis=0)))
        for way, share in zip(ways, weight / weight.sum(axis=0) * counts[0], strict=True):
            for piece in way:
                total[piece] += share
    assert np.allclose(log_probabilities(words, p, vocab), logs)
    assert np.allclose(expected_counts(words, counts, p, vocab), total)


def test_words():
    assert words_of("Ab1c-É x" + "y" * 70) == ["ab", "c", "é", "x" + "y" * 70]


def test_whole_vocabulary_and_long_words(monkeypatch):
    """Every piece of letters takes part, and a word of any length is summed whole: both ways give
    the same, and the same as a plain program."""
    vocab = vocabulary(PATH)
    assert vocab.longest == 16 == max(map(len, vocab.pieces))
    rng = np.random.default_rng(1)
    p = rng.random((vocab.size + 1, 3)) * 1e-3
    p[-1] = 0
    words = ["internationalisation" * 2, "日本語" * 30, "a" * 33, "thequickbrownfox" * 20]
    counts = rng.random((len(words), 3))
    monkeypatch.setattr(language_id, "CHUNK_LETTERS", 37)
    logs, total = log_probabilities(words, p, vocab), expected_counts(words, counts, p, vocab)
    ids = {x: i for i, x in enumerate(vocab.pieces)}
    for w, row in zip(words, logs, strict=True):
        marked = "▁" + w
        for lang in range(3):
            best = [0.0]
            for end in range(1, len(marked) + 1):
                ways = [best[end - k] + np.log(p[ids.get(marked[end - k : end], vocab.unknown), lang]) for k in range(1, min(vocab.longest, end) + 1) if k == 1 or marked[end - k : end] in ids]
                best.append(np.logaddexp.reduce(ways))
            assert row[lang] == pytest.approx(best[-1])
    monkeypatch.setattr(language_id, "WORD_LETTERS", 95)
    assert np.allclose(log_probabilities(words[:3], p, vocab), logs[:3])
    both = expected_counts(words[:3], counts[:3], p, vocab)
    monkeypatch.setattr(language_id, "WORD_LETTERS", 32)
    assert np.allclose(both, expected_counts(words[:3], counts[:3], p, vocab))
    lengths = np.array([*map(len, vocab.pieces), 1])
    assert np.allclose(lengths @ total, np.array([len(w) + 1 for w in words]) @ counts)  # every letter is in one piece


def sample(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        words = SENTENCES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(25)), lang if i % 11 else None, "s", 0))
    return [*rows, (900, None, "en", "s", 0), (901, "123 !?", "en", "s", 0), (902, "der hund und die katze " * 4000, None, "s", 0), (None, SENTENCES["fr"], "fr", "s", 0), (903, SENTENCES["en"], "en", "s", 0), (903, SENTENCES["en"], "en", "s", 0), (904, "derhundunddiekatze" * 2000, None, "s", 0)]


def test_held_out_accuracy(spark):
    rows = sample(spark)
    docs = spark.createDataFrame(rows, DOCS)
    found = identify(clashing(docs), PATH, fit_docs=60).collect()
    assert len(found) == len(rows)
    truth = {i: ["en", "de", "fr"][i % 3] for i in range(240)} | {900: "und", 901: "und", 902: "de", 903: "en", None: "fr", 904: "de"}
    for r in found:
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == out and r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1
        assert (r["score"] == 0) == (r["lang_pred"] == "und")


def test_labels_of_held_out_documents_are_not_seen(spark):
    rows = sample(spark)
    out = held_out(F.col("doc_id"))
    docs = spark.createDataFrame(rows, DOCS)
    wrong = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted(map(str, identify(df, PATH, 60).collect()))
    assert key(wrong) == key(docs)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None, None, 4)], DOCS)
    assert [(r["lang_pred"], r["score"]) for r in identify(docs, PATH).collect()] == [("und", 0.0)]
    assert identify(docs.where("1 = 0"), PATH).count() == 0
