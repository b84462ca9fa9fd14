"""Counts against the library's own encoding of whole texts."""

import random

import pytest

from ternary_rules.llm.token_counts import token_counts

from .helpers import clashing, documents

public = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
PATH = public.path("byte_bpe_50k.json")


def test_counts(spark):
    rng = random.Random(2)
    parts = ["'s", "'ll", "'", " ", "  ", "\n", "\t", "a", "É", "é", "1", "²", "<|endoftext|>", "!", "日本", "\x85", "\xa0", "　", "ⅷ", "՘", "🙂", "\x1c", "\x00", "the ", " of"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += [None, "", "word " * 3000, "x" * 20_000, "<|endoftext|>", "same", "same"]
    library = Tokenizer.from_file(PATH)
    rows = token_counts(clashing(documents(spark, *[(i, t, None) for i, t in enumerate(texts)])), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024), text
    assert token_counts(documents(spark, (1, "a", None)).where("1 = 0"), PATH).count() == 0
