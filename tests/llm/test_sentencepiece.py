"""Merge rounds against the library: ids, decoding, and round trips."""

import hashlib
import random

import pytest

from ternary_rules.llm.sentencepiece_codec import MergeCodec, decode, encode, encode_decode

from .helpers import clashing, documents

tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return MergeCodec(PATH)


def awkward():
    rng = random.Random(1)
    alphabet = " \n\t▁abcdethEINR.,!<>0129é日𠀀\x00　ﬁ\xa0  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*texts, "", " ", "a" * 5000, " " * 1000, "ab" * 3000, "aaaaaaab" * 50, "=" * 240, "-" * 333, "\n\n\n   \n", "<s> </s> <0x41> <unk>"]


def test_ids_and_text(codec, library):
    texts = awkward()
    ids = codec.encode(texts)
    assert ids == library.encode(texts)
    assert [codec.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_any_ids_decode(codec, library):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(3, 32000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_query(spark, library):
    texts = [*awkward()[:300], None, "again", "again"]
    docs = documents(spark, *[(i, t, "s") for i, t in enumerate(texts)])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in encode_decode(clashing(docs), PATH).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert encode_decode(docs.where("1 = 0"), PATH).count() == 0
    back = decode(encode(docs, PATH), PATH)
    for r in back.collect():
        assert r["text"] == (texts[r["doc_id"]] or "").replace("▁", " ")
