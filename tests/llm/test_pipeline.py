"""The stages one after another: each one's decisions show in what the next one gets."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from ternary_rules.llm.queries import QUERIES  # noqa: E402

from .helpers import DOCS, SENTENCES, clashing  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(8), []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        words = SENTENCES[lang].split()
        body = " ".join(rng.choice(words) for _ in range(40))
        rows.append((i, f"{body}\na notice that every page repeats", lang, f"src{i % 4}", 0))
    rows += [(200, "12345 !!! ###", "en", "src0", 0), (201, None, None, None, 0), (202, rows[0][1], "en", "src1", 0)]
    path = tmp_path_factory.mktemp("sf")
    clashing(spark.createDataFrame(rows, DOCS)).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder).cache()
        seen[name] = found.collect()
        if name != "sentencepiece":
            assert found.columns == names
            docs = spark.createDataFrame(seen[name], found.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    ids = {r["doc_id"] for r in seen["language_id"]}
    assert ids == {*range(90), 202}
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert "notice" in lines[0] and not any("notice" in t for i, t in lines.items() if i) and lines[202] == ""
    kept = [r["doc_id"] for r in seen["simhash_near_dedup"]]
    assert len(kept) == len(set(kept)) <= len(ids) and 0 in kept
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["simhash_near_dedup"])) <= 4
    assert len(seen["sentencepiece"]) == len(seen["mixing"])


def test_language_stage(spark, folder):
    """Long texts in a language that was not learned, and random letters, go; short clean ones stay."""
    rng = random.Random(5)
    letters = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 5
    more = spark.createDataFrame([(300, letters, None, "s", 0), (301, finnish, None, "s", 0), (302, "in", None, "s", 0), (303, "une maison", None, "s", 0)], DOCS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = corpus_pipeline.keep_known_languages(spark, docs.select(*more.columns).unionByName(more), folder)
    assert {r["doc_id"] for r in found.collect()} == {*range(90), 202, 302, 303}


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 90


def test_queries_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
