"""Fingerprints and classes against all pairs; components against union-find."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ternary_rules.llm.graph import components
from ternary_rules.llm.simhash import keep_one, links, near_duplicates

from .helpers import clashing, documents

xxhash = pytest.importorskip("xxhash")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def sample():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 60, 400]))) for _ in range(25)]
    texts = list(base)
    for t in base:
        words = t.split()
        for _ in range(4):
            near = list(words)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    return [*texts, None, "", " \n ", "One two", "ONE TWO", "É é", "é É", "a b c d", "word " * 5000]


def test_classes(spark):
    texts = sample()
    own = {i: fingerprint(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() <= 4]
    expected = classes(pairs, own)
    rows = near_duplicates(clashing(documents(spark, *[(i, t, None) for i, t in enumerate(texts)]))).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == own
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert len(set(expected.values())) < len(texts) - 10


def test_links_find_every_pair(spark):
    rng = random.Random(6)
    values = set()
    while len(values) < 150:
        v = rng.getrandbits(64)
        values.add(v)
        for flips in (1, 2, 4, 5):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    ordered = sorted(values, key=signed)
    expected = {(signed(a), signed(b)) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 4}
    for pieces in (None, 5, 7):  # with pieces of the other bits in the key too
        rows = links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), pieces=pieces).collect()
        assert sorted((r["u"], r["v"]) for r in rows) == sorted(expected)
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long"), pieces=4)
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long"), 6)


def test_awkward(spark):
    docs = documents(spark, (1, "same text", "b"), (1, "same text", "a"), (None, "same text", "c"), (3, None, "d"), (4, "", "d"), (2, "Same TEXT", "d"))
    rows = near_duplicates(docs).collect()
    assert len(rows) == 6 and {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (None, 1), (2, 1), (3, 3), (4, 3)}
    kept = keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted((r["doc_id"] or 0, r["source"]) for r in kept.collect()) == [(0, "c"), (1, "a"), (3, "d")]
    assert near_duplicates(docs.where("1 = 0")).count() == 0 and keep_one(docs.where("1 = 0")).count() == 0


def test_ids_with_several_texts(spark):
    """A text that nothing repeats stays, though another one has its id."""
    docs = documents(spark, (1, "a text that others repeat", "a"), (1, "b words that nobody else wrote in any document", "a"), (2, "a text that others repeat", "b"), (3, "c words of which the second copy stands under one", "c"), (2, "c words of which the second copy stands under one", "c"))
    kept = sorted((r["doc_id"], r["text"][0]) for r in keep_one(docs).collect())
    assert kept == [(1, "a"), (1, "b"), (2, "c")]


def test_hot_group(spark):
    docs = documents(spark, *[(i, "one text that a third of all documents share", "s") for i in range(300)], *[(1000 + i, f"text {i} of its own with words {i * 7}", "s") for i in range(50)])
    rows = near_duplicates(docs).where("doc_id < 300")
    assert rows.where("component_id = 0").count() == 300


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)] + [(5, 5)]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["component"] for r in rows} == classes([e for e in edges if e[0] != e[1]], nodes) and len(rows) == len(nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.range(1).select(F.col("id").alias("u"), F.col("id").alias("v"))).count() == 0
