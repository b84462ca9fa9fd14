"""Near duplicates and top-k against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ternary_rules.llm import embedding_dedup, vector_search
from ternary_rules.llm.embedding_dedup import CrossPolytope, near_duplicates
from ternary_rules.llm.vector_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.09 * rng.normal(size=(n, dim))
    x[5] = x[6] = x[7]
    return x.astype(np.float32), rng.integers(0, 3, n)


def brute(x, labels, least=0.98):
    x = x.astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = (x @ x.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    group = np.arange(len(x))
    while True:
        new = np.minimum(group, np.where(near, group[None, :], len(x)).min(axis=1))
        if (new == group).all():
            return near.sum(axis=1), group
        group = new


@pytest.mark.parametrize("plan", [embedding_dedup.plan_for(n) for n in (1, 10**6, 10**9)])
def test_recall_and_precision(spark, monkeypatch, plan):
    monkeypatch.setattr(embedding_dedup, "plan_for", lambda n: plan)
    x, labels = clustered(600)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))]
    found = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    n_links, group = brute(x, labels)
    mine = np.array([found[i]["n_links"] for i in range(len(x))])
    assert n_links.sum() > 500 and (mine <= n_links).all() and mine.sum() >= 0.995 * n_links.sum()
    exact = mine == n_links
    assert all(found[i]["component_id"] == group[i] for i in range(len(x)) if exact[group == group[i]].all())


@pytest.mark.parametrize("n", [1, 10**6, 10**9])
def test_recall_at_the_threshold(n):
    """10,000 pairs of cosine 0.98, the hardest that count, meet in a bucket with each setting."""
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(2, 10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    own = CrossPolytope(64, *embedding_dedup.plan_for(n))
    a, b = own.keys(x), own.keys(y)
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.999


def test_large_bucket_is_cut(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 32)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=64) + 0.05 * rng.normal(size=(300, 64))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    n_links, group = brute(x, np.ones(300))
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(n_links)) and {r["component_id"] for r in found} == set(group)


def test_awkward_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(9, a, 1), (3, a, 1), (4, [2.0, 0.0, 0.0, 0.0], 1), (5, a, 2), (6, a, None), (7, None, 1), (8, [0.0] * 4, 1), (10, [float("nan"), 1.0, 1.0, 1.0], 1), (11, [None, 1.0, 1.0, 1.0], 1), (12, b, 1), (12, b, 1), (13, [], 1), (14, [1.0, 0.0], 1), (15, [float("inf"), 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = near_duplicates(df.selectExpr("*", "1 AS copies", "2 AS n", "3 AS component")).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert len(found) == len(rows)
    assert got[9] == (2, 3, False) and got[3] == (2, 3, True) and got[4] == (2, 3, False)
    assert all(got[i] == (0, i, True) for i in (5, 6, 7, 8, 10, 11, 12, 13, 14, 15))
    assert near_duplicates(df.where("1 = 0")).count() == 0


def test_rotations_keep_lengths():
    own = CrossPolytope(50, 2, 2, 3)
    x = np.random.default_rng(3).normal(size=(20, 50))
    assert np.allclose((own._rotate(x, own.signs[0, 0]) ** 2).sum(axis=1), (x**2).sum(axis=1))
    keys = own.keys(x)
    assert keys.shape == (20, 2, 3) and all(len(set(k)) == 3 for row in keys for k in row)


def nearest(ids, x, every=50, k=5):
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        score = q @ q[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out += [(int(ids[i]), n, int(ids[j]), int(score[j])) for n, j in enumerate(order, 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 5)
    x, _ = clustered(900, 16)
    x[100:400] = x[100]  # a third of all rows is one vector
    ids = np.random.default_rng(4).permutation(900)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, found.collect())) == nearest(ids, x)


def test_annuli_are_left_out(spark):
    """On clusters far apart a query looks into few blocks."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=16) * 40 + rng.normal(size=(50, 16)) for _ in range(20)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(rows).collect())) == nearest(np.arange(1000), x)


def test_few_and_awkward(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [5.0]), (100, [1e7, 1e7]), (None, [1.0, 2.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in top_k(df.selectExpr("*", "1 AS score", "2 AS q", "3 AS norm")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found[0] == [(100, 256 * 256 * 3 * 10**7), (1, 327680), (4, 327680), (50, 327680)] and set(found) == {0, 50, 100}
    assert top_k(df.where("1 = 0")).count() == 0


def test_huge_components(spark, monkeypatch):
    """A row of any finite size takes its exact place and costs no other query its answer."""
    monkeypatch.setattr(vector_search, "EXACT_ROWS", 7)
    monkeypatch.setattr(vector_search, "EXACT_QUERIES", 2)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    x[[3, 50, 77, 78]] = [[1e300, 0, 0, 0], [-1e300, 1e10, 0, 1], [1.7e308, -1.7e308, 0, 0], [1e300, 0, 0, 1]]
    x[[100, 101, 102]] *= 1e8
    x[150:160] = [3e9, 1, 2, 3]
    x[200, 0] = 2.0**52 + 1
    whole = [[math.floor(Fraction(c) * 256) for c in v.tolist()] for v in x]
    want = {}
    for i in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), j) for j in range(300) if j != i)[:5]
        want[i] = [(n, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scores, 1)]
    found = {}
    for r in top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found == want
    only = top_k(spark.createDataFrame([(50, [1e300, 0.0]), (1, [-1e300, 0.0]), (2, [2e300])], "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(only, key=lambda r: r["rank"])] == [(1, 2, 2**63 - 1), (2, 1, -(2**63))]


def test_repeated_ids(spark):
    """Rows of one id are candidates each; the id's own query takes none of them."""
    found = top_k(spark.createDataFrame([(0, [1.0]), (1, [3.0]), (1, [2.0]), (0, [9.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 3 * 65536), (2, 1, 2 * 65536)]
