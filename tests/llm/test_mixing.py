"""Targets by hand, exact totals, and the permutation's bijection."""

import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ternary_rules.llm.common import stored
from ternary_rules.llm.mixing import drawn, mixed_documents, permuted, plan_mix, slots, taken, targets, words_in

from .helpers import clashing, documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, out, free = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while free:
        rest, weights = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / weights > 2 * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / weights for s in free}
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        free -= over
    return out


def sample():
    rows = [(i, "w " * (i % 37), ["hot", "hot", "b", "é", None][i % 5]) for i in range(300)]
    return [*rows, (900, "long " * 9000, "hot"), (901, None, "b"), (902, "", "empty"), (903, "a　b c\x0bd", "z"), (904, "same", "b"), (904, "same", "b"), (None, "no id", "b")]


@pytest.mark.parametrize("block", [4, 256])
def test_taken(spark, block):
    rows = sample()
    docs = documents(spark, *rows)
    found = taken(clashing(docs), block).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    goal = by_hand(dict(sizes))
    got = Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(goal[r["source"]]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        got[r["source"]] += r["taken"]
    assert all(abs(got[s] - float(goal[s])) <= 0.5 for s in sizes)
    again = taken(docs.repartition(7), block).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert taken(docs.where("1 = 0")).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), F.lit(3)).alias("at"))
        rows = rows.withColumn("back", permuted(F.col("at"), F.lit(n), F.lit(3), inverse=True)).collect()
        assert sorted(r["at"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_slots_deal_sources_to_shards(spark):
    goals = targets(spark.createDataFrame([("a", 40_000), ("b", 90_000), ("c", 5_000)], "source string, source_size long"))
    rows = slots(goals, block_words=16, shard_blocks=512).collect()
    want = {r["source_no"]: round(r["target"]) for r in goals.collect()}
    words, places, by_shard = Counter(), set(), Counter()
    for r in rows:
        words[r["source_no"]] += r["words"]
        places.add((r["shard"], r["slot"]))
        by_shard[r["shard"], r["source_no"]] += 1
    assert words == want and len(places) == len(rows)
    n, p = 512, sum(1 for r in rows if r["source_no"] == 1) / len(rows)
    drew = [by_shard[s, 1] for s in range(len(rows) // n)]
    assert all(abs(x - n * p) < 5 * (n * p * (1 - p)) ** 0.5 for x in drew) and len(set(drew)) > 1


def test_draws_are_multinomial(spark):
    """Over 400 shards the counts vary as those of independent draws do (fixed totals would vary
    less by 1/400 only, a stratified deal hardly at all), and every index of a source is dealt once."""
    sizes = [30_000, 50_000, 20_000, 1, 2_400]
    plan = stored(spark.createDataFrame([(k, n, sum(sizes[:k])) for k, n in enumerate(sizes)], "source_no int, n_slots long, first long"))
    rows = drawn(plan, 256).collect()
    n = sum(sizes)
    assert sorted((r["source_no"], r["k"]) for r in rows) == [(s, k) for s, m in enumerate(sizes) for k in range(m)]
    assert sorted(r["shard"] * 256 + r["slot"] for r in rows) == list(range(n))
    counts = Counter((r["source_no"], r["shard"]) for r in rows)
    for s in (0, 1, 2, 4):
        p, drew = sizes[s] / n, [counts[s, k] for k in range(380)]  # the last ones settle the totals
        mean = sum(drew) / len(drew)
        assert 0.8 < sum((x - mean) ** 2 for x in drew) / len(drew) / (256 * p * (1 - p)) < 1.25
    for s in (0, 1, 2):  # an index runs over the shards in order
        early = sorted((r["k"], r["shard"], r["slot"]) for r in rows if r["source_no"] == s and r["k"] < 0.95 * sizes[s])
        assert [x[1:] for x in early] == sorted(x[1:] for x in early)


def test_taken_by_hand(spark):
    """The words of each document that the slots hold, counted by walking over every slot."""
    docs = documents(spark, *sample())
    rows = stored(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    placed, _ = plan_mix(rows, ["doc_id"], 16)
    at = placed.collect()
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    owner = {(r["source_no"], w): k for k, r in enumerate(at) for w in range(r["begin"], r["begin"] + r["size"])}
    got = Counter(owner[s["source_no"], s["block"] * 16 + w] for s in slots(goals, 16).collect() for w in range(s["words"]))
    want = sorted((r["doc_id"] or -1, r["source"] or "", r["size"], got[k]) for k, r in enumerate(at))
    assert want == sorted((r["doc_id"] or -1, r["source"] or "", r["size"], r["taken"]) for r in taken(docs, 16).collect())


def test_documents_without_words_stay_once(spark):
    """Also where their source is mixed in by two passes."""
    rows = [(i, None if i % 2 else " \n", "a") for i in range(20)] + [(100 + i, "word " * 50, "a") for i in range(4)] + [(200, "word " * 4000, "b")]
    found = Counter(r["doc_id"] for r in mixed_documents(documents(spark, *rows), 8).collect())
    assert [found[i] for i in range(20)] == [1] * 20 and [found[100 + i] for i in range(4)] == [2] * 4


def test_documents(spark):
    rows = [r for r in sample() if r[0] is not None]
    docs = documents(spark, *rows)
    mix = mixed_documents(clashing(docs), 4)
    assert mix.columns == clashing(docs).columns
    whole = {}
    for i, text, _ in rows:
        whole.setdefault(i, WORDS.findall(text or ""))
    totals = Counter()
    for r in mix.collect():
        words = WORDS.findall(r["text"] or "")
        totals[r["source"]] += len(words)
        rest = iter(whole[r["doc_id"]])
        assert all(w in rest for w in words), r["doc_id"]  # in order
        assert r["n_chars"] == len(r["text"] or "")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    assert all(abs(totals[s] - float(g)) <= 0.5 for s, g in by_hand(dict(sizes)).items())
    assert mixed_documents(docs.where("1 = 0")).count() == 0
    assert mixed_documents(docs).agg(F.sum(words_in(F.col("text")))).first()[0] == sum(totals.values())
