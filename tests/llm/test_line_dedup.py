"""Line decisions against plain Python; insertions and deletions against building anew."""

import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ternary_rules.llm.common import stored
from ternary_rules.llm.line_dedup import CuckooFilter, LineIndex, _probe, dedup

from .helpers import clashing, documents


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def expected(texts):
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def sample():
    rng = random.Random(4)
    lines = ["short", "", "  Common Line Number One \r", "common line number one", "ÉÉÉÉÉÉÉÉÉÉ", "éééééééééé", "ÉÉÉÉÉÉÉÉÉ", "　wide space line", "x" * 30_000, *[f"line that only some hold {i}" for i in range(30)]]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for i in range(120)}
    return texts | {200: None, 201: "", 202: "\n", 203: "one line of its own\none line of its own"}


def decisions(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()}


def test_decisions(spark):
    texts = sample()
    docs = documents(spark, *[(i, t, "s") for i, t in texts.items()])
    found = dedup(clashing(docs))
    assert decisions(found) == expected(texts)
    assert [c for c in clashing(docs).columns if c not in found.columns] == []
    assert dedup(docs.where("1 = 0")).count() == 0


def test_repeats_and_missing_ids(spark):
    line = "a line that all of them hold"
    rows = dedup(documents(spark, (1, line, "a"), (1, line, "a"), (None, line, "b"), (2, line, "c"))).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 1)]


def test_incremental_is_reversible(spark):
    texts = sample()
    docs = documents(spark, *[(i, t, "s") for i, t in texts.items()])
    parts = [docs.where(f"doc_id % 3 = {k}") for k in range(3)]
    index = LineIndex(spark, shards=3)
    for p in parts:
        index.insert(p)
    index.insert(parts[0])  # known already
    assert decisions(index.resolve(docs)) == expected(texts)
    index.delete(parts[1])
    rest = {i: t for i, t in texts.items() if i % 3 != 1}
    assert decisions(index.resolve(parts[0].unionByName(parts[2]))) == expected(rest)
    assert index.filters.agg({"n_keys": "sum"}).first()[0] == index.counts().count()
    index.insert(parts[1])
    assert decisions(index.resolve(docs)) == expected(texts)


def test_hot_line(spark):
    line = "a line in most of the documents"
    texts = {i: f"{line}\nline of document {i} alone" for i in range(400)}
    assert decisions(dedup(documents(spark, *[(i, t, "s") for i, t in texts.items()]))) == expected(texts)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    rng.shuffle(keys)
    own = CuckooFilter(3000)
    for a in range(0, 3000, 500):
        own.add(keys[a : a + 500])
    assert own.contains(keys[:3000]).all() and len(own) == 3000 <= own.room
    assert own.contains(keys[3000:]).mean() < 0.01
    own.remove(keys[:1000])
    assert len(own) == 2000 and own.contains(keys[1000:3000]).all() and own.contains(keys[:1000]).mean() < 0.02
    again = CuckooFilter.from_bytes(own.to_bytes())
    assert (again.contains(keys) == own.contains(keys)).all()


def test_removals_never_hide_other_keys():
    """300,000 keys in a filter near its limit; also far more keys than it has room for."""
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 300_000))
    rng.shuffle(keys)
    own = CuckooFilter(300_000)
    own.add(keys[:100_000])
    own.add(keys[100_000:])
    for a in range(100_000, len(keys), 25_000):
        own.remove(keys[a : a + 25_000])
        assert own.contains(keys[:100_000]).all()
    assert len(own) == 100_000
    tiny = CuckooFilter(16)
    tiny.add(keys[:200])
    assert len(tiny.stash) and tiny.contains(keys[:200]).all() and len(tiny) == 200
    tiny.remove(keys[50:200])
    assert tiny.contains(keys[:50]).all() and len(tiny) == 50
    tiny.remove(keys[:50])
    assert len(tiny) == 0


def test_index_after_deletion_is_one_built_anew(spark):
    """300,000 keys; the second insertion overfills the filters, so they are built anew."""
    refs = spark.range(300_000).select((F.col("id") % 3000).alias("doc_id"), F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo"))
    stay, go = (stored(refs.where(c)) for c in ("doc_id % 3 = 0", "doc_id % 3 > 0"))
    index = LineIndex(spark, shards=4).insert_refs(stay).insert_refs(go)
    assert index.filters.agg({"n_keys": "sum"}).first()[0] == 300_000
    index.delete(go.select("doc_id"))
    held = stay.select("hi", "lo").withColumn("shard", F.pmod("hi", F.lit(4)).cast("int"))
    probed = held.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(_probe, "shard int, hi long, lo long, maybe boolean")
    assert probed.where("not maybe").count() == 0
    anew = LineIndex(spark, shards=4).insert_refs(stay)
    assert index.live().exceptAll(anew.live()).count() == 0 == anew.live().exceptAll(index.live()).count()
    count = lambda x: {r["shard"]: r["n_keys"] for r in x.filters.collect()}
    assert count(index) == count(anew)
    index.insert_refs(go)
    assert index.live().count() == 300_000 and index.counts().where("refs = 1").count() == 300_000
