"""Near-duplicate vectors by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and fast Hadamard transforms; a hash is the
axis nearest to the rotated vector, with its sign. Several hashes make a table's bucket key, and
the next nearest axes give further buckets (multiprobe). Vectors that meet in a bucket are compared
by exact cosine. A bucket beyond CELL_ROWS is cut into parts, and every two parts meet in a cell of
their own, so no task gets a large bucket whole. A pair that shares several buckets counts in the
first of them only, which each side can tell from the keys that travel with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, small_batches, stored
from .graph import components

CELL_ROWS = 1024
#: Pairs whose keys are compared at a time.
FLAT_PAIRS = 200_000


class CrossPolytope:
    """tables x hashes rotations of `dim` components; `probes` keys per table."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int = 7):
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, probes
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, 3, self.width))

    def _rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for s in signs:
            y = y * s
            h = 1
            while h < self.width:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
                h *= 2
            y = y.reshape(len(x), self.width) / np.sqrt(self.width)
        return y

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the bucket of the nearest axes, then those that move one hash, or
        several, to a next nearest axis, in order of what this costs in all."""
        out = np.empty((len(x), self.tables, self.probes), dtype=np.int64)
        depth = 3
        ways = np.array(sorted(product(range(depth), repeat=self.hashes), key=sum))
        for t in range(self.tables):
            axes, costs = [], []
            for k in range(self.hashes):
                y = self._rotate(x, self.signs[t, k])
                size = np.abs(y)
                best = np.argsort(-size, axis=1, kind="stable")[:, :depth]
                value = np.take_along_axis(size, best, axis=1)
                axes.append(2 * best + (np.take_along_axis(y, best, axis=1) < 0))
                costs.append(value[:, :1] - value)
            cost = sum(c[:, ways[:, k]] for k, c in enumerate(costs))
            order = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            key = np.zeros((len(x), self.probes), dtype=np.int64)
            for k, a in enumerate(axes):
                key = key * (2 * self.width) + np.take_along_axis(a, ways[order, k], axis=1)
            out[:, t] = key
        return out


def plan_for(vectors: int) -> tuple[int, int, int]:
    """tables, hashes and probes for so many vectors: more vectors take longer keys, so that buckets
    keep their size, and more tables and probes, so that the recall stays: each of the three finds
    over 0.9999 of 40,000 random pairs of 64 components at cosine 0.98, and more of closer ones."""
    return (4, 1, 2) if vectors <= 500_000 else (4, 2, 4) if vectors <= 500_000_000 else (6, 3, 6)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that can link."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.coalesce(~bad & F.exists(e, lambda c: c != 0), F.lit(False))
    return vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull()).where(good).select(F.col("vec_id").cast("long"), "label", e.alias("embedding"))


def _verified(group: dict[str, np.ndarray], crossing: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one cell: rows with a link, the sum of the copies they link to in this bucket, and the row
    with the least id that each is connected to here."""
    x, ids, copies, keys, table, key, part = (group[c] for c in ("x", "vec_id", "copies", "keys", "table", "key", "part"))
    n = len(ids)
    near = x @ x.T >= least
    near &= near.T
    if crossing:
        near &= part[:, None] != part[None, :]
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    links = np.zeros(n, dtype=np.int64)
    for a in range(0, len(i), FLAT_PAIRS):
        p, q = i[a : a + FLAT_PAIRS], j[a : a + FLAT_PAIRS]
        shared = (keys[p][:, :, :, None] == keys[q][:, :, None, :]).any(axis=3)  # pairs, tables, probes of p
        earlier = shared[:, : int(table)].any(axis=(1, 2))
        least_key = np.where(shared[:, int(table)], keys[p][:, int(table)], np.iinfo(np.int64).max).min(axis=1)
        new = ~earlier & (least_key == key)
        np.add.at(links, p[new], copies[q[new]])
        np.add.at(links, q[new], copies[p[new]])
    order = np.argsort(ids)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    linked = near.any(axis=1)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[order[new]]
        if (new == label).all():
            break
        label = new
    return np.flatnonzero(linked), links, ids[order[label]]


def links(reps: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, links, root) rows of each cell, to be summed by vec_id: links counts the copies that
    a vector links to in this cell, root is a vector that it is connected to. reps: a stored table
    (vec_id, label, embedding, copies) of distinct vectors."""
    spark = reps.sparkSession
    n, dim = reps.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "vec_id long, links long, root long")
    tables, hashes, probes = plan_for(n)
    small_batches(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CrossPolytope(dim, tables, hashes, probes)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("embedding").to_pylist()
            x = np.zeros((len(rows), dim))
            size = np.array([len(v) for v in rows])
            for k, v in enumerate(rows):
                x[k, : len(v)] = v
            scale = np.abs(x).max(axis=1, keepdims=True)
            x /= scale  # components near the limits of a double would overflow in the norm
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            keys = own.keys(x).reshape(len(x), -1).astype("<i8")
            raw = [r.tobytes() for r in np.ascontiguousarray(x.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("copies"), pa.array(size, pa.int32()), pa.array(raw, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["vec_id", "label", "copies", "size", "x", "keys"])

    label = dict(reps.dtypes)["label"]
    known = stored(reps.mapInArrow(hashed, f"vec_id long, label {label}, copies long, size int, x binary, keys array<long>"))
    # one row per bucket first, without the vectors: sizes of buckets
    place = F.posexplode("keys").alias("at", "key")
    light = known.select("vec_id", "label", "size", place).withColumn("table", F.floor(F.col("at") / probes).cast("int")).drop("at")
    bucket = ["label", "size", "table", "key"]
    counts = stored(light.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    met = light.join(counts, bucket).withColumn("parts", F.ceil(F.col("rows") / CELL_ROWS).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("vec_id", "table"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = met.select("vec_id", *bucket, "part", other).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")
    rows = cells.join(known.select("vec_id", "copies", "x", "keys"), "vec_id")
    cell = [*bucket, "low", "high"]
    parts = int(max(8, min(n * tables * probes // 50_000 + 1, 100_000), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartition(parts, *cell).sortWithinPartitions(*cell)

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            first = frame.iloc[0]
            group = {"x": np.frombuffer(b"".join(frame["x"]), "<f8").reshape(len(frame), -1), "vec_id": frame["vec_id"].to_numpy(), "copies": frame["copies"].to_numpy(), "keys": np.stack(frame["keys"].to_numpy()).reshape(len(frame), tables, probes), "table": first["table"], "key": first["key"], "part": frame["part"].to_numpy()}
            at, n_links, root = _verified(group, first["low"] != first["high"], least)
            return group["vec_id"][at], n_links[at], root[at]

        def out(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({c: np.concatenate([f[k] for f in found]) if found else np.empty(0, dtype=np.int64) for k, c in enumerate(("vec_id", "links", "root"))})

        for frame in frames:
            if not len(frame):
                continue
            frame = pd.concat([*held, frame], ignore_index=True) if held else frame
            cuts = np.flatnonzero((frame[cell].to_numpy()[1:] != frame[cell].to_numpy()[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            yield out([done(frame.iloc[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1])
            held = [frame.iloc[bounds[-1] :]]
        if held and len(held[0]) > 1:
            yield out([done(held[0])])

    return dealt.select("vec_id", *cell, "part", "copies", "x", "keys").mapInPandas(verify, "vec_id long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).
    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine
    is at least `least`. Null, empty or zero vectors, and those with null or non-finite components,
    link with nothing. n_links counts other ids, component_id is the least id reachable, kept tells
    whether that is the row's own. Rows are told apart by vec_id: repeats share one result. Exact
    copies are hashed and compared once."""
    # 128 bits stand for a label and vector; the vectors themselves move once, to find the distinct ones
    same = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2")]
    own = usable(vectors).select("vec_id", "label", "embedding", *same)
    ids = stored(own.select("vec_id", "h1", "h2").distinct())
    copies = ids.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = own.groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    reps = stored(distinct.join(copies, ["h1", "h2"]))
    found = stored(links(reps.select(F.col("rep").alias("vec_id"), "label", "embedding", "copies"), least))
    counted = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    known = reps.select("h1", "h2", "rep", "copies").join(counted, "rep", "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = stored(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")))
    members = join_skewed(ids, known, ["h1", "h2"]).select(F.col("vec_id").alias("__id"), "n", "component")
    members = members.groupBy("__id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long")).join(members, F.col("vec_id") == F.col("__id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
