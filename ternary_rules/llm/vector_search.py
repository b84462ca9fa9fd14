"""Exact top-k inner products over a pivot-distance index.

An extra component makes all vectors equally long, after which a larger inner product with a query
is a smaller Euclidean distance to it. Vectors are keyed by their nearest pivot and the distance
to it, sorted by that key and packed into blocks, each an annulus around its pivot. For a query the
triangle inequality bounds all scores inside an annulus; a worker goes through its annuli from the
best bound on, and leaves out those whose bound is below the query's k-th best score so far.

Rows so long that 64-bit sums could overflow are kept apart from the index, which they would spoil:
they are scored against every query, and as queries against every row, in blocks, by extended
precision with an error bound first and by exact integers where that leaves a doubt.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, union

#: Pivots, and the sample that gives the first bounds: the vectors with the least hash of vec_id.
PIVOTS, SAMPLE = 64, 1024
BLOCK_ROWS = 1024
#: Queries that one pass over the index answers; they are sent to every worker.
QUERY_BLOCK = 8192
#: Queries that are scored against a block at a time.
CHUNK = 1024
#: Sums of squares from which a row is huge: below it no sum of products leaves 64 bits.
HUGE = 2.0**60
#: Rows and queries of a block of exact scoring.
EXACT_ROWS, EXACT_QUERIES = 256, 512
PACKED = "pivot int, near double, far double, n int, dim int, ids binary, data binary"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, q and norm of the rows that take part (no nulls, only finite components). q: floor(scale
    * x) as 64-bit integers; of huge rows, whose norm is no less than HUGE, as extended floats, which
    hold it exactly."""
    small_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, norms, huge = [], [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if any(c is None for c in v):
                    continue
                x = np.asarray(v, dtype=np.longdouble)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x)
                norm = float(min((q * q).sum(), np.longdouble(1e308))) if len(q) else 0.0
                ids.append(i)
                norms.append(norm)
                huge.append(norm >= HUGE)
                raw.append(q.tobytes() if norm >= HUGE else q.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(norms, pa.float64()), pa.array(huge, pa.bool_())], names=["vec_id", "q", "norm", "huge"])

    own = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return own.mapInArrow(run, "vec_id long, q binary, norm double, huge boolean")


def _extended(raw: list[bytes], huge: list[bool]) -> np.ndarray:
    rows = [np.frombuffer(r, np.longdouble if h else "<i8").astype(np.longdouble) for r, h in zip(raw, huge, strict=True)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=np.longdouble)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _sortable(n: int) -> str:
    """A text whose order is that of the integers."""
    digits = str(abs(n))
    return f"p{len(digits):05d}{digits}" if n >= 0 else f"n{99999 - len(digits):05d}{digits.translate(_NINES)}"


_NINES = str.maketrans("0123456789", "9876543210")
RANKED = "query_id long, vec_id long, score long, exact string"


def _exact_best(ids: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int) -> list[tuple]:
    """The k best rows of x for each of q, of any size, as RANKED."""
    dim = max(q.shape[1], x.shape[1], 1)
    q, x = _widened(q, dim), _widened(x, dim)
    score = q @ x.T
    error = (np.abs(q) @ np.abs(x).T) * (dim + 2) * np.finfo(np.longdouble).eps
    out = []
    for i in range(len(q)):
        others = np.flatnonzero(vec != ids[i])
        low = np.sort(score[i, others] - error[i, others])
        cut = low[-k] if len(low) >= k else -np.inf
        at = others[score[i, others] + error[i, others] >= cut]
        own = [int(c) for c in q[i]]
        exact = sorted(((-sum(a * int(b) for a, b in zip(own, x[j], strict=True)), int(vec[j])) for j in at))[:k]
        out += [(int(ids[i]), v, max(-(2**63), min(2**63 - 1, -s)), _sortable(-s)) for s, v in exact]
    return out


def _unpack(raw: list[bytes]) -> np.ndarray:
    sizes = [len(r) // 8 for r in raw]
    if len(set(sizes)) == 1:
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), sizes[0]).astype(float)
    out = np.zeros((len(raw), max(sizes, default=0)))
    for k, r in enumerate(raw):
        out[k, : sizes[k]] = np.frombuffer(r, "<i8")
    return out


def _widened(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _distances(x: np.ndarray, norm: np.ndarray, pivots: np.ndarray, pivot_norm: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Of rows to pivots, with the component that brings each vector to the longest one's length; a
    query has 0 there."""
    dim = max(x.shape[1], pivots.shape[1])
    own = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - norm, 0))
    theirs = np.sqrt(np.maximum(longest - pivot_norm, 0))
    square = norm[:, None] + pivot_norm[None, :] - 2 * (_widened(x, dim) @ _widened(pivots, dim).T) + (own[:, None] - theirs[None, :]) ** 2
    return np.sqrt(np.maximum(square, 0))


class PivotIndex:
    def __init__(self, blocks: DataFrame, pivots: np.ndarray, longest: float, sample_ids: np.ndarray, sample: np.ndarray):
        self.blocks, self.pivots, self.longest, self.sample_ids, self.sample = blocks, pivots, longest, sample_ids, sample

    @classmethod
    def build(cls, rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> PivotIndex:
        """rows: a stored quantised() table. Every row is indexed; only pivots and the first bounds
        come from a sample, of at most `sample` rows."""
        spark = rows.sparkSession
        n, longest = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
        longest = float(longest or 0)
        first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(pivots, sample)).collect()
        known = _unpack([bytes(r["q"]) for r in first])
        ids = np.array([r["vec_id"] for r in first], dtype=np.int64)
        centres = known[:pivots]
        centre_norm = (centres * centres).sum(axis=1)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                norm = batch.column("norm").to_numpy()
                d = _distances(_unpack(batch.column("q").to_pylist()), norm, centres, centre_norm, longest, False)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "q", "norm", "pivot", "distance"])

        def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                cuts = np.flatnonzero(np.r_[True, part["pivot"].to_numpy()[1:] != part["pivot"].to_numpy()[:-1]]).tolist()
                starts = sorted({s for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True) for s in range(a, b, BLOCK_ROWS)})
                out = []
                for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
                    one = part.iloc[a:b].sort_values("vec_id")
                    x = _unpack(one["q"].tolist())
                    out.append((int(one["pivot"].iloc[0]), one["distance"].min(), one["distance"].max(), len(one), x.shape[1], one["vec_id"].to_numpy().astype("<i8").tobytes(), x.astype("<i8").tobytes()))
                yield pd.DataFrame(out, columns=["pivot", "near", "far", "n", "dim", "ids", "data"])

        parts = int(max(1, min(n // 4096 + 1, 100_000)))
        # the hash splits equal keys: a third of all vectors may be one vector
        keyed = rows.mapInArrow(key, "vec_id long, q binary, norm double, pivot int, distance double")
        ranged = keyed.repartitionByRange(parts, "pivot", "distance", F.xxhash64("vec_id")).sortWithinPartitions("pivot", "distance", "vec_id")
        return cls(stored(ranged.mapInPandas(pack, PACKED)), centres, longest, ids, known)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, vec_id, score for every row of queries (vec_id, q, norm): its k highest
        inner products with other vectors, ties to the smaller vec_id."""
        groups = max(1, -(-queries.count() // QUERY_BLOCK))
        found = []
        for g in range(groups):
            # a bounded block of queries; hashing keeps blocks near QUERY_BLOCK
            part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).select("vec_id", "q").collect()
            if part:
                found.append(self._search_block(np.array([r["vec_id"] for r in part], dtype=np.int64), _unpack([bytes(r["q"]) for r in part]), k))
        if not found:
            return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return union(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _search_block(self, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
        norm = (q * q).sum(axis=1)
        to_pivot = _distances(q, norm, self.pivots, (self.pivots * self.pivots).sum(axis=1), self.longest, True)
        first = _Best(ids, k)
        first.offer(q, self.sample_ids, self.sample)
        shipped = self.blocks.sparkSession.sparkContext.broadcast((ids, q, norm, to_pivot, first.bound()))  # QUERY_BLOCK rows at most
        longest = self.longest

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, norm, to_pivot, bound = shipped.value
            best = _Best(ids, k, bound)
            for part in parts:
                pivot, near, far = (part[c].to_numpy() for c in ("pivot", "near", "far"))
                d = to_pivot[:, pivot]
                least = np.maximum(np.maximum(near - d, d - far), 0)
                whole = norm[:, None] + longest
                most = (whole - least * least) / 2 + 1e-3 + 1e-6 * whole  # the distances' rounding
                for b in np.argsort(-most.max(axis=0), kind="stable"):
                    open_ = np.flatnonzero(most[:, b] >= best.bound())
                    if len(open_):
                        row = part.iloc[b]
                        best.offer(q, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], "<i8").reshape(row["n"], row["dim"]).astype(float), open_)
            at, vec, score = best.rows()
            yield pd.DataFrame({"query_id": ids[at], "vec_id": vec, "score": score})

        return self.blocks.mapInPandas(run, "query_id long, vec_id long, score long")


class _Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.start = np.full(len(ids), -np.inf) if bound is None else bound
        self.query = np.empty(0, dtype=np.int64)
        self.vec = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.int64)
        self.kth = self.start.copy()
        self.kth_vec = np.full(len(ids), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        return self.kth

    def offer(self, q: np.ndarray, vec: np.ndarray, x: np.ndarray, some: np.ndarray | None = None) -> None:
        if not len(vec):
            return
        some = np.arange(len(q)) if some is None else some
        dim = max(q.shape[1], x.shape[1])
        x = _widened(x, dim)
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(dim, 1) < 2**52
        for a in range(0, len(some), CHUNK):
            at = some[a : a + CHUNK]
            own = _widened(q[at], dim)
            score = own @ x.T if exact else own.astype(np.int64) @ x.T.astype(np.int64)
            better = (score > self.kth[at, None]) | (score == self.kth[at, None]) & (vec[None, :] < self.kth_vec[at, None])
            better &= self.ids[at, None] != vec[None, :]
            i, j = np.nonzero(better)
            if len(i):
                self._merge(at[i], vec[j], score[i, j].astype(np.int64))

    def _merge(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = np.r_[self.query, query], np.r_[self.vec, vec], np.r_[self.score, score]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep = nth < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        last = nth[keep] == self.k - 1
        full = self.query[last]
        higher = self.score[last] >= self.start[full]
        self.kth[full[higher]] = self.score[last][higher]
        self.kth_vec[full[higher]] = self.vec[last][higher]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.query, self.vec, self.score


def _exact_search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """RANKED rows that hold the k best of rows for each query; both (vec_id, q, norm, huge). Queries
    come in bounded blocks, each of which goes once over rows."""
    spark = rows.sparkSession
    groups = max(1, -(-queries.count() // EXACT_QUERIES))
    found = [spark.createDataFrame([], RANKED)]
    for g in range(groups):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).collect()
        if not part:
            continue
        shipped = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in part], dtype=np.int64), [bytes(r["q"]) for r in part], [r["huge"] for r in part]))

        def run(parts: Iterator[pd.DataFrame], shipped: Any = shipped) -> Iterator[pd.DataFrame]:
            ids, raw, huge = shipped.value
            q = _extended(raw, huge)
            for part in parts:
                for a in range(0, len(part), EXACT_ROWS):
                    one = part.iloc[a : a + EXACT_ROWS]
                    best = _exact_best(ids, q, one["vec_id"].to_numpy(), _extended(one["q"].tolist(), one["huge"].tolist()), k)
                    yield pd.DataFrame(best, columns=["query_id", "vec_id", "score", "exact"])

        found.append(rows.mapInPandas(run, RANKED))
    return union(found)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of vectors (vec_id, embedding) whose vec_id is
    divisible by `every`, the k highest integer inner products with all other rows, all if fewer.
    Rows without an id, or with a null vector, or null or non-finite components take no part; a
    shorter vector counts as padded with zeros. Rows that share an id are candidates of their own,
    so an id can fill several ranks, but none of a query of that id; the first of them is the query.
    Ranks follow exact integers; a score beyond 64 bits is given as the nearest long."""
    rows = stored(quantised(vectors, scale))
    first = rows.where(F.col("vec_id") % every == 0)
    queries = first.groupBy("vec_id").agg(F.min(F.struct("q", "norm", "huge")).alias("r")).select("vec_id", "r.*")
    plain, huge = rows.where("not huge").drop("huge"), rows.where("huge")
    found = PivotIndex.build(plain).search(queries.where("not huge"), k)
    if huge.isEmpty():
        return found
    text = F.abs(F.col("score")).cast("string")
    exact = F.when(F.col("score") >= 0, F.concat(F.lit("p"), F.lpad(F.length(text).cast("string"), 5, "0"), text))
    exact = exact.otherwise(F.concat(F.lit("n"), F.lpad((99999 - F.length(text)).cast("string"), 5, "0"), F.translate(text, "0123456789", "9876543210")))
    queries = stored(queries)
    all_ = found.select("query_id", "vec_id", "score", exact.alias("exact"))
    all_ = all_.unionByName(_exact_search(queries.where("not huge"), huge, k)).unionByName(_exact_search(queries.where("huge"), rows, k))
    best = Window.partitionBy("query_id").orderBy(F.col("exact").desc(), "vec_id")
    return all_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
