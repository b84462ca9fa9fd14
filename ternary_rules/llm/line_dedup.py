"""Line deduplication that can be taken back.

State: an exact reference table with one signed row per line key and document, and cuckoo filters
sharded by key. An insertion asks its shard's filter first; only keys that may be known are looked
up in the exact table. A deletion adds negative rows and takes keys that no document holds any
more out of the filters. A filter that gets full is built anew, twice as large, from the exact
table. dedup() builds its index by several insertions, a deletion and its reversal.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, restored, shared_dir, shielded, small_batches, stored, union

BLANK = b" \t\n\x0b\x0c\r"
#: Keys that a shard should hold; their number sets the number of shards.
SHARD_KEYS = 100_000
MAX_SHARDS = 1 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits for a line's key: stripped, A-Z in lower case; None if it has fewer code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """One table of buckets of four 16-bit fingerprints, and a stash of whole keys that found no
    room. Keys of one fingerprint that share a bucket share both, so taking any such entry away
    when a key goes never hides another key. A fuller filter is built anew from its keys."""

    SLOTS, KICKS, FULL = 4, 60, 0.85

    def __init__(self, capacity: int = 256):
        self.table = np.zeros((1 << max(4, int(np.ceil(np.log2(max(capacity, 1) / self.SLOTS / self.FULL)))), self.SLOTS), dtype=np.uint16)
        self.stash = np.empty(0, dtype=np.int64)

    @property
    def room(self) -> int:
        """Keys that it should hold at most."""
        return int(self.FULL * self.table.size)

    def _places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (lo.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        fp = np.where(fp == 0, np.uint16(1), fp)
        first = (lo.astype(np.uint64) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, lo: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(lo)
        found = (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)
        return found | np.isin(lo, self.stash) if len(self.stash) else found

    def add(self, lo: np.ndarray) -> None:
        """Adds keys, one entry each. If the moves of one round of all keys don't end,
        the table is put back and each half tried alone, down to single keys, which are stashed."""
        before = self.table.copy()
        if not len(lo) or self._place(lo):
            return
        self.table = before
        if len(lo) == 1:
            self.stash = np.r_[self.stash, lo]
            return
        self.add(lo[: len(lo) // 2])
        self.add(lo[len(lo) // 2 :])

    def _place(self, lo: np.ndarray) -> bool:
        """As many as fit go to their buckets, and of each full bucket one fingerprint moves on to
        its other bucket, round after round. Tells whether all found room."""
        table = self.table
        fp, bucket, _ = self._places(lo)
        rng = np.random.default_rng(len(lo))
        for _ in range(self.KICKS):
            order = np.argsort(bucket, kind="stable")
            fp, bucket = fp[order], bucket[order]
            nth = _nth(bucket)
            free = table == 0
            fits = nth < free.sum(axis=1)[bucket]
            slot = np.argsort(~free[bucket[fits]], axis=1, kind="stable")[np.arange(fits.sum()), nth[fits]]
            table[bucket[fits], slot] = fp[fits]
            fp, bucket = fp[~fits], bucket[~fits]
            if not len(fp):
                return True
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            at, slot = bucket[first], rng.integers(0, self.SLOTS, first.sum())
            out = table[at, slot].copy()
            table[at, slot] = fp[first]
            fp = np.r_[out, fp[~first]]
            bucket = self._other(np.r_[at, bucket[~first]], fp)
        return False

    def remove(self, lo: np.ndarray) -> None:
        """Takes out one entry of each key; all must be in it."""
        if len(self.stash):
            stashed = np.isin(lo, self.stash)
            self.stash, lo = self.stash[~np.isin(self.stash, lo)], lo[~stashed]
        fp, a, b = self._places(lo)
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((fp, low))
        fp, low, high = fp[order], low[order], high[order]
        nth = _nth(low * 65536 + fp)
        own = np.concatenate([self.table[low], self.table[high]], axis=1) == fp[:, None]
        own[low == high, self.SLOTS :] = False
        hit = own & (own.cumsum(axis=1) == nth[:, None] + 1)
        if not hit.any(axis=1).all():
            raise ValueError("a key to be removed is not in the filter")
        slot = hit.argmax(axis=1)
        self.table[np.where(slot < self.SLOTS, low, high), slot % self.SLOTS] = 0

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def to_bytes(self) -> bytes:
        return np.array([len(self.table)], dtype="<i8").tobytes() + self.table.astype("<u2").tobytes() + self.stash.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        rows = int(np.frombuffer(raw, "<i8", 1)[0])
        out.table = np.frombuffer(raw, "<u2", rows * cls.SLOTS, 8).reshape(rows, cls.SLOTS).astype(np.uint16)
        out.stash = np.frombuffer(raw, "<i8", -1, 8 + 2 * rows * cls.SLOTS).astype(np.int64)
        return out


def _nth(values: np.ndarray) -> np.ndarray:
    """The place of each value among its equals; values are sorted."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)]
    return np.arange(len(values)) - np.repeat(starts, np.diff(np.r_[starts, len(values)]))


FILTERS = "shard int, filter binary, n_keys long, room long"


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keys = keys[["shard", "hi", "lo"]]
    if not len(filters):
        return keys.assign(maybe=False)
    return keys.assign(maybe=CuckooFilter.from_bytes(filters["filter"].iloc[0]).contains(keys["lo"].to_numpy()))


def _update(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard after its changes: new keys, keys gone, or all its keys (`whole`)."""
    new = keys.loc[keys["added"], "lo"].to_numpy() if len(keys) else np.empty(0, dtype=np.int64)
    if len(filters) and not (len(keys) and keys["whole"].any()):
        own = CuckooFilter.from_bytes(filters["filter"].iloc[0])
    else:
        own = CuckooFilter(max(256, 2 * len(new)))
    own.add(new)
    if len(keys) and not keys["added"].all():
        own.remove(keys.loc[~keys["added"], "lo"].to_numpy())
    shard = int((keys if len(keys) else filters)["shard"].iloc[0])
    return pd.DataFrame({"shard": [shard], "filter": [own.to_bytes()], "n_keys": [len(own)], "room": [own.room]})


class LineIndex:
    """Which documents hold which lines. A key is 128 bits of a hash of the line's text."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 10, shards: int | None = None):
        self.spark, self.min_chars, self.shards = spark, min_chars, shards
        self.path = path or f"{shared_dir(spark)}/stored-lines-{uuid.uuid4().hex}"
        #: Tables (doc_id, hi, lo) with their sign: 1 for references added, -1 for those taken back.
        self.refs: list[tuple[DataFrame, int]] = []
        self.filters: DataFrame | None = None

    def line_refs(self, docs: DataFrame) -> DataFrame:
        """(doc_id, hi, lo), once per document and key. A document without an id holds no keys."""
        small_batches(self.spark)
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids: list[int] = []
                keys: list[bytes] = []
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own = {k for line in set((text or "").encode().split(b"\n")) if (k := line_key(line, min_chars))}
                    keys += own
                    ids += [i] * len(own)
                both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "hi", "lo"])

        return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, hi long, lo long")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.col("hi"), F.lit(self.shards)).cast("int"))

    def live(self) -> DataFrame:
        """(doc_id, hi, lo) of all references that stand."""
        if not self.refs:
            return self.spark.createDataFrame([], "doc_id long, hi long, lo long")
        rows = union([r.withColumn("sign", F.lit(s)) for r, s in self.refs])
        if all(s > 0 for _, s in self.refs):  # an insertion adds only what is not live
            return rows.drop("sign")
        return rows.groupBy("doc_id", "hi", "lo").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def _compacted(self) -> DataFrame:
        """live() as a stored table: after a deletion it takes the place of the signed rows."""
        if any(s < 0 for _, s in self.refs):
            self.refs = [(stored(self.live(), f"{self.path}/live-{uuid.uuid4().hex}"), 1)]
        return self.live()

    def counts(self) -> DataFrame:
        """(hi, lo, refs, keeper): how many documents hold the key, and the least doc_id of them."""
        return self.live().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("keeper"))

    def _write_filters(self, changed: DataFrame) -> None:
        """changed: (hi, lo, added), each key once. self.refs has the change already."""
        keys = self._sharded(changed).withColumn("whole", F.lit(False))
        if self.filters is None:
            filters = self.spark.createDataFrame([], FILTERS)
        else:
            filters = self.filters
            keys = stored(keys, f"{self.path}/changed-{uuid.uuid4().hex}")
            more = keys.where("added").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
            full = stored(more.join(filters.select("shard", "n_keys", "room"), "shard").where("n_keys + n > room").select("shard"))
            if not full.isEmpty():
                all_ = self._sharded(self.live().select("hi", "lo").distinct()).join(full, "shard", "left_semi")
                anew = all_.select("hi", "lo", F.lit(True).alias("added"), "shard", F.lit(True).alias("whole"))
                keys = keys.join(full, "shard", "left_anti").select(anew.columns).unionByName(anew)
        new = keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_update, FILTERS)
        self.filters = stored(new, f"{self.path}/filters-{uuid.uuid4().hex}")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; those that the index holds already gain nothing."""
        return self.insert_refs(stored(self.line_refs(docs).distinct(), f"{self.path}/batch-{uuid.uuid4().hex}"))

    def insert_refs(self, batch: DataFrame) -> LineIndex:
        """Adds the references of a stored table (doc_id, hi, lo), each of them once."""
        if self.shards is None:
            self.shards = int(min(MAX_SHARDS, max(1, -(-batch.count() // SHARD_KEYS))))
        keys = batch.select("hi", "lo").distinct()
        if self.filters is None:
            new_keys, refs = keys, batch
        else:
            keys = self._sharded(keys)
            probed = stored(keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, "shard int, hi long, lo long, maybe boolean"), f"{self.path}/probed-{uuid.uuid4().hex}")
            maybe = probed.where("maybe").select("hi", "lo")
            # a key that very many documents hold is one row here, and split where its rows are looked up
            held = stored(join_skewed(self._compacted(), maybe, ["hi", "lo"], "left_semi"), f"{self.path}/held-{uuid.uuid4().hex}")
            new_keys = probed.where("not maybe").select("hi", "lo").unionByName(maybe.join(held.select("hi", "lo").distinct(), ["hi", "lo"], "left_anti"))
            refs = stored(batch.join(held, ["doc_id", "hi", "lo"], "left_anti"), f"{self.path}/refs-{uuid.uuid4().hex}")
        self.refs.append((refs, 1))
        self._write_filters(new_keys.withColumn("added", F.lit(True)))
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (column doc_id) out; unknown ones are ignored."""
        if not self.refs:
            return self
        gone = stored(self.live().join(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi"), f"{self.path}/gone-{uuid.uuid4().hex}")
        self.refs.append((gone, -1))
        dead = gone.select("hi", "lo").distinct().join(self._compacted().select("hi", "lo").distinct(), ["hi", "lo"], "left_anti")
        self._write_filters(dead.withColumn("added", F.lit(False)))
        return self

    def drops(self) -> DataFrame:
        """(doc_id, drop): the keys that each document loses, 16 bytes each in one binary. A key of
        two or more documents stays in the least doc_id only."""
        several = self.counts().where("refs > 1").select("hi", "lo", "keeper")
        lost = join_skewed(self.live(), several, ["hi", "lo"]).where("doc_id <> keeper")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("drop"))

    def resolve(self, docs: DataFrame) -> DataFrame:
        """docs, all columns, with text the kept lines joined by \\n (null or empty: one empty
        line), and n_lines (before dropping), n_dropped and kept_sha256 added."""
        small_batches(self.spark)
        min_chars = self.min_chars
        own_names, docs = docs.columns, shielded(docs, ("doc_id", "text"))
        drops = self.drops().select(F.col("doc_id").alias("__of"), "drop")
        joined = docs.join(drops.hint("shuffle_hash"), docs["doc_id"] == drops["__of"], "left").drop("__of")
        schema = docs.withColumn("text", F.col("text").cast("string")).schema
        names = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept: list[str] = []
                n_lines, n_dropped, sha = [], [], []
                for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop"), strict=True):
                    lines = (text or "").encode().split(b"\n")
                    left = lines
                    if drop.is_valid:
                        flat = drop.values.flatten()
                        both = np.stack([np.asarray(x, dtype="<i8") for x in flat], axis=1).tobytes()
                        lost = {both[k : k + 16] for k in range(0, len(both), 16)}
                        left = [x for x in lines if line_key(x, min_chars) not in lost]
                    out = b"\n".join(left)
                    kept.append(out.decode())
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                    sha.append(hashlib.sha256(out).hexdigest())
                columns = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], names=[*names, "n_lines", "n_dropped", "kept_sha256"])

        ddl = schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
        return restored(joined.mapInArrow(run, ddl), own_names, ("doc_id", "text"), ("n_lines", "n_dropped", "kept_sha256"))


#: Parts that dedup() deals references to by a hash of doc_id; the last one also leaves and returns.
PARTS = 8


def dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """resolve() of an index that took docs in by two insertions, then lost an eighth of them by a
    deletion and got it back by a third insertion: the result is that of a new index."""
    index = LineIndex(docs.sparkSession, min_chars=min_chars)
    refs = stored(index.line_refs(docs).distinct(), f"{index.path}/all-{uuid.uuid4().hex}")
    index.shards = int(min(MAX_SHARDS, max(1, -(-refs.count() // SHARD_KEYS))))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    last = refs.where(part == PARTS - 1)
    index.insert_refs(refs.where(part < PARTS // 2)).insert_refs(refs.where(part >= PARTS // 2))
    return index.delete(last.select("doc_id")).insert_refs(last).resolve(docs)
