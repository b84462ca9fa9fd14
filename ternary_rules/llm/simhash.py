"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints that differ in at most 4 of 64 bits differ in at most one bit of one of three
segments. Each segment is indexed once per bit with that bit as a wildcard, so such a pair meets
in an equality join on one of 64 keys; the join condition verifies the whole fingerprints and
keeps a pair under the first key it shares only. Copies share a fingerprint and count once.

A wildcard variant leaves some 20 bits to tell fingerprints apart, which is too few for very many.
There the bits outside the segment, of which at most 4 differ, are cut into 5 pieces: one of them is
the same on both sides, and each piece in turn joins the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_skewed, restored, shielded, small_batches, stored
from .graph import components

#: First bit of each segment, and the end of the last.
SEGMENTS = (0, 21, 42, 64)
#: Distinct fingerprints beyond which keys hold a piece of the other bits: 5 times the keys, but a
#: 50th of the candidate pairs, whose number grows with the square. The links are the same.
PLAIN_KEYS = 5_000_000
#: Pieces that the bits outside a segment are cut into then; one more than bits that may differ.
PIECES = 5
#: Shingles whose bits are unpacked at a time: 64 bytes each.
FLAT_SHINGLES = 250_000


def _fingerprints(texts: list[str | None], words_per_shingle: int) -> list[bytes]:
    """8 bytes each, most significant first."""
    from xxhash import xxh64_digest

    out: list[bytes] = []
    digests: list[bytes] = []
    sizes: list[int] = []

    def flush() -> None:
        ones = np.zeros((len(sizes), 64), dtype=np.int64)
        total = np.array(sizes, dtype=np.int64)
        raw = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8)
        begin = 0
        for k, n in enumerate(sizes):
            for a in range(begin, begin + n, FLAT_SHINGLES):
                ones[k] += np.unpackbits(raw[a : min(a + FLAT_SHINGLES, begin + n)], axis=1).sum(axis=0, dtype=np.int32)
            begin += n
        packed = np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1)
        out.extend(row.tobytes() for row in packed)
        digests.clear()
        sizes.clear()

    for text in texts:
        words = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
        if len(words) <= words_per_shingle:
            own = [xxh64_digest(b" ".join(words), 42)] if words else []
        else:
            line = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda e, n: e + n + 1))
            starts = [0, *[e + 1 for e in ends]]
            own = [xxh64_digest(line[a:b], 42) for a, b in zip(starts, ends[words_per_shingle - 1 :], strict=False)]
        digests.extend(own)
        sizes.append(len(own))
        if len(digests) > FLAT_SHINGLES:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the 64 bits as a signed long) of every row of docs (doc_id, text): bit i is 1
    if it is 1 in over half of the XXH64 values (seed 42) of the shingles, repeats included. Fewer
    words than a shingle holds are one shingle; a text without words, or null, has fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.frombuffer(b"".join(_fingerprints(batch.column("text").to_pylist(), words_per_shingle)), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fp)], names=["doc_id", "th", "fp"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, th long, fp long")


def _bits(a: int, b: int) -> int:
    """Bits a to b-1 as a signed long."""
    mask = ((1 << (b - a)) - 1) << a
    return mask - (1 << 64) if mask >> 63 else mask


def _pieces(a: int, b: int, n: int) -> list[int]:
    """Masks, as signed longs, that cut the bits outside a to b-1 into n parts; for 1 an empty one."""
    if n == 1:
        return [0]
    rest = [k for k in range(64) if not a <= k < b]
    masks = [sum(1 << k for k in rest[len(rest) * j // n : len(rest) * (j + 1) // n]) for j in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _variants(fp: DataFrame, pieces: int) -> DataFrame:
    """(key, fp), or (key, piece, same, fp) for several pieces: for every bit, its segment without
    that bit, with the bit's place, in one int; each with every piece of the other bits."""
    keys = []
    for a, b in zip(SEGMENTS, SEGMENTS[1:], strict=False):
        value = F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for bit in range(a, b):
            key = F.lit(bit << 22).bitwiseOR(value.bitwiseAND(F.lit(((1 << (b - a)) - 1) ^ (1 << (bit - a)))).cast("int"))
            for j, mask in enumerate(_pieces(a, b, pieces)):
                more = [F.lit(j).cast("byte").alias("piece"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("same")]
                keys.append(F.struct(key.alias("key"), *(more if pieces > 1 else [])))
    return fp.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.*", "fp")


def _first_key(key: Column, piece: Column, differ: Column, pieces: int) -> Column:
    """True at the first key that a pair with these differing bits shares."""
    bit = F.shiftrightunsigned(key, 22)
    earlier: Column = F.lit(True)
    out: Column = F.lit(False)
    for a, b in zip(SEGMENTS, SEGMENTS[1:], strict=False):
        here = differ.bitwiseAND(F.lit(_bits(a, b)))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        first_piece: Column = F.lit(True)
        for j, mask in enumerate(_pieces(a, b, pieces)[:-1]):  # no piece before its own is the same
            first_piece = first_piece & ((piece <= j) | (differ.bitwiseAND(F.lit(mask).cast("long")) != 0))
        out = out | (bit.between(a, b - 1) & earlier & first_piece & ((here == one) | ((here == 0) & (bit == a))))
        earlier = earlier & (F.bit_count(here) > 1)
    return out


def links(distinct: DataFrame, max_differing: int = 4, pieces: int | None = None) -> DataFrame:
    """(u, v), u < v: all pairs of distinct fingerprints (column fp, a stored table) that differ in
    at most max_differing bits, each pair once. pieces: 1, or PIECES for very many fingerprints,
    which is chosen by their number if not given."""
    if max_differing >= 2 * (len(SEGMENTS) - 1):
        raise ValueError("three segments find at most 5 differing bits")
    if pieces is None:
        pieces = 1 if distinct.count() <= PLAIN_KEYS else max(PIECES, max_differing + 1)
    if 1 < pieces <= max_differing:
        raise ValueError("with a piece for each bit that differs none need be the same")
    variants = _variants(distinct, pieces)
    left, right = variants.alias("a"), variants.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    met = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (("key", "piece", "same") if pieces > 1 else ("key",))])
    first = _first_key(F.col("a.key"), F.col("a.piece"), differ, pieces)
    pair = met & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= max_differing) & first
    # sorted runs on both sides: an estimate of the size could take the variants for broadcastable
    return left.hint("merge").join(right, pair).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _classed(docs: DataFrame, words_per_shingle: int, max_differing: int) -> DataFrame:
    """doc_id, th (a hash of the text), fp, class (the least fingerprint) and component_id."""
    own = stored(fingerprints(docs, words_per_shingle))
    each = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(each.select("fp"), max_differing))
    each = each.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    each = stored(each)
    named = each.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = stored(join_skewed(each, named, ["class"]).select("fp", "class", "component_id"))
    return join_skewed(own, classes, ["fp"])


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, max_differing: int = 4) -> DataFrame:
    """doc_id, fp, fingerprint (16 lowercase hex digits) and component_id (the least doc_id
    reachable over links, itself included) of every row of docs (doc_id, text). Rows that repeat
    stay repeated and share a class; a null doc_id takes part in links but names no class unless
    the class has no other id."""
    found = _classed(docs, words_per_shingle, max_differing)
    return found.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = 4, max_differing: int = 4) -> DataFrame:
    """The rows of docs, all their columns, without those that repeat another: of each class the
    row with the least doc_id stays (of equal ids the one with the least text, then the least other
    columns as JSON). A row without doc_id takes no part and stays. Where an id has several texts,
    each row belongs to its own text's class."""
    names, needed = docs.columns, ("doc_id", "text")
    docs = shielded(docs, needed).withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    known = docs.where("doc_id is not null")
    found = _classed(known, words_per_shingle, max_differing).where("doc_id = component_id")
    found = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__of"), "class").distinct()
    # joined by doc_id alone, so that the texts, which that deals, need not move again for the window
    kept = known.join(found, (known["doc_id"] == found["__id"]) & (known["__th"].bitwiseXOR(found["__of"]) == 0))
    rest = [c for c in docs.columns if c not in (*needed, "__th")]
    first = Window.partitionBy("doc_id", "class").orderBy("text", *([F.to_json(F.struct(*rest))] if rest else []))
    kept = kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*docs.columns)
    return restored(kept.unionByName(docs.where("doc_id is null")), names, needed)
