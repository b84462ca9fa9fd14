"""Token counts of a byte-level BPE tokenizer without materialising ids.

A worker cuts each text into pre-tokens and counts them per document, has the library count the
pieces of every distinct pre-token once, and joins the counts to the per-document frequencies to
sum them. The join stays inside the worker: as a shuffle it would move one row per document and
distinct pre-token, which is more data than the texts themselves.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Distinct pre-tokens that a worker remembers; beyond it the table starts anew.
MEMO_WORDS = 500_000
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this code point the pattern above and the library class all characters alike; texts that
#: go beyond it are cut by the library itself, whose Unicode tables are of another version.
ALIKE = regex.compile(r"[^\x00-ԯ]")


class PieceCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The pre-tokens of a text with their counts, and the number of special tokens in it."""
        parts = self.special.split(text) if self.special else [text]
        found: Counter = Counter()
        for part in parts:
            if ALIKE.search(part):
                found.update(part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part))
            else:
                found.update(PRE_TOKENS.findall(part))
        return found, len(parts) - 1

    def learn(self, pre_tokens: set[str]) -> None:
        new = [p for p in pre_tokens if p not in self.pieces]
        if len(self.pieces) + len(new) > MEMO_WORDS:
            self.pieces.clear()
            new = list(pre_tokens)
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            self.pieces.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        out = []
        a = 0
        counted = []
        pending: set[str] = set()
        while a < len(texts) or counted:
            if a < len(texts) and len(pending) < MEMO_WORDS // 4:
                counted.append(self.frequencies(texts[a]))
                pending.update(counted[-1][0])
                a += 1
                continue
            self.learn(pending)
            known = self.pieces
            out += [sum([known[p] * n for p, n in f.items()]) + special for f, special in counted]
            counted, pending = [], set()
        return out


_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of docs
    (doc_id, text). The tokens are those of the library for the whole text, without added special
    tokens, truncation or padding; strings of special tokens inside a text count one each. A null
    text is empty: 0 bytes, 0 tokens. Rows that repeat stay repeated."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = PieceCounter(tokenizer_path)
        own = _counters[tokenizer_path]
        for batch in batches:
            n = own.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
