"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of words is one flat array of symbols. Each round finds the best rank among the adjacent
pairs of every word (a segmented minimum), merges all leftmost pairs of that rank at once, drops
the merged symbols and goes on with the words that still hold a pair. Words end where no piece of
the vocabulary can reach across, so that they are encoded once and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

META = "▁"
NO_PAIR = np.int32(2**31 - 1)
#: Words that a worker remembers; beyond it the table starts anew, so memory is bounded.
MEMO_WORDS = 500_000
#: Words of one flat array; more of them would leave the processor's caches.
FLAT_WORDS = 16_384


class MergeCodec:
    """Encodes and decodes as the sentencepiece library does for a BPE model with byte fallback,
    identity normalisation and a dummy prefix."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.size = n
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.control = {i for i in special if model.is_control(i)}
        self.unknown = model.unk_id()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in special if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        ordinary = {p: i for i, p in enumerate(self.pieces) if i not in special}
        ranks = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in ordinary.values()}, reverse=True))}
        rank_of = {i: ranks[model.get_score(i)] for i in ordinary.values()}

        # Symbols: a piece's id, or `size + code point` for a character that is no piece.
        self.char_symbol = np.arange(0x110000, dtype=np.int64) + n
        for p, i in ordinary.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        pairs = {}
        self.base = n + 0x110000
        for p, i in ordinary.items():
            for cut in range(1, len(p)):
                left, right = self._symbol(p[:cut], ordinary), self._symbol(p[cut:], ordinary)
                if left is not None and right is not None:
                    pairs[left * self.base + right] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        rank = np.full(n, NO_PAIR, dtype=np.int32)
        for i, r in rank_of.items():
            rank[i] = r
        self.pair_rank = rank[self.pair_piece]
        # A piece is safe if no pair that holds it ranks as well as itself: then merging all its
        # leftmost pairs at once gives what merging them one by one would.
        best = np.full(n, NO_PAIR, dtype=np.int32)
        for side in (self.pair_keys // self.base, self.pair_keys % self.base):
            own = side < n
            np.minimum.at(best, side[own], self.pair_rank[own])
        self.safe = best > rank
        inside = {c for p in ordinary for c in p}
        across = any(a != META and b == META for p in ordinary for a, b in zip(p, p[1:], strict=False))
        newline = "" if "\n" in inside else "\\n"
        self.words = re.compile("(?s).+" if across else f" *[^ {newline}]+| +" + (f"|{newline}" if newline else ""))
        self.id_text = [str(i) for i in range(n)]

    def _symbol(self, text: str, ordinary: dict[str, int]) -> int | None:
        if text in ordinary:
            return ordinary[text]
        return self.size + ord(text) if len(text) == 1 else None

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.base + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_rank[at], NO_PAIR), np.where(found, self.pair_piece[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; a space in a word stands for the meta symbol."""
        if len(words) > FLAT_WORDS:
            return [ids for a in range(0, len(words), FLAT_WORDS) for ids in self.encode_words(words[a : a + FLAT_WORDS])]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer("".join(words).replace(" ", META).encode("utf-32-le"), dtype=np.uint32)
        symbol = self.char_symbol[flat]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), NO_PAIR, dtype=np.int32)  # of the pair that starts here
        piece = np.full(len(symbol), -1, dtype=np.int32)
        if len(symbol) > 1:
            rank[:-1], piece[:-1] = self._look_up(symbol[:-1], symbol[1:])
            ends = word[:-1] != word[1:]
            rank[:-1][ends] = NO_PAIR
        done_word, done_symbol = [], []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            open_ = least < NO_PAIR
            if not open_.all():
                live = np.repeat(open_, counts)
                done_word.append(word[~live])
                done_symbol.append(symbol[~live])
                symbol, word, rank, piece = symbol[live], word[live], rank[live], piece[live]
                least, counts = least[open_], counts[open_]
                if not len(symbol):
                    break
            chosen = np.flatnonzero(rank == np.repeat(least, counts))
            first_of_word = np.r_[True, word[chosen[1:]] != word[chosen[:-1]]]
            # Pairs that overlap stand at consecutive places: take every other one of such a run.
            run = np.r_[True, chosen[1:] != chosen[:-1] + 1] | first_of_word
            run_start = chosen[run][np.cumsum(run) - 1]
            take = (chosen - run_start) % 2 == 0
            all_safe = np.logical_and.reduceat(self.safe[piece[chosen]], np.flatnonzero(first_of_word))
            take &= first_of_word | np.repeat(all_safe, np.diff(np.r_[np.flatnonzero(first_of_word), len(chosen)]))
            at = chosen[take]
            symbol[at] = piece[at]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, rank, piece = symbol[keep], word[keep], rank[keep], piece[keep]
            at = place[at]
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched], piece[touched] = NO_PAIR, -1
            touched = touched[touched < len(symbol) - 1]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], piece[touched] = self._look_up(symbol[touched], symbol[touched + 1])
        if not done_word:
            return [[] for _ in words]
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        symbol = symbol[order].tolist()
        bounds = np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))].tolist()
        n = self.size
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            ids = symbol[a:b]
            if ids and max(ids) >= n:
                ids = [x for s in ids for x in ((s,) if s < n else self._fallback(s - n))]
            out.append(ids)
        return out

    def _fallback(self, code: int) -> list[int]:
        if len(self.byte_ids) < 256:
            return [self.unknown]
        return [self.byte_ids[b] for b in chr(code).encode()]

    def split(self, text: str) -> list[str]:
        """The words of a text, the dummy prefix included."""
        return self.words.findall(" " + text.replace(META, " ")) if text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        distinct = list(dict.fromkeys(w for words in split for w in words))
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [[i for w in words for i in ids[w]] for words in split]

    def _joined(self, ids: list[int]) -> str:
        """Pieces put together, before the dummy prefix goes; bytes are read as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.bytes_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(META, " "))
        return "".join(out) + (_utf8(raw) if raw else "")

    def decode(self, ids: list[int]) -> str:
        text = self._joined(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and first != self.unknown and first not in self.bytes_of and text[:1] == " " else text


def _utf8(raw: bytes | bytearray) -> str:
    """UTF-8 where each byte that is part of no character becomes one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i : i + n]).decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, tuple[MergeCodec, dict]] = {}


def codec(model_path: str) -> tuple[MergeCodec, dict[str, tuple[str, str]]]:
    """The worker's codec and its memo: word -> (ids joined by commas, decoded word)."""
    if model_path not in _codecs:
        _codecs[model_path] = (MergeCodec(model_path), {})
    return _codecs[model_path]


def _remember(own: MergeCodec, memo: dict, words: set[str]) -> None:
    new = [w for w in words if w not in memo]
    for w, ids in zip(new, own.encode_words(new), strict=True):
        text = own._joined(ids)
        memo[w] = (",".join([own.id_text[i] for i in ids]), w if text == w else text)


def _coded(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    own, memo = codec(model_path)
    for batch in batches:
        split = [own.split(t or "") for t in batch.column("text").to_pylist()]
        a = 0
        rows = []
        while a < len(split):  # a few documents at a time, so that the memo covers all their words
            words: set[str] = set()
            b = a
            while b < len(split) and (b == a or len(words) < MEMO_WORDS // 4):
                words.update(split[b])
                b += 1
            if len(memo) + len(words) > MEMO_WORDS:
                memo.clear()
            _remember(own, memo, words)
            for part in split[a:b]:
                known = [memo[w] for w in part]
                rows.append((",".join([k[0] for k in known]), "".join([k[1] for k in known])))
            a = b
        yield batch, rows


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, ids_sha256 of the ids joined by commas, and
    decoded_sha256 of the text decoded from these ids. A null text is empty: no ids, and both
    hashes are of the empty string. Rows that repeat stay repeated; other columns are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _coded(batches, model_path):
            n = [ids.count(",") + 1 if ids else 0 for ids, _ in rows]
            ids = [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in rows]
            # each word was decoded from its own ids; the first piece's space is the dummy prefix
            text = [hashlib.sha256(text[1:].encode()).hexdigest() for _, text in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids array<int> of every text; a null text gives an empty array."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _coded(batches, model_path):
            ids = pa.array([[int(i) for i in ids.split(",")] if ids else [] for ids, _ in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = codec(model_path)
        for batch in batches:
            text = pa.array([own.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
