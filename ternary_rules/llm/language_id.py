"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, which a forward pass gives; a text's score
is the product over its words. The piece probabilities are learned by expectation maximisation
(forward and backward passes) on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import restored, shielded, small_batches, stored

LETTERS = regex.compile(r"\p{L}+")
#: Letters of a word up to which words go through the passes together, in lifted sums; the sums of
#: longer ones, of any length, are kept as logarithms, word by word.
WORD_LETTERS = 32
#: Positions of a long word whose pieces are looked up at a time.
CHUNK_LETTERS = 65_536
#: Documents of each language that the model is fitted on, give or take their square root's few fold:
#: those whose hash is below the share of the language's documents that this is.
FIT_DOCS = 500
EM_ROUNDS = 3
SMOOTHING = 0.2
#: Words that a worker remembers; beyond it the table starts anew.
MEMO_WORDS = 600_000
#: Letters of the words that are remembered at most, apart from those that one batch needs.
MEMO_LETTERS = 16_000_000
#: Codes and keys, which are in no language: runs of letters and digits that mix the two.
CODES = regex.compile(r"[\p{L}\p{N}]*(?:\p{L}\p{N}|\p{N}\p{L})[\p{L}\p{N}]*+")
#: A factor per letter that keeps products near 1; it cancels out.
LIFT = 40.0
#: Share of a language's letters that its alphabet covers; the rest are strays of other languages.
ALPHABET_SHARE = 0.999
#: Nats that a text may fall short of the background by, about those of one word never seen.
SLACK = 15.0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Vocabulary:
    """The pieces of letters of a public vocabulary, found by hash; the last id is any letter that
    is no piece."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = set()
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            body = p.removeprefix("▁")
            if not body or body.isalpha() and body == body.lower():
                pieces.add(p)
        pieces.add("▁")
        self.pieces = sorted(pieces)
        self.longest = max(map(len, self.pieces))
        #: By length: the hashes of its pieces, in order, and their ids.
        self.table = []
        for k in range(1, self.longest + 1):
            own = sorted((int(self._hash(p)), i) for i, p in enumerate(self.pieces) if len(p) == k)
            self.table.append((np.array([h for h, _ in own], dtype=np.uint64), np.array([i for _, i in own], dtype=np.int32)))
        self.unknown = len(self.pieces)
        self.size = self.unknown + 1
        self.power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length: ids[k-1, end, word] of the pieces of k letters whose last letter
        is at end, -1 where there is none."""
        n, most = len(words[0]), min(self.longest, len(words[0]))
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        out = np.full((most, n, len(words)), -1, dtype=np.int32)
        h = np.zeros_like(code)
        for k in range(1, most + 1):
            # a letter more in front; it wraps around, as the hash of a piece does
            h = code[: n - k + 1] * self.power[k - 1] + h[1:] if k > 1 else code
            known, ids = self.table[k - 1]
            if len(known):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                out[k - 1, k - 1 :] = np.where(known[at] == h, ids[at], -1)
        out[0][out[0] < 0] = self.unknown
        return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(model_path: str) -> Vocabulary:
    if model_path not in _vocabularies:
        _vocabularies[model_path] = Vocabulary(model_path)
    return _vocabularies[model_path]


def _by_length(words: list[str], at: np.ndarray, most: int = 4096) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The words with these indices, in parts of one length, marked."""
    lengths = np.array([len(words[i]) for i in at])
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(at[order], cuts):
        for a in range(0, len(part), most):
            yield part[a : a + most], ["▁" + words[i] for i in part[a : a + most]]


def _short_and_long(words: list[str]) -> tuple[np.ndarray, list[int]]:
    short = np.array([len(w) <= WORD_LETTERS for w in words], dtype=bool)
    return np.flatnonzero(short), np.flatnonzero(~short).tolist()


def _forward(lattice: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Lifted sums over the segmentations of each prefix. p: (pieces + a last row of zeros, languages)."""
    most, n, words = lattice.shape
    alpha = [np.ones((words, p.shape[1]))]
    for end in range(n):
        total = np.zeros_like(alpha[0])
        for k in range(1, min(most, end + 1) + 1):
            ids = lattice[k - 1, end]
            has = np.flatnonzero(ids >= 0)
            if len(has) == words:
                total += alpha[end + 1 - k] * (p[ids] * LIFT**k)
            elif len(has):
                total[has] += alpha[end + 1 - k][has] * (p[ids[has]] * LIFT**k)
        alpha.append(total)
    return alpha


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


def _long_pieces(word: str, vocab: Vocabulary) -> Iterator[tuple[int, np.ndarray]]:
    """(end, ids) of a marked word of any length; its pieces are looked up in chunks that overlap by
    the longest piece."""
    for a in range(0, len(word), CHUNK_LETTERS):
        lead = min(a, vocab.longest - 1)
        ids = vocab.lattice([word[a - lead : a + CHUNK_LETTERS]])[:, :, 0]
        for at in range(lead, ids.shape[1]):
            yield a - lead + at, ids[:, at]


def _long_forward(word: str, log_p: np.ndarray, vocab: Vocabulary, keep: bool) -> list[np.ndarray]:
    """Logarithms of the sums over the segmentations of each prefix of a marked word; the last only
    unless keep. The last alphas are carried on from letter to letter."""
    alpha = [np.zeros(log_p.shape[1])]
    for _, ids in _long_pieces(word, vocab):
        k = np.flatnonzero(ids[: len(alpha)] >= 0)
        alpha.append(_log_sum(np.stack([alpha[-1 - j] for j in k]) + log_p[ids[k]]))
        if not keep and len(alpha) > vocab.longest:
            del alpha[0]
    return alpha if keep else alpha[-1:]


def log_probabilities(words: list[str], p: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations. p ends in a row of zeros."""
    out = np.empty((len(words), p.shape[1]))
    short, long_ = _short_and_long(words)
    for at, marked in _by_length(words, short) if len(short) else ():
        alpha = _forward(vocab.lattice(marked), p)
        out[at] = np.log(np.maximum(alpha[-1], 1e-300)) - (len(alpha) - 1) * np.log(LIFT)
    if long_:
        log_p = np.log(np.maximum(p, 1e-300))
        for i in long_:
            out[i] = _long_forward("▁" + words[i], log_p, vocab, False)[-1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, p: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """(pieces, languages): how often each piece is expected, by language. counts: (words, languages)."""
    total = np.zeros((vocab.size, p.shape[1]))
    short, long_ = _short_and_long(words)
    for at, marked in _by_length(words, short) if len(short) else ():
        lattice = vocab.lattice(marked)
        most, n, _ = lattice.shape
        alpha = _forward(lattice, p)
        beta = [np.zeros_like(alpha[0]) for _ in alpha]
        beta[-1] = counts[at] / np.maximum(alpha[-1], 1e-300)
        for end in range(n, 0, -1):
            for k in range(1, min(most, end) + 1):
                ids = lattice[k - 1, end - 1]
                has = np.flatnonzero(ids >= 0)
                if not len(has):
                    continue
                through = p[ids[has]] * LIFT**k * beta[end][has]
                beta[end - k][has] += through
                share = alpha[end - k][has] * through
                for lang in range(p.shape[1]):
                    total[:, lang] += np.bincount(ids[has], weights=share[:, lang], minlength=vocab.size)
    if long_:
        log_p = np.log(np.maximum(p, 1e-300))
        for i in long_:
            _count_long("▁" + words[i], counts[i], log_p, vocab, total)
    return total


def _count_long(word: str, counts: np.ndarray, log_p: np.ndarray, vocab: Vocabulary, total: np.ndarray) -> None:
    alpha = _long_forward(word, log_p, vocab, True)
    pieces = [ids for _, ids in _long_pieces(word, vocab)]
    beta = [np.full(log_p.shape[1], -np.inf) for _ in alpha]
    beta[-1] = np.zeros(log_p.shape[1])
    for end in range(len(word), 0, -1):
        ids = pieces[end - 1]
        for k in np.flatnonzero(ids[:end] >= 0).tolist():
            through = log_p[ids[k]] + beta[end]
            beta[end - k - 1] = np.logaddexp(beta[end - k - 1], through)
            total[ids[k]] += counts * np.exp(alpha[end - k - 1] + through - alpha[-1])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class LanguageModel:
    def __init__(self, languages: list[str], p: np.ndarray, model_path: str, background: np.ndarray | None = None):
        self.languages, self.p, self.model_path, self.background = languages, p, model_path, background


def _background(words: DataFrame, columns: list[str]) -> np.ndarray:
    """By language, the log probability of a letter, or of a word's start, if all are alike."""
    counts = words.select(F.explode(F.split("word", "")).alias("c"), *columns).where("c <> ''").groupBy("c").agg(*[F.sum(k).alias(k) for k in columns]).toPandas()[columns].to_numpy(dtype=float)
    share = np.cumsum(-np.sort(-counts, axis=0), axis=0) / np.maximum(counts.sum(axis=0), 1.0)
    return -np.log((share < ALPHABET_SHARE).sum(axis=0) + 2.0)


def fit(docs: DataFrame, model_path: str, fit_docs: int = FIT_DOCS, rounds: int = EM_ROUNDS, background: bool = False) -> LanguageModel:
    """Learns from rows of docs (text, lang, doc_id) with a lang that are not held out: of each
    language about fit_docs documents, chosen by a hash of id and text, all if it has no more. The words
    of the sample are counted in Spark, each round's expectation too; the driver gets one number
    for each piece and language. background: learn that too, which predict needs for a margin."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # a row is in the sample if its hash, which is as good as random, is below the share of its language's
    # rows that FIT_DOCS are: no task needs all rows of a language to decide it
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    labelled = labelled.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).withColumn("chance", chance)
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes, key=lambda x: x.encode())
    vocab = vocabulary(model_path)
    if not languages:
        return LanguageModel([], np.zeros((vocab.size + 1, 0)), model_path, np.zeros(0) if background else None)
    bounds = spark.createDataFrame([(lang, fit_docs / n) for lang, n in sizes.items()], "lang string, below double")
    inside = labelled.join(F.broadcast(bounds), "lang").where("chance < below")  # a row a language
    number = {lang: k for k, lang in enumerate(languages)}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counted.update((number[lang], w) for w in words_of(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counted], pa.int32()), pa.array([w for _, w in counted], pa.string()), pa.array(list(counted.values()), pa.int64())], names=["k", "word", "n"])

    each = inside.select("lang", "text").mapInArrow(split, "k int, word string, n long")
    words = stored(each.groupBy("word").pivot("k", list(range(len(languages)))).agg(F.sum("n")).na.fill(0).repartition(spark.sparkContext.defaultParallelism))
    columns = [str(k) for k in range(len(languages))]
    p = np.full((vocab.size + 1, len(languages)), 1.0 / vocab.size)
    p[-1] = 0.0
    for _ in range(rounds):

        def expect(parts: Iterator[pd.DataFrame], p: np.ndarray = p) -> Iterator[pd.DataFrame]:
            own = vocabulary(model_path)
            total = np.zeros((own.size, p.shape[1]))
            for pdf in parts:
                total += expected_counts(pdf["word"].tolist(), pdf[columns].to_numpy(dtype=float), p, own)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "k": lang, "n": total[piece, lang]})

        found = words.mapInPandas(expect, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((vocab.size, len(languages)))
        counts[found["piece"], found["k"]] = found["n"]
        counts += SMOOTHING
        p[:-1] = counts / counts.sum(axis=0)
        p = p.copy()
    return LanguageModel(languages, p, model_path, _background(words, columns) if background else None)


class _Memo:
    """Rows of log probabilities by word."""

    def __init__(self, languages: int):
        self.rows = np.empty((0, languages))
        self.at: dict[str, int] = {}
        self.letters = 0

    def need(self, words: set[str], p: np.ndarray, vocab: Vocabulary) -> None:
        new = [w for w in words if w not in self.at]
        self.letters += sum(map(len, new))
        if len(self.at) + len(new) > MEMO_WORDS or self.letters > MEMO_LETTERS:
            self.at, self.rows, new = {}, self.rows[:0], list(words)
            self.letters = sum(map(len, new))
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, log_probabilities(new, p, vocab)])


_memos: dict[str, _Memo] = {}


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs, all columns, with lang_pred and score (0 to 1, the language's posterior with equal
    priors) added. Only the text is read: lang_pred is `und` with score 0 if it is null or has no
    letter, or if nothing was learned. Ties go to the language first in code point order. With a
    model's background, __margin too: the nats by which the language explains the text better than
    letters drawn at random, codes and keys left out where that helps, with SLACK added; below 0 the
    text is in no language that was learned."""
    spark = docs.sparkSession
    small_batches(spark)
    own_names, docs = docs.columns, shielded(docs, ("text",))
    shipped = spark.sparkContext.broadcast((model.languages, model.p, model.background))  # languages x pieces: bounded
    path = model.model_path
    token = f"{id(shipped)}-{abs(hash(model.p.tobytes()))}"
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p, background = shipped.value
        vocab = vocabulary(path)
        if token not in _memos:
            _memos.clear()
            _memos[token] = _Memo(len(languages))
        memo = _memos[token]
        for batch in batches:
            predicted, score, margin = [], [], []
            texts = batch.column(at_text).to_pylist()
            split = [words_of(t or "") for t in texts]
            a = 0
            while a < len(split):
                b, words = a, set()
                while b < len(split) and (b == a or len(words) < MEMO_WORDS // 4):
                    words.update(split[b])
                    b += 1
                memo.need(words, p, vocab)
                at = memo.at
                for text, own in zip(texts[a:b], split[a:b], strict=True):
                    if not own or not languages:
                        predicted.append("und")
                        score.append(0.0)
                        margin.append(-1.0)
                        continue
                    total = memo.rows[[at[w] for w in own]].sum(axis=0)
                    best = int(np.argmax(total))
                    predicted.append(languages[best])
                    score.append(float(1.0 / np.exp(total - total[best]).sum()))
                    if background is not None:
                        over = float(total[best] - background[best] * sum(len(w) + 1 for w in own)) + SLACK
                        # few texts: once more without codes, if words are left
                        plain = words_of(CODES.sub(" ", text)) if over < 0 else []
                        if plain and len(plain) < len(own):
                            rest = log_probabilities(plain, p, vocab).sum(axis=0) - background * sum(len(w) + 1 for w in plain)
                            over = max(over, float(rest.max()) + SLACK)
                        margin.append(over)
                a = b
            more = [] if background is None else [pa.array(margin, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(score, pa.float64()), *more], names=[*names, *added])

    added = ["lang_pred", "score"] if model.background is None else ["lang_pred", "score", "__margin"]
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string")
    for name in added[1:]:
        schema = schema.add(name, "double")
    return restored(docs.mapInArrow(run, schema), own_names, ("text",), tuple(added))


def identify(docs: DataFrame, model_path: str, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang)."""
    model = fit(docs, model_path, fit_docs)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return predict(own, model).select("doc_id", "held_out", "lang_pred", "score")
