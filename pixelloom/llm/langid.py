"""Operator 5: language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A word is scored in a language by summing, over all its segmentations into pieces, the product of their unigram
probabilities (forward algorithm); words are independent, so a text's score is the sum over its words.  Piece
probabilities are learned for each language by expectation-maximisation from word counts of a bounded sample of
labelled documents: about ``PER_LANGUAGE`` documents of each language, chosen by hash, and the ``WORDS`` commonest
words of each language in them.  Words are runs between white space, lower-cased, without marks at both ends; words of
more than ``LONGEST`` characters are learned and scored in parts of that length.

The score is the posterior of the language that is most likely, tempered: words of one text are not independent, so
their mean evidence counts as that of at most ``EVIDENCE`` words.  There is no limit on languages; the model holds one
number a piece and language, and caches are bounded in bytes whatever that number is.

Rows: null text or text without any letter is ``und`` with score 0; with nothing to learn from, every row is;
documents with null lang or null doc_id teach nothing; a null doc_id counts as held out; extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.llm import store
from pixelloom.llm.chunks import MARKS

PER_LANGUAGE, WORDS, LONGEST, PIECE, STEPS, EVIDENCE = 600, 15_000, 24, 6, 3, 12
UNKNOWN = 1e-9
#: Bytes of known words with their scores, and of one step of the forward algorithm.
CACHE_BYTES, STEP_BYTES = 96 << 20, 6 << 20
_BASE = np.uint64(0x100000001B3)


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that nothing is learned from, by the checksum of the id's decimal digits."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def vocabulary(path: str) -> list[str]:
    """Pieces of the public byte-level vocabulary that are whole lower-case characters, without their leading blank."""
    pieces = set()
    with open(path, "rb") as f:
        for line in f:
            try:
                piece = base64.b64decode(line.split()[0]).decode().strip().lower()
            except UnicodeDecodeError:
                continue
            if 0 < len(piece) <= PIECE and not any(c.isspace() for c in piece):
                pieces.add(piece)
    return sorted(pieces)


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Rolling hashes of the 1..PIECE characters from each position (column) of padded rows of code points."""
    out = [codes.astype(np.uint64) + np.uint64(1)]
    for n in range(1, min(PIECE, codes.shape[1])):
        out.append(out[-1][:, :-1] * _BASE + codes[:, n:] + np.uint64(1))
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    flat = np.zeros((len(words), width), dtype=np.uint64)
    size = np.array([len(w) for w in words])
    flat[np.arange(width)[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat


class Pieces:
    def __init__(self, pieces: list[str]):
        keys = np.zeros(len(pieces), dtype=np.uint64)
        for n in range(1, PIECE + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            if own:
                keys[own] = _hashes(_codes([pieces[i] for i in own], n))[n - 1][:, 0]
        self.order = np.argsort(keys)
        self.keys, self.count = keys[self.order], len(pieces)

    def find(self, words: list[str], width: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For each length n, the piece at each position (``count`` where there is none), and the word lengths."""
        codes = _codes(words, width)
        size = np.array([len(w) for w in words])
        found = []
        for n, h in enumerate(_hashes(codes), start=1):
            at = np.minimum(np.searchsorted(self.keys, h), self.count - 1)
            inside = np.arange(h.shape[1])[None, :] + n <= size[:, None]
            found.append(np.where(inside & (self.keys[at] == h), self.order[at], self.count))
        return found, size


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # pieces + 1 by languages; the last row is "no such piece"
    prior: np.ndarray
    cache_bytes: int = CACHE_BYTES

    def __post_init__(self) -> None:
        self.index, self.cache = Pieces(self.pieces), {}
        self.most = self.cache_bytes // (200 + 4 * len(self.languages))
        self.step = max(16, STEP_BYTES // (16 * (LONGEST + 1) * max(1, len(self.languages))))
        self.rows = np.zeros((1 << 12, len(self.languages)), dtype=np.float32)
        self.used = 1  # row 0: a token without letters

    def forward(self, words: list[str], width: int) -> list[np.ndarray]:
        """alpha[i]: summed probability of the first i characters, words by languages."""
        found, size = self.index.find(words, width)
        alpha = [np.ones((len(words), len(self.languages)))]
        for i in range(1, width + 1):
            now = np.zeros_like(alpha[0])
            for n in range(1, min(PIECE, i) + 1):
                p = self.prob[found[n - 1][:, i - n]]
                if n == 1:
                    p = np.maximum(p, UNKNOWN)
                now += alpha[i - n] * p
            alpha.append(now)
        return alpha

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        parts, owner = [], []
        for i, w in enumerate(words):
            for s in range(0, len(w), LONGEST):
                parts.append(w[s : s + LONGEST])
                owner.append(i)
        out = np.zeros((len(words), len(self.languages)))
        size = np.array([len(p) for p in parts], dtype=np.int64)
        for lo, hi in ((0, 6), (6, 10), (10, 15), (15, LONGEST)):
            own = np.nonzero((size > lo) & (size <= hi))[0]
            for s in range(0, len(own), self.step):
                part = own[s : s + self.step]
                alpha = np.stack(self.forward([parts[i] for i in part], hi))
                np.add.at(out, np.array(owner)[part], np.log(alpha[size[part], np.arange(len(part))]))
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        tokens = [t.lower().split() for t in texts]
        fresh = list({w for ws in tokens for w in ws if w not in self.cache})
        if self.cache and len(self.cache) + len(fresh) > self.most:
            self.cache.clear()
            self.rows = self.rows[: 1 << 12].copy()
            self.used = 1
            fresh = list({w for ws in tokens for w in ws})
        cores = [w.strip(MARKS) for w in fresh]
        cores = [w if w.isalpha() or any(map(str.isalpha, w)) else "" for w in cores]
        named = [w for w in dict.fromkeys(cores) if w]
        if self.used + len(named) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), self.used + len(named)), len(self.languages)), dtype=np.float32)
            grown[: self.used] = self.rows[: self.used]
            self.rows = grown
        self.rows[self.used : self.used + len(named)] = self.word_scores(named)
        place = {w: self.used + i for i, w in enumerate(named)} | {"": 0}
        self.cache.update(zip(fresh, map(place.__getitem__, cores), strict=True))
        self.used += len(named)
        out = []
        for text, ws in zip(texts, tokens, strict=True):
            if not self.languages or not any(c.isalpha() for c in text):
                out.append(("und", 0.0))
                continue
            logs = self.rows[np.fromiter(map(self.cache.__getitem__, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64)
            best = int((self.prior + logs).argmax())
            tempered = self.prior + logs * min(1.0, EVIDENCE / len(ws))
            weight = np.exp(tempered - tempered.max())
            out.append((self.languages[best], float(weight[best] / weight.sum())))
        return out


def learn(docs: DataFrame, vocabulary_path: str) -> Model:
    """Fit on the bounded sample; only word counts (``WORDS`` rows a language) reach the driver."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().collect()  # one row a language
    pieces = vocabulary(vocabulary_path)
    if not counts:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, PER_LANGUAGE / r["count"]))))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / 1_000_003.0
    sample = known.filter(unit < F.try_element_at(share, F.col("lang")))
    marks = "[" + "".join("\\" + m for m in MARKS) + "]+"
    word = F.regexp_replace("word", f"^{marks}|{marks}$", "")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length("word") - 1, F.lit(0)), F.lit(LONGEST)), lambda i: F.substring(F.col("word"), i + 1, F.lit(LONGEST)))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).select("lang", word.alias("word"))
    words = words.select("lang", F.explode(cut).alias("word")).filter("word <> ''").groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = words.withColumn("rank", rank).filter(F.col("rank") <= WORDS).collect()
    top.sort(key=lambda r: (r["lang"], r["rank"]))
    languages = sorted({r["lang"] for r in counts})
    total = sum(r["count"] for r in counts)
    prior = np.log([next(r["count"] for r in counts if r["lang"] == x) / total for x in languages])
    weights: dict[str, np.ndarray] = {}
    for r in top:
        if any(map(str.isalpha, r["word"])):
            weights.setdefault(r["word"], np.zeros(len(languages)))[languages.index(r["lang"])] += r["count"]
    prob = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    prob[-1] = 0.0
    model = Model(languages, pieces, prob, prior)
    vocabulary_words, w = list(weights), np.array(list(weights.values())).reshape(-1, len(languages))
    for _ in range(STEPS if vocabulary_words else 0):
        _maximise(model, vocabulary_words, w)
    model.index = None  # rebuilt on the executors
    return model


def _maximise(model: Model, words: list[str], weights: np.ndarray) -> None:
    """One step of expectation-maximisation: expected piece counts over all segmentations, then smoothed shares."""
    expected = np.zeros_like(model.prob)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    step = max(16, model.step // 4)
    for s in range(0, len(order), step):
        own = order[s : s + step]
        part = [words[i] for i in own]
        width = max(map(len, part))
        found, size = model.index.find(part, width)
        alpha = model.forward(part, width)
        beta = [np.zeros_like(alpha[0]) for _ in range(width + 1)]
        rows = np.arange(len(part))
        for i in range(width, -1, -1):
            beta[i][size == i] = 1.0
            for n in range(1, min(PIECE, width - i) + 1):
                p = model.prob[found[n - 1][:, i]]
                beta[i] += (np.maximum(p, UNKNOWN) * (i < size)[:, None] if n == 1 else p) * beta[i + n]
        scale = weights[own] / np.stack(alpha)[size, rows]
        for i in range(width):
            for n in range(1, min(PIECE, width - i) + 1):
                piece = found[n - 1][:, i]
                np.add.at(expected, piece, alpha[i] * model.prob[piece] * beta[i + n] * scale)
    expected[-1] = 0.0
    pooled = expected.sum(axis=1, keepdims=True)
    pooled = pooled / max(pooled.sum(), 1e-9) + 0.1 / len(model.pieces)
    model.prob = (expected + 20.0 * pooled) / (expected + 20.0 * pooled).sum(axis=0)
    model.prob[-1] = 0.0


def _model(name: str, shared: Broadcast, cache: int) -> Model:
    """The worker's copy of a broadcast model, made once."""

    def make() -> Model:
        languages, pieces, prob, prior = shared.value
        return Model(languages, pieces, prob.astype(np.float64), prior, cache)

    return store.resident(name, make)


def predict(docs: DataFrame, model: Model, cache: int = CACHE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; the text is all that a prediction sees.

    ``cache``: bytes that a worker keeps of known words; fewer cost time only.
    """
    sent = (model.languages, model.pieces, model.prob.astype(np.float32), model.prior)
    shared = docs.sparkSession.sparkContext.broadcast(sent)  # vocabulary by languages: bounded by both parameters
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(name, shared, cache)
        for rows, texts in store.slices(batches):
            found = own.predict(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = store.texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    return predict(docs, learn(docs, vocabulary_path))


def identified(docs: DataFrame, vocabulary_path: str, cache: int = CACHE_BYTES) -> DataFrame:
    """The rows, with all their columns, whose language can be told; those that are ``und`` go."""
    if docs.drop("text").columns == docs.columns:
        raise ValueError("no text column")
    model = learn(docs, vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.prob.astype(np.float32), model.prior))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(name, shared, cache)
        for rows, texts in store.slices(batches):
            yield rows.filter(pa.array([x != "und" for x, _ in own.predict(texts)], pa.bool_()))

    return store.small_batches(docs).mapInArrow(run, docs.schema)
