"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs, and pairs with one word between.  Every coordinate has its own
learning rate, and the L1 term keeps most weights at exactly zero, so that the model is a short list of non-zero
weights.  It is fitted on a bounded sample of labelled rows: the ``POSITIVE`` and ``NEGATIVE`` rows of either label
with the smallest hashes.  Their features are made on the executors and stored in the order of the hashes; the driver
reads them file by file in every pass and never holds more than a few rows.

Rows: null or empty text gets the score of the bias alone; a null doc_id counts as held out and teaches nothing;
labels repeated for one doc_id count as toxic if any is; null labels teach nothing; with no labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import store
from pixelloom.llm.chunks import MARKS
from pixelloom.llm.langid import held_out

POSITIVE, NEGATIVE, BITS = 5000, 10000, 20
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 3.0, 1.0, 4
#: Bytes of words whose hashes a worker keeps.
CACHE_BYTES = 32 << 20


class _Words(dict):
    """Token to the hash of its word, in bounded memory."""

    used = 0

    def __missing__(self, token: str) -> int:
        if self.used > CACHE_BYTES:
            self.clear()
            self.used = 0
        self.used += 170 + len(token)
        found = self[token] = xxhash.xxh64_intdigest(token.strip(MARKS).encode(), 11)
        return found


def _hashed(text: str) -> np.ndarray:
    """Bucket of every n-gram and skip-gram, repeats included."""
    tokens = text.lower().split()
    words = store.resident("toxicity words", _Words)
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    c = np.uint64(0x9E3779B97F4A7C15)
    grams = [h * np.uint64(3), h[:-1] * c + h[1:] * np.uint64(5), h[:-2] * c + h[2:] * np.uint64(7)]
    mixed = np.concatenate(grams)
    return ((mixed ^ (mixed >> np.uint64(29))) * c >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> np.ndarray:
    return np.unique(_hashed(text))


def fit(rows: Callable[[], Iterable[tuple[np.ndarray, int]]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, buckets, weights) of the non-zero weights; ``rows`` is called once for each of the ``PASSES``."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) <= L1, 0.0, w)

    for _ in range(PASSES):
        for found, label in rows():
            at = np.append(found.astype(np.int64), size)
            w = weight(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    kept = np.nonzero(w[:-1])[0]
    return float(w[-1]), kept, w[kept]


def learn(docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    one = one.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.withColumn("o", F.xxhash64("doc_id", F.lit(3)))
    pick = lambda label, most: one.filter(F.col("toxic") == label).orderBy("o", "doc_id").limit(most)
    chosen = pick(1, POSITIVE).unionByName(pick(0, NEGATIVE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in store.slices(batches):
            found = [features(t).astype("<u4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(3), rows.column(0), pa.array(found, pa.binary())], names=["o", "toxic", "doc_id", "f"])

    # at most POSITIVE + NEGATIVE rows of three numbers are broadcast
    joined = store.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "o", "toxic")
    made = joined.mapInArrow(run, "o long, toxic int, doc_id long, f binary")
    files = sorted(store.staged(made.orderBy("o", "doc_id", F.xxhash64("f")), "toxicity-rows").inputFiles())

    def rows() -> Iterator[tuple[np.ndarray, int]]:
        for file in files:
            fs, local = store.filesystem(file)
            with fs.open_input_file(local) as f:
                for batch in pq.ParquetFile(f).iter_batches(64, columns=["toxic", "f"]):
                    for label, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        yield np.frombuffer(found, "<u4"), label

    return fit(rows)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    bias, buckets, weights = model
    shared = docs.sparkSession.sparkContext.broadcast((bias, buckets.astype(np.int32), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b0, at, w = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for rows, texts in store.slices(batches):
            scores = []
            for t in texts:
                found = _hashed(t)
                found = np.unique(found[dense[found] != 0.0])
                scores.append(1.0 / (1.0 + np.exp(-np.clip(b0 + dense[found].sum(), -35, 35))))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    source = store.texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels)
    out = score(docs, model)
    if not len(model[1]) and model[0] == 0.0:  # nothing was learned
        return out.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return out
