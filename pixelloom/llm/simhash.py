"""Operator 4: SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a random vector of ``radius + 1`` bits; for each non-zero vector v the mask drops the bits
whose vector is orthogonal to v.  The positions in which two fingerprints within the radius differ span at most
``radius`` dimensions, so some v is orthogonal to them all, its mask drops them, and the pair agrees under it: no pair
is missed.

Only distinct fingerprints are compared.  Buckets of one fingerprint are dropped before any Python code; a bucket
with more than ``BLOCK`` is cut into blocks whose pairs of blocks are dealt out as tasks of their own, which is exact.
Within a block a breadth-first search gives a spanning forest instead of all pairs.  Links and labels stay in tables.

Rows: null text has fingerprint zero; a null doc_id takes part, and counts as larger than any other when the
smallest doc_id of a component is chosen; repeated rows fall into one component; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import components, store

SHINGLE, RADIUS, BLOCK = 4, 4, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)
    bits = np.zeros(64, dtype=np.int64)
    for s in range(0, n, 1 << 16):
        part = hashes[s : s + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits that together cover every difference of ``radius`` bits."""
    rnd = random.Random(seed)
    own = [rnd.randrange(1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i in range(64) if (own[i] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.vacate()
        for rows, texts in store.slices(batches):
            fps = [_signed(fingerprint(t.encode())) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return store.texts(docs).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph of all links among distinct fingerprints."""
    left = np.unique(fps)
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            found = left[near]
            left = left[~near]
            a += [x] * len(found)
            b += found.tolist()
            queue += found.tolist()
    return a, b


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) edges between fingerprints, enough to connect all that are linked, from the table of distinct ``fp``."""
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks(radius))))
    tables = distinct.select("fp", F.explode(keys).alias("bucket"))
    counts = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    # written, so that the join can split a bucket that holds very many rows
    counts = store.staged(counts, "simhash-buckets")
    pairs = counts.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    hit = tables.join(counts.filter("n > 2").select("bucket", "n"), "bucket")
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int")
    other: Column = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = hit.withColumn("k", k).withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("bucket", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def search(table: pa.Table) -> pa.Table:
        x, y = _forest(table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": np.array(x, dtype=np.uint64).view(np.int64), "b": np.array(y, dtype=np.uint64).view(np.int64)})

    found = dealt.groupBy("bucket", "i", "j").applyInArrow(search, "a long, b long")
    return pairs.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def _components(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of a table of distinct ``fp``; a fingerprint without links is its own component."""
    edges = store.staged(links(distinct.select("fp"), radius), "simhash-links")
    label = components.connected(edges)
    return distinct.join(label, distinct["fp"] == label["node"], "left").select(*distinct.columns, F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id that can be reached over links)."""
    fps = store.staged(fingerprints(docs), "simhash-fps")
    distinct = store.staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    named = store.staged(_components(distinct, radius), "simhash-named")
    ids = store.staged(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-ids")
    per_fp = named.join(ids, "component").select("fp", "component_id")
    return fps.join(per_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows, all columns as they are, that stand for their group of near-duplicates.

    That is the row with the smallest doc_id (null is the largest), of several such the one with the smallest hash of
    its text; of equal ones the first written.  Every row takes part as one of its own.
    """
    column, key = docs.columns.index("text"), docs.columns.index("doc_id")
    blocks = store.blocks(docs, "simhash-blocks")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.vacate()
        for b in batches:
            for block in b.to_pylist():
                table = store.read_block(block["path"])
                texts, n = store.block_texts(table, column), table.num_rows
                fps = [_signed(fingerprint(t)) for t in texts]
                own = [_signed(xxhash.xxh64_intdigest(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block["blk"]] * n, pa.int64()), pa.array(range(n), pa.int32()), table.column(key).cast(pa.int64()).combine_chunks(), pa.array(own, pa.int64()), pa.array(fps, pa.int64())],
                    names=["blk", "row", "doc_id", "h", "fp"],
                )

    fps = store.dealt(blocks).mapInArrow(prints, "blk long, row int, doc_id long, h long, fp long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "blk", "row")).alias("first")
    distinct = store.staged(fps.groupBy("fp").agg(first), "simhash-distinct")
    named = _components(distinct, radius)
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select("first.blk", "first.row")
    rows = kept.groupBy("blk").agg(F.collect_list("row").alias("rows"))  # at most the rows of a block
    table = store.dealt(store.staged(blocks.join(rows, "blk"), "simhash-kept"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                own = store.read_block(block["path"]).take(pa.array(sorted(block["rows"]), pa.int64()))
                yield from store.with_text(own, column, iter(own.column(column).to_pylist()))

    return table.mapInArrow(pick, docs.schema)
