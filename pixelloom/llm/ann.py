"""Operator 7: nearest neighbours by learned partitions of a neighbour graph.

Parts are learned in two levels of about the square root of their number each.  At a level a bounded sample of vectors is linked to
its nearest neighbours, the graph is cut into parts of equal size that keep neighbours together, and two small
softmax classifiers learn from a vector its own part (where a row is stored) and the parts of its neighbours (where a
query goes).  Offsets of the first keep the parts balanced.  The upper level is fitted on at most ``SAMPLE`` rows, the
lower one inside each upper part, on the executors, on about ``SAMPLE`` rows in all or ``LEAST`` a part.

There are about sqrt(n) / 5 parts, so a part has about 5 sqrt(n) rows.  A query visits its most probable parts until
their probabilities reach a share that, on rows of the sample kept out of the routing fit, finds ``TARGET`` of their
neighbours, and until those parts hold twice the rows it asks for.  A query that still ends with too few (repeated ids
can do that) is asked again in every part.  Parts and queries are dealt in blocks of bounded size, so a part that can't
be split, as many copies of one vector, may hold any share of the rows.  Candidates are ranked by the inner product of
the original vectors in double precision.

Rows: vectors that are null, zero, or hold null or non-finite components take no part, nor does a null vec_id; the
inner product of vectors of different lengths is not defined, so only those of the most frequent length take part
(of the shortest such where lengths tie); rows that share a vec_id are never candidates of each other; ties go to the
smaller vec_id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelloom.llm import store

SAMPLE, LEAST, NEIGHBOURS, TARGET, BLOCK, MOST_PARTS = 8192, 512, 10, 0.95, 8192, 256


def valid(table: DataFrame) -> DataFrame:
    """vec_id and the vector in doubles, of the rows that take part."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0.0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def neighbours(queries: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of x with the largest inner product with each query; ``own`` is the query's row in x."""
    out = np.empty((len(queries), k), dtype=np.int64)
    for s in range(0, len(queries), 512):
        fit = queries[s : s + 512] @ x.T
        fit[np.arange(len(fit)), own[s : s + 512]] = -np.inf
        out[s : s + 512] = np.argpartition(-fit, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size: balanced clusters at first, then moves along the graph while there is room."""
    n, room = len(x), -(-len(x) // parts)
    rnd = np.random.default_rng(0)
    centres = x[rnd.choice(n, parts, replace=False)]
    for _ in range(8):
        far = ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :])
        own, free = np.full(n, -1), np.full(parts, room)
        for i in np.argsort(far.min(axis=1) - np.median(far, axis=1)):
            best = np.where(free > 0, far[i], np.inf).argmin()
            own[i], free[best] = best, free[best] - 1
        for p in range(parts):
            if (own == p).any():
                centres[p] = x[own == p].mean(axis=0)
    size, most = np.bincount(own, minlength=parts), int(room * 1.1) + 1
    for _ in range(4 if near.shape[1] else 0):
        moved = 0
        for i in rnd.permutation(n):
            votes = np.bincount(own[near[i]], minlength=parts)
            p = int(votes.argmax())
            if p != own[i] and votes[p] > votes[own[i]] and size[p] < most:
                size[own[i]] -= 1
                size[p] += 1
                own[i] = p
                moved += 1
        if not moved:
            break
    return own


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regression(f: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a softmax regression to shares."""
    w = np.zeros((f.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 251):
        g = f.T @ (_softmax(f @ w) - target) / len(f) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Router:
    """One level: a classifier for the part of a row, and one for the parts of a query's neighbours."""

    def __init__(self, x: np.ndarray, parts: int, asked: np.ndarray | None = None):
        """``asked``: the rows whose neighbours the second classifier learns from, all by default."""
        self.parts = parts = max(1, min(parts, len(x)))
        # of most rows, so that few far ones don't blur what lies close together
        self.middle = np.median(x, axis=0)
        spread = np.median(np.abs(x - self.middle), axis=0) * 1.5
        self.scale = 1 / np.where(spread > 1e-12, spread, np.maximum(x.std(axis=0), 1e-12))
        if parts == 1:
            return
        k = min(NEIGHBOURS, len(x) - 1)
        near = neighbours(x, np.arange(len(x)), x, k)
        own = balanced(x, near, parts)
        f = self._features(x)
        self.place_w = _regression(f, np.eye(parts)[own])
        logits = f @ self.place_w
        self.offset = np.zeros(parts)
        best = (np.inf, self.offset)
        for t in range(200):
            size = np.bincount((logits + self.offset).argmax(axis=1), minlength=parts)
            best = min(best, (int(size.max()), self.offset.copy()), key=lambda b: b[0])
            self.offset -= np.clip(np.log((size + 0.5) / (len(x) / parts)), -1, 1) * (1.0 if t < 50 else 0.3 if t < 120 else 0.1)
        self.offset = best[1]
        stored = self.place(x)
        asked = np.arange(len(x)) if asked is None else asked
        share = np.zeros((len(asked), parts))
        for j in range(k):
            np.add.at(share, (np.arange(len(asked)), stored[near[asked, j]]), 1.0 / k)
        self.route_w = _regression(f[asked], share) if k else self.place_w

    def _features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.middle) * self.scale, -8, 8), np.ones((len(x), 1))])

    def place(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros(len(x), dtype=np.int64)
        return (self._features(x) @ self.place_w + self.offset).argmax(axis=1)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Of each vector's neighbours, the expected share in each part."""
        return np.ones((len(x), 1)) if self.parts == 1 else _softmax(self._features(x) @ self.route_w)


class Tree:
    """Both levels; ``sizes`` are the rows stored in each part, ``share`` how much probability a query visits."""

    def __init__(self, top: Router, lower: dict[int, Router]):
        self.top, self.lower, self.share = top, lower, 1.0
        self.first = np.concatenate([[0], np.cumsum([lower[p].parts if p in lower else 1 for p in range(top.parts)])])
        self.parts = int(self.first[-1])
        self.sizes = np.ones(self.parts, dtype=np.int64)

    def place(self, x: np.ndarray) -> np.ndarray:
        upper = self.top.place(x)
        out = self.first[upper]
        for p in np.unique(upper):
            if p in self.lower:
                own = np.nonzero(upper == p)[0]
                out[own] += self.lower[p].place(x[own])
        return out

    def route(self, x: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts that each query visits, likeliest first: ``share`` of the probability, and ``least`` rows."""
        out: list[np.ndarray] = []
        for s in range(0, len(x), 512):
            part = x[s : s + 512]
            upper = self.top.shares(part)
            p = np.concatenate([upper[:, [i]] * (self.lower[i].shares(part) if i in self.lower else 1.0) for i in range(self.top.parts)], axis=1)
            p[:, self.sizes == 0] = 0.0
            order = np.argsort(-p, axis=1, kind="stable")
            reached = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
            held = np.cumsum(self.sizes[order], axis=1)
            enough = (reached >= self.share * reached[:, -1:] - 1e-12) & (held >= min(least, int(self.sizes.sum())))
            out += [order[i, : int(enough[i].argmax()) + 1] for i in range(len(part))]
        return out


def fit(v: DataFrame, n: int) -> Tree:
    """The tree for a table (vec_id, v) of n rows."""
    parts = max(1, min(MOST_PARTS**2, round(n**0.5 / 5)))
    upper = max(1, round(parts**0.5))
    order = (F.xxhash64("vec_id", F.lit(1)), "vec_id")
    x = np.array([r["v"] for r in v.orderBy(*order).limit(SAMPLE).collect()], dtype=np.float64)
    rnd = np.random.default_rng(1)
    kept_out = rnd.permutation(len(x))[: min(512, len(x) // 5)]
    rest = np.setdiff1d(np.arange(len(x)), kept_out)
    top = Router(x, upper, rest)
    shared = v.sparkSession.sparkContext.broadcast(top)  # at most MOST_PARTS numbers a dimension
    lower_parts = -(-parts // top.parts)
    rate = min(1.0, max(SAMPLE, LEAST * top.parts) / n)
    width = x.shape[1]
    held = kept_out_hashes(x[kept_out])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.place(_matrix(b.column(1), width)).astype(np.int32)), *b.columns], names=["part", "vec_id", "v"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        own = _matrix(table.column("v").combine_chunks(), width)
        seen = np.nonzero([row.tobytes() not in held for row in own])[0]
        router = Router(own, min(lower_parts, max(1, len(own) // 16)), seen if len(seen) else None)
        return pa.table({"part": table.column("part").slice(0, 1), "router": pa.array([pickle.dumps(router)], pa.binary())})

    lower: dict[int, Router] = {}
    if lower_parts > 1:
        sample = v.filter(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1_000_003)) / 1_000_003.0 < rate)
        placed = sample.mapInArrow(place, "part int, vec_id long, v array<double>")
        # one row a part of the upper level, of at most MOST_PARTS numbers a dimension
        lower = {r["part"]: pickle.loads(bytes(r["router"])) for r in placed.groupBy("part").applyInArrow(learn, "part int, router binary").collect()}
    tree = Tree(top, lower)
    k = min(2 * NEIGHBOURS, len(x) - 1)
    if k and len(kept_out):
        stored = tree.place(x)
        near = neighbours(x[kept_out], kept_out, x, k)
        steps = np.linspace(0.3, 1.0, 71)
        for tree.share in steps:
            hit = np.mean([np.isin(stored[near[i]], visited).mean() for i, visited in enumerate(tree.route(x[kept_out], 0))])
            if hit >= TARGET:
                break
    return tree


def kept_out_hashes(x: np.ndarray) -> frozenset[bytes]:
    """The vectors (at most 512) that routing must not learn from, as bytes."""
    return frozenset(row.tobytes() for row in x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _nearest(k: int, width: int):
    """The k nearest of each query among the rows of a bundle that lie in parts it visits."""

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks(), width)
        lists = table.column("parts").combine_chunks()
        flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), size)
        stored, asked = role[row] == 0, role[row] == 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for p in np.unique(flat[stored]):
            own = row[stored & (flat == p)]
            queries = row[asked & (flat == p)]
            for s in range(0, len(queries), 256):
                q = queries[s : s + 256]
                rough = x[q] @ x[own].T
                rough[ids[q, None] == ids[None, own]] = -np.inf
                m = min(k, len(own))
                floor = np.partition(rough, len(own) - m, axis=1)[:, len(own) - m, None]
                at, near = np.nonzero((rough >= floor - 1e-9 * (1 + np.abs(floor))) & (rough > -np.inf))
                # the same sum whatever the block
                found.append((ids[q[at]], ids[own[near]], np.concatenate([(x[q[at[c : c + 8192]]] * x[own[near[c : c + 8192]]]).sum(axis=1) for c in range(0, len(at), 8192)] or [np.zeros(0)])))
        query, near, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((near, -score, query))
        query, near, score = query[order], near[order], score[order]
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (near[1:] != near[:-1]) | (score[1:] != score[:-1])
        query, near, score = query[new], near[new], score[new]
        first = np.searchsorted(query, query)
        best = np.arange(len(query)) - first < k
        return pa.table({"query_id": query[best], "vec_id": near[best], "score": score[best]}, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def bundles(sizes: np.ndarray) -> np.ndarray:
    """The bundle of each part: neighbours by number that together hold at most BLOCK rows, or one part with more."""
    out, held, bundle = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for p, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            bundle, held = bundle + 1, 0
        out[p], held = bundle, held + n
    return out


def _asked(index: DataFrame, queries: DataFrame, sizes: np.ndarray, k: int, width: int) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest in each bundle that a query visits; ``queries``: vec_id, v, parts.

    Parts are searched one by one, but travel in bundles, so a query and its answers travel once a bundle.
    """
    bundle = bundles(sizes)
    blocks = np.maximum(1, -(-np.bincount(bundle, weights=sizes).astype(np.int64) // BLOCK))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(bundle[p]) for p in b.column(0).to_numpy(zero_copy_only=False)], pa.list_(pa.int32()))], names=["b"])

    visited = queries.select("parts").mapInArrow(visits, "b array<int>").select(F.explode("b").alias("b"))
    counts = {r["b"]: r["count"] for r in visited.groupBy("b").count().collect()}  # one row a bundle
    q_blocks = np.array([-(-counts.get(b, 0) // BLOCK) for b in range(len(blocks))])

    def rows(b: pa.RecordBatch, at: np.ndarray, group: np.ndarray, block: np.ndarray, q: np.ndarray, role: int, parts: pa.Array) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        columns = [pa.array(c, pa.int32()) for c in (group, block, q, np.full(len(at), role))]
        return pa.RecordBatch.from_arrays([*columns, parts, b.column(0).take(take), b.column(1).take(take)], names=["bundle", "block", "q", "role", "parts", "vec_id", "v"])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, p = b.column(0).to_numpy(), b.column(2).to_numpy()
            group = bundle[p]
            block = (ids * 2654435761 >> 7) % blocks[group]
            for q in range(int(q_blocks[group].max(initial=0))):
                on = np.nonzero(q_blocks[group] > q)[0]
                parts = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1), pa.int32()), pa.array(p[on], pa.int32()))
                yield rows(b, on, group[on], block[on], np.full(len(on), q), 0, parts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                ids = b.column(0).to_numpy()
                at, group, block, parts = [], [], [], []
                for i, own in enumerate(b.column(2).to_numpy(zero_copy_only=False)):
                    for g in np.unique(bundle[own]).tolist():
                        for n in range(int(blocks[g])):
                            at.append(i)
                            group.append(g)
                            block.append(n)
                            parts.append(own[bundle[own] == g])
                at, group = np.array(at, dtype=np.int64), np.array(group, dtype=np.int64)
                yield rows(b, at, group, np.array(block, dtype=np.int64), (ids[at] * 40503 >> 5) % q_blocks[group], 1, pa.array(parts, pa.list_(pa.int32())))

    schema = "bundle int, block int, q int, role int, parts array<int>, vec_id long, v array<double>"
    every = index.mapInArrow(stored, schema).unionByName(queries.mapInArrow(dealt, schema))
    return every.groupBy("bundle", "block", "q").applyInArrow(_nearest(k, width), "query_id long, vec_id long, score double")


def search(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score, visited (parts) and parts: the k nearest of every row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    v = store.staged(valid(table), "ann-vectors")
    n = v.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited int, parts int")
    tree = fit(v, n)
    width = len(v.first()["v"])
    shared = spark.sparkContext.broadcast(tree)  # at most MOST_PARTS squared numbers a dimension

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = shared.value.place(_matrix(b.column(1), width))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    index = store.staged(v.mapInArrow(place, "vec_id long, v array<double>, part int"), "ann-index")
    tree.sizes[:] = 0
    for r in index.groupBy("part").count().collect():  # one row a part
        tree.sizes[r["part"]] = r["count"]
    sized = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = sized.value.route(_matrix(b.column(1), width), 2 * k)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["vec_id", "v", "parts"])

    is_query = index.filter(F.col("vec_id") % every == 0)
    queries = store.staged(is_query.select("vec_id", "v").mapInArrow(route, "vec_id long, v array<double>, parts array<int>"), "ann-queries")
    found = store.staged(_asked(index, queries, tree.sizes, k, width), "ann-found")
    # whoever got fewer than k though there are more: repeats of a vec_id, or parts that hold little else
    short = queries.select("vec_id").distinct().join(found.distinct().groupBy("query_id").count().filter(F.col("count") >= k), F.col("vec_id") == F.col("query_id"), "left_anti")
    again = store.staged(queries.join(short, "vec_id", "left_semi").withColumn("parts", F.sequence(F.lit(0), F.lit(tree.parts - 1))), "ann-again") if n > k else None
    if again is not None and again.limit(1).count():
        found = found.unionByName(store.staged(_asked(index, again, tree.sizes, k, width), "ann-found-again"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    visited = queries.groupBy("vec_id").agg(F.max(F.size("parts")).alias("visited")).withColumnRenamed("vec_id", "_query")
    ranked = ranked.join(visited, F.col("query_id") == F.col("_query"))
    return ranked.select("query_id", "rank", "vec_id", "score", "visited", F.lit(tree.parts).alias("parts"))
