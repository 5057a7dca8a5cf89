"""Operator 8: hierarchical packing of documents into windows of several context sizes.

A document's ids are cut into whole longest windows; what remains is routed to the smallest tier that holds it.
Tiers are packed from the longest to the shortest: a window starts with a remainder of its tier, its gap is filled
with the longest remainders of shorter tiers that fit, and the last of the gap by cutting one more.  Every window is
therefore full, and its size is a power of two.

Windows of one tier are grouped into steps of equal tokens, and the steps that are closed together are balanced: windows
are dealt, the dearest first, to the step that costs least so far, where a window costs the sum of its pieces' squares
(what attention within pieces costs).

Each task packs its own rows in pools of bounded size, so memory doesn't grow with the input.  Of the whole input only
what is left at the end of a task, less than one window, is dealt anew: the rests of ``GATHER`` tasks are packed
together, and only the last rest of those is cut along the binary digits of its length, so that nothing is padded.

Rows: null text counts as empty (one piece: the end id); repeated rows and doc_ids are packed as documents of their
own; a null doc_id stays null; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import store
from pixelloom.llm.library_tokens import CACHE_BYTES, encoder

TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens packed together, and tokens of one step.
POOL, STEP = 1 << 20, 1 << 16
#: Tasks whose rests are packed together.
GATHER = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"

#: (length, document, start) of a run of ids that has no window yet; lists of them are kept sorted.
Run = tuple[int, int, int]


def pack(runs: list[Run], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[Run]]], list[Run]]:
    """Windows, each (size, pieces), and the runs that are left; none are left if ``last``."""
    top = tiers[-1]
    windows: list[tuple[int, list[Run]]] = []
    free: list[Run] = []
    for n, doc, start in runs:
        while n >= top:
            windows.append((top, [(top, doc, start)]))
            n, start = n - top, start + top
        if n:
            free.append((n, doc, start))
    free.sort()
    for below, tier in reversed(list(zip((0, *tiers[:-1]), tiers, strict=True))):
        while free and free[-1][0] > below:
            pieces, gap = [free.pop()], tier - 0
            gap -= pieces[0][0]
            while gap and free:
                at = bisect_right(free, (gap, 1 << 62, 0))
                if at:
                    piece = free.pop(at - 1)
                else:  # all that is left is longer than the gap
                    n, doc, start = free.pop()
                    piece = (gap, doc, start)
                    insort(free, (n - gap, doc, start + gap))
                pieces.append(piece)
                gap -= piece[0]
            if gap:
                return windows + (_binary(pieces, top) if last else []), [] if last else pieces
            windows.append((tier, pieces))
    return windows, []


def _binary(pieces: list[Run], top: int) -> list[tuple[int, list[Run]]]:
    total, out = sum(p[0] for p in pieces), []
    pieces = pieces[::-1]
    size = top
    while total:
        while size > total:
            size >>= 1
        window, room = [], size
        while room:
            n, doc, start = pieces.pop()
            take = min(n, room)
            window.append((take, doc, start))
            if n > take:
                pieces.append((n - take, doc, start + take))
            room -= take
        out.append((size, window))
        total -= size
    return out


#: A piece before it has a step: document, start, length, checksum, the document's ids, window, offset, size of the window.
Piece = tuple[int | None, int, int, int, int, int, int, int]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Pieces have null ``rest``; one more row of a task has all that no window holds yet, as an Arrow stream, and the task's number in ``sequence_id``.
STAGED = SCHEMA + ", rest binary"
_REST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def balanced(costs: list[int], each: int) -> list[int]:
    """The step of every window: steps of ``each`` windows (the last of fewer), the dearest windows first to the cheapest step."""
    steps = -(-len(costs) // each)
    room = [each] * (steps - 1) + [len(costs) - each * (steps - 1)] if steps else []
    heap = [(0, s) for s in range(steps)]
    out = [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        total, s = heapq.heappop(heap)
        out[i] = s
        room[s] -= 1
        if room[s]:
            heapq.heappush(heap, (total + costs[i], s))
    return out


class _Task:
    """The windows of one task: runs of ids in, pieces out.  ``number`` keeps windows and steps of tasks apart."""

    def __init__(self, number: int):
        #: doc_id, place of the first id held here in its document, the ids, and how many the document has
        self.docs: list[tuple[int | None, int, bytes, int]] = []
        self.runs: list[Run] = []
        self.tokens = 0
        self.sequence = self.step = number << 32
        self.open: dict[int, list[list[Piece]]] = {}  # tier: windows that have no step yet

    def add(self, doc_id: int | None, ids: bytes, start: int = 0, doc_tokens: int | None = None) -> None:
        n = len(ids) // 4
        self.runs.append((n, len(self.docs), 0))
        self.docs.append((doc_id, start, ids, n if doc_tokens is None else doc_tokens))
        self.tokens += n

    def pool(self, last: bool) -> pa.RecordBatch:
        """Pack what is there; all of it with ``last``, which a task's rest doesn't get (see ``rest``)."""
        windows, left = pack(self.runs, last=last)
        for size, pieces in windows:
            at, own = 0, []
            for n, doc, start in pieces:
                doc_id, first, ids, total = self.docs[doc]
                own.append((doc_id, first + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, self.sequence, at, size))
                at += n
            self.open.setdefault(size, []).append(own)
            self.sequence += 1
        kept = {doc: self.docs[doc] for _, doc, _ in left}
        index = {doc: i for i, doc in enumerate(kept)}
        self.docs, self.runs = list(kept.values()), [(n, index[doc], s) for n, doc, s in left]
        self.tokens = sum(r[0] for r in self.runs)
        return self._closed(last)

    def _closed(self, last: bool) -> pa.RecordBatch:
        rows: list[tuple] = []
        for size, windows in self.open.items():
            each = STEP // size
            now = windows if last else windows[: len(windows) // each * each]
            self.open[size] = windows[len(now) :]
            steps = balanced([sum(p[2] ** 2 for p in w) for w in now], each)
            rows += [(*p, self.step + s) for s, w in zip(steps, now, strict=True) for p in w]
            self.step += max(steps, default=-1) + 1
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

    def rest(self) -> pa.Table:
        """What no window holds, with its place in its document."""
        out = []
        for n, doc, s in self.runs:
            doc_id, first, ids, total = self.docs[doc]
            out.append((doc_id, first + s, total, ids[4 * s : 4 * (s + n)]))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, _REST.types, strict=True)], schema=_REST)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, cache: int = CACHE_BYTES) -> DataFrame:
    """One row a piece: where it lies in its document and in its window, its checksum, the window's tier and step.

    ``cache``: bytes that a worker keeps of known words; fewer cost time only.
    """

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.binary())], names=[*_NAMES, "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, cache)
        end = end_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId()
        task = _Task(number << 1)
        for rows, texts in store.slices(batches):
            for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                task.add(doc_id, enc.ids(text) + end)
                if task.tokens >= POOL:
                    yield pieces(task.pool(last=False))
        yield pieces(task.pool(last=False))
        rest = task.rest()
        task.runs = []
        yield pieces(task.pool(last=True))  # closes the last steps
        if rest.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _REST) as out:
                out.write_table(rest)
            numbers = [pa.array([number if c == "sequence_id" else 0], pa.int64()) for c in _NAMES]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*_NAMES, "rest"])

    def gather(table: pa.Table) -> pa.Table:
        """The rests of some tasks, each less than a window."""
        table = table.sort_by("sequence_id")
        task = _Task((table.column("sequence_id")[0].as_py() << 1) + 1)
        for body in table.column("rest").to_pylist():
            rows = pa.ipc.open_stream(body).read_all()
            for doc_id, start, total, ids in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                task.add(doc_id, ids, start, total)
        return pa.Table.from_batches([task.pool(last=True)])

    first = store.staged(store.texts(docs).mapInArrow(run, STAGED), "packing")
    rests = first.filter(F.col("rest").isNotNull()).select(F.floor(F.col("sequence_id") / GATHER).alias("part"), "sequence_id", "rest")
    return first.filter(F.col("rest").isNull()).drop("rest").unionByName(rests.groupBy("part").applyInArrow(gather, SCHEMA))
