"""Shared storage and small helpers that every operator uses.

Intermediate tables go to folders of ``pixelloom.scratch``.  Files are written under a name of the attempt and become
visible only through the rows of tasks that ended well, so lost executors and repeated attempts do no harm.

Operators that must bring a verdict back to whole rows write the rows once as block files (``blocks``).  A row is
then known by its block and its place in it, whatever its columns are called and however often its doc_id occurs;
verdicts travel to the block, and rows never travel to the verdicts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.scratch import filesystem, scratch, shared_dir  # noqa: F401

#: Bytes of text that a Python operator handles at once inside one Arrow batch.
SLICE_BYTES = 1 << 21
#: Bytes of text of a block file.
BLOCK_BYTES = 8 << 20
BATCH = "4m"
_RESIDENT: dict[str, object] = {}


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table to shared storage and read it back, which cuts the lineage and keeps it from being made twice."""
    path = (folder or shared_dir(df.sparkSession, name)) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """Batches to Python of ``BATCH`` bytes instead of Spark's 64 MB, which both sides hold, unless the session says otherwise."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) in ("67108864b", "67108864", "64m"):
        conf.set(key, BATCH)
    return df


def texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and the text, null text as the empty one.  Other columns are not read."""
    return small_batches(df).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def resident(name: str, make: Callable[[], object]) -> object:
    """The one large object (a model with its caches) that a Python worker keeps for its next task."""
    if name not in _RESIDENT:
        vacate()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def vacate() -> None:
    """Give what an earlier operator left in this Python worker back to the system: workers outlive stages."""
    _RESIDENT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def text_hash(column: str = "text") -> Column:
    """64 bits of the text: tells rows apart that share a doc_id."""
    return F.xxhash64(F.col(column))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows holding about ``size`` bytes of text (one row at least), each with its texts as a list."""
    for batch in batches:
        column = batch.schema.names.index("text")
        for part in _cut(batch, column, size):
            yield part, [x or "" for x in part.column(column).to_pylist()]


def blocks(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Write the rows, with all their columns, as Arrow files of about ``BLOCK_BYTES`` of text; (blk, path, n, size) of each file."""
    folder = shared_dir(small_batches(docs).sparkSession, name)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        task = TaskContext.get()
        fs, root = filesystem(folder)
        made: list[dict] = []
        files: list = []

        def end() -> pa.RecordBatch:
            for f in reversed(files):
                f.close()
            files.clear()
            return pa.RecordBatch.from_pylist([made[-1]])

        for batch in batches:
            for rows in _cut(batch, column, SLICE_BYTES):
                if not files:
                    path = f"{task.partitionId():08d}-{task.taskAttemptId()}-{len(made)}.arrow"
                    made.append({"blk": task.partitionId() << 24 | len(made), "path": f"{folder}/{path}", "n": 0, "size": 0})
                    files.append(fs.open_output_stream(f"{root}/{path}"))
                    files.append(pa.ipc.new_file(files[0], rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")))
                files[1].write_batch(rows)
                made[-1]["n"] += rows.num_rows
                made[-1]["size"] += text_bytes(rows.column(column))
                if made[-1]["size"] >= BLOCK_BYTES:
                    yield end()
        if files:
            yield end()

    return staged(docs.mapInArrow(run, "blk long, path string, n long, size long"), f"{name}-list")


def text_bytes(column: pa.Array) -> int:
    return int(pa.compute.sum(pa.compute.binary_length(column)).as_py() or 0)


def read_block(path: str) -> pa.Table:
    fs, local = filesystem(path)
    with fs.open_input_file(local) as f:
        return pa.ipc.open_file(f).read_all()


def block_texts(table: pa.Table, column: int) -> list[bytes]:
    """The texts of a block as UTF-8, null as empty."""
    return [x or b"" for x in table.column(column).cast(pa.binary()).to_pylist()]


def dealt(table: DataFrame, least: int = 1) -> DataFrame:
    """A table of blocks in tasks of about ``least`` blocks, four a core where there are so many."""
    cores = max(table.sparkSession.sparkContext.defaultParallelism, 2)
    return table.repartition(max(4 * cores, table.count() // max(least, 8)))


def with_text(table: pa.Table, column: int, texts: Iterator[str | None]) -> Iterator[pa.RecordBatch]:
    """The block's rows with other texts, in batches of about ``SLICE_BYTES``."""
    own: list[str | None] = []
    start = size = 0
    for i, t in enumerate(texts):
        own.append(t)
        size += len(t or "")
        if size >= SLICE_BYTES or i + 1 == table.num_rows:
            part = table.slice(start, len(own)).combine_chunks()
            arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in part.columns]
            arrays[column] = pa.array(own, table.schema.field(column).type)
            yield pa.RecordBatch.from_arrays(arrays, names=table.schema.names)
            start, size, own = i + 1, 0, []


def _cut(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about ``size`` bytes of text, one row at least."""
    lengths = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        total += 0 if n is None or n != n else int(n)
        if total >= size or i + 1 == len(lengths):
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
