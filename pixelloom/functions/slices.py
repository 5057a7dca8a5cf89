"""Cuts of Arrow batches by the bytes of a payload column, so that Python holds few payloads at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of payload that a Python operator turns into objects at once.
SLICE_BYTES = 1 << 23


def cut(batch: pa.RecordBatch, payload: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of payload, one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(payload), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def images(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[dict | None]]]:
    """Cuts by the ``data`` of an image struct, each with its images as dictionaries."""
    for batch in batches:
        if batch.num_rows:
            for part in cut(batch, batch.column(column).field("data")):
                yield part, part.column(column).to_pylist()
