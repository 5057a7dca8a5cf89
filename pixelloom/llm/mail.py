"""Messages between many senders and many receivers whose number of rows follows the bytes, not senders times receivers.

A sender (a block of documents, a partition of keys) has a few bytes for most receivers.  Up to ``FAN`` receivers, each
message is a row.  Beyond, a sender makes at most ``FAN`` rows, each with its messages for all receivers of one group; rows
of a group are dealt to tasks, which sort the messages out by receiver and send on one row for all that they hold.
What arrives is the same either way: (receiver, parcel), a parcel being frames of sender and body.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Receivers that a sender addresses one by one, and bytes that a sorting task holds.
FAN, HELD = 4096, 32 << 20
POSTED = "to long, sender long, parcel binary"
_POSTED = pa.schema([("to", pa.int64()), ("sender", pa.int64()), ("parcel", pa.binary())])
_FRAME = "<qi"
_HEAD = struct.calcsize(_FRAME)


def frame(number: int, body: bytes) -> bytes:
    return struct.pack(_FRAME, number, len(body)) + body


def frames(parcel: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(parcel):
        number, size = struct.unpack_from(_FRAME, parcel, at)
        at += _HEAD
        yield number, parcel[at : at + size]
        at += size


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, _POSTED.types, strict=True)], schema=_POSTED)


def post(sender: int, messages: Iterable[tuple[int, bytes]], receivers: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of one sender, in batches of about ``size`` bytes."""
    direct = receivers <= FAN
    rows: list[tuple[int, int, bytes]] = []
    groups: dict[int, list[bytes]] = {}
    held = 0
    for to, body in messages:
        if direct:
            rows.append((to, sender, frame(sender, body)))
        else:
            groups.setdefault(to % FAN, []).append(frame(to, body))
        held += len(body)
        if direct and held >= size:
            yield _batch(rows)
            rows, held = [], 0
    for group, parts in groups.items():
        rows.append((group, sender, b"".join(parts)))
        held += len(rows[-1][2])
        if held >= size:
            yield _batch(rows)
            rows, held = [], 0
    yield _batch(rows)


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups to rows of receivers."""
    parcels: dict[int, list[bytes]] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        out = _batch([(to, 0, b"".join(parts)) for to, parts in parcels.items()])
        parcels.clear()
        return out

    for b in batches:
        for sender, parcel in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for to, body in frames(parcel):
                parcels.setdefault(to, []).append(frame(sender, body))
            held += len(parcel)
            if held >= HELD:
                yield flush()
                held = 0
    yield flush()


def deliver(posted: DataFrame, receivers: int) -> DataFrame:
    """(to, parcel): all parcels of a receiver together hold its messages once each."""
    if receivers > FAN:
        spread = -(-receivers // FAN)
        tasks = max(FAN, int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        posted = posted.repartition(tasks, "to", F.pmod(F.xxhash64("sender"), F.lit(spread))).mapInArrow(_sorted_out, POSTED)
    return posted.select("to", "parcel")
