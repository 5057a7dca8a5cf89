"""Operator 9: media columns in lossless WebP.

A text's bytes, padded, are 8-bit samples of gray images 192 pixels wide; a payload of more than ``ROWS`` rows becomes
several files back to back.  The files are what the codec's writer makes of them: a palette, prefix codes that follow
the counts, back references.  They are read by the codec's decoder, which takes all files of a slice in step.

Rows: null text counts as empty, whose payload is 192 blanks; repeated rows and doc_ids give rows of their own; a
null doc_id stays null; extra columns are ignored; an empty table gives an empty table.  Map-only; a task holds the
files of one slice of rows, and of a longer text some megabytes of files at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.functions import webp as codec
from pixelloom.llm import store

WIDTH, ROWS = 192, 48
#: Bytes of text whose files are read in step, and of samples that are written at once.
READ_BYTES, WRITE_BYTES = 6 << 20, 1 << 18


def payload(text: bytes) -> bytes:
    return text + b" " * (WIDTH - len(text) if not text else -len(text) % WIDTH)


def to_media(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    images, owner = [], []
    for i, data in enumerate(payloads):
        rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
        images += [rows[s : s + ROWS] for s in range(0, len(rows), ROWS)]
        owner += [i] * -(-len(rows) // ROWS)
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, z in _starts([x.size for x in images], WRITE_BYTES):
        for i, file in zip(owner[a:z], codec.encode_gray(images[a:z]), strict=True):
            out[i].append(file)
    return [b"".join(files) for files in out]


def _starts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of images of about ``most`` bytes."""
    begin = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most or i + 1 == len(sizes):
            yield begin, i + 1
            begin, total = i + 1, 0


def files_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def from_media(media: list[bytes]) -> list[np.ndarray]:
    """The samples, rows of 192, of each stored form."""
    files = [files_of(m) for m in media]
    flat = [f for own in files for f in own]
    gray: list[np.ndarray] = []
    for a, z in _starts([2 * len(f) for f in flat], READ_BYTES):
        gray += [x[:, :, 2] for x in codec.decode_many(flat[a:z])]
    out, at = [], 0
    for own in files:
        out.append(np.concatenate(gray[at : at + len(own)]))
        at += len(own)
    return out


def describe(samples: np.ndarray) -> str:
    """Size, mean, entropy of the values, and a 64-bit hash of which of 64 equal strips are above the mean."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / len(flat)
    strips = np.add.reduceat(flat.astype(np.int64), np.arange(64) * len(flat) // 64) * 64 > int(flat.sum(dtype=np.int64))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={flat.mean():.6f};entropy={abs(-(share * np.log2(share)).sum()):.6f};strips={np.packbits(strips).tobytes().hex()}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, media (the stored bytes) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.vacate()
        for rows, texts in store.slices(batches, READ_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(to_media([payload(t.encode()) for t in texts]), pa.binary())], names=["doc_id", "media"])

    return store.texts(docs).mapInArrow(run, "doc_id long, media binary")


def digests(docs: DataFrame) -> DataFrame:
    """Store every text, read it back from the stored bytes and describe it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.vacate()
        for rows, texts in store.slices(batches, READ_BYTES):
            raw = [t.encode() for t in texts]
            stored = to_media([payload(t) for t in raw])
            out: list[tuple] = []
            for t, kept, samples in zip(raw, stored, from_media(stored), strict=True):
                back = samples.tobytes()
                out.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(kept), hashlib.sha256(kept).hexdigest(), describe(samples)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return store.texts(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
