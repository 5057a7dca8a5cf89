"""Frames of video containers as a Python data source.

AVI files with raw frames (24 bits, or 8 bits through a palette) give pixels; Motion JPEG in AVI, and JPEG or PNG frames in
QuickTime and MP4 files, give the coded frames, which ``decoded`` turns into pixels with the JVM's decoders.  Other
codecs need a decoder that is not part of Spark: their files give one row of ``frame_index`` -1 with the container's metadata
and ``error``, as files without any frame do without ``error``.

A file is one partition; frames are read one after another, and a filter on ``frame_index`` is pushed into the reader,
which then stops at the cap.  Files must be on a path that the executors can open.  A frame with fewer bytes than it
needs (a truncated file, a dropped frame) has null data.
"""

from __future__ import annotations

import glob
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, LessThan, LessThanOrEqual

from pixelloom import schemas
from pixelloom.functions.classify import is_video_path
from pixelloom.scratch import filesystem, shared_dir
from pixelloom.sources import files

SCHEMA = "path string, frame_index int, frame_count int, fps double, width int, height int, nChannels int, coded string, data binary, error string"
FAILED = "Failed to load video"


def _failed(path: str) -> tuple:
    return (path, -1, -1, -1.0, -1, -1, None, None, None, FAILED)


def _chunks(f, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, position, size) of every data chunk; lists are entered."""
    while f.tell() + 8 <= end:
        name, size = struct.unpack("<4sI", f.read(8))
        at = f.tell()
        if name in (b"RIFF", b"LIST"):
            f.seek(at + 4)
            yield from _chunks(f, min(end, at + size))
        else:
            yield name, at, size
        f.seek(at + size + (size & 1))


def _raw(raw: bytes, width: int, height: int, bits: int, palette: bytes, upright: bool) -> bytes | None:
    """B,G,R rows from the top down, or None where bytes are missing; raw rows are padded to four bytes."""
    each = bits // 8
    stride = (width * each + 3) // 4 * 4
    if len(raw) < stride * height:
        return None
    rows = np.frombuffer(raw, np.uint8, count=stride * height).reshape(height, stride)[:, : width * each]
    rows = rows if upright else rows[::-1]
    if bits == 8:
        table = np.zeros((256, 4), np.uint8)
        given = np.frombuffer(palette[: len(palette) // 4 * 4], np.uint8).reshape(-1, 4)[:256] if palette else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
        table[: len(given)] = given
        return table[rows][:, :, :3].tobytes()
    return rows.tobytes()


def avi_frames(path: str, last: int | None = None) -> Iterator[tuple]:
    """Rows of one AVI file; frames up to ``last``."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        index, head, bits, kind, palette, upright, video = 0, None, 0, b"", b"", False, None
        streams = 0
        for name, at, n in _chunks(f, size):
            if name == b"avih":
                f.seek(at)
                v = struct.unpack("<14I", f.read(56))
                head = (v[4], 1e6 / v[0] if v[0] else 0.0, v[8], v[9])
            elif name == b"strh":
                f.seek(at)
                if f.read(4) == b"vids" and video is None:
                    video = streams
                streams += 1
            elif name == b"strf" and not bits and (video is None or video == streams - 1):
                f.seek(at)
                body = f.read(n)
                _, _, tall, _, bits, kind = struct.unpack("<IiiHH4s", body[:20])
                palette, upright = body[40:], tall < 0
            elif name[2:] in (b"db", b"dc") and head:
                coded = "jpeg" if kind.upper() == b"MJPG" else None
                if coded is None and (bits not in (8, 24) or kind != b"\0\0\0\0"):
                    yield (path, -1, *head, None, None, None, FAILED)
                    return
                if last is not None and index > last:
                    return
                f.seek(at)
                raw = f.read(n)
                if coded:
                    yield (path, index, *head, None, coded, raw if len(raw) == n and n else None, None)
                else:
                    yield (path, index, *head, 3, None, _raw(raw, head[2], head[3], bits, palette, upright), None)
                index += 1
        if head is None:
            yield _failed(path)
        elif index == 0:
            yield (path, -1, *head, None, None, None, None)


_BOXES = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def _boxes(f, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, position, size) of every box of a movie; containers are entered, and named before what they hold."""
    while f.tell() + 8 <= end:
        start = f.tell()
        size, name = struct.unpack(">I4s", f.read(8))
        at = start + 8
        if size == 1:
            size, at = struct.unpack(">Q", f.read(8))[0], at + 8
        stop = end if size == 0 else min(end, start + size)
        if stop < at:
            return
        yield name, at, stop - at
        if name in _BOXES:
            f.seek(at)
            yield from _boxes(f, stop)
        f.seek(stop)


def _table(body: bytes, kind: str, skip: int = 8) -> np.ndarray:
    count = struct.unpack(">I", body[skip - 4 : skip])[0]
    return np.frombuffer(body, kind, count=min(count, (len(body) - skip) // np.dtype(kind).itemsize), offset=skip)


def _places(track: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Position and size of each sample, from the tables of chunks and sizes."""
    fixed, count = struct.unpack(">II", track[b"stsz"][4:12])
    sizes = np.full(count, fixed, np.int64) if fixed else _table(track[b"stsz"], ">u4", 12).astype(np.int64)
    chunks = (_table(track[b"co64"], ">u8") if b"co64" in track else _table(track[b"stco"], ">u4")).astype(np.int64)
    rows = np.frombuffer(track[b"stsc"], ">u4", offset=8, count=(len(track[b"stsc"]) - 8) // 12 * 3).reshape(-1, 3).astype(np.int64)
    held = rows[np.searchsorted(rows[:, 0], np.arange(1, len(chunks) + 1), side="right") - 1, 1]
    chunk = np.repeat(np.arange(len(chunks)), held)[: len(sizes)]
    sizes = sizes[: len(chunk)]
    before = np.cumsum(sizes) - sizes
    first = np.concatenate([[0], np.cumsum(held)])[chunk]
    return chunks[chunk] + before - before[np.minimum(first, len(sizes) - 1)], sizes


def movie_frames(path: str, last: int | None = None) -> Iterator[tuple]:
    """Rows of one QuickTime or MP4 file; frames up to ``last``."""
    tracks: list[dict[bytes, bytes]] = []
    with open(path, "rb") as f:
        for name, at, n in _boxes(f, os.path.getsize(path)):
            if name == b"trak":
                tracks.append({})
            elif tracks and name in (b"hdlr", b"mdhd", b"stsd", b"stts", b"stsz", b"stsc", b"stco", b"co64"):
                f.seek(at)
                tracks[-1].setdefault(name, f.read(n))
        track = next((t for t in tracks if t.get(b"hdlr", b"")[8:12] == b"vide" and b"stsd" in t), None)
        if track is None:
            yield _failed(path)
            return
        codec = track[b"stsd"][12:16]
        width, height = struct.unpack(">HH", track[b"stsd"][40:44])
        mdhd = track[b"mdhd"]
        scale = struct.unpack(">I", mdhd[20:24] if mdhd[0] else mdhd[12:16])[0]
        times = np.frombuffer(track[b"stts"], ">u4", offset=8, count=(len(track[b"stts"]) - 8) // 8 * 2).reshape(-1, 2).astype(np.int64)
        count, ticks = int(times[:, 0].sum()), int((times[:, 0] * times[:, 1]).sum())
        head = (count, count * scale / ticks if ticks else 0.0, width, height)
        coded = {b"jpeg": "jpeg", b"mjpa": "jpeg", b"png ": "png"}.get(codec)
        if coded is None:
            yield (path, -1, *head, None, None, None, f"No decoder for {codec.decode('latin-1').strip()}")
            return
        for index, (at, n) in enumerate(zip(*_places(track), strict=True)):
            if last is not None and index > last:
                return
            f.seek(int(at))
            raw = f.read(int(n))
            yield (path, index, *head, None, coded, raw if len(raw) == n and n else None, None)
        if not count:
            yield (path, -1, *head, None, None, None, None)


def read_frames(path: str, last: int | None = None) -> Iterator[tuple]:
    """Rows of one file, by what it begins with."""
    try:
        with open(path, "rb") as f:
            start = f.read(12)
        if start[:4] == b"RIFF" and start[8:] == b"AVI ":
            yield from avi_frames(path, last)
        elif start[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
            yield from movie_frames(path, last)
        else:
            yield _failed(path)
    except (OSError, struct.error, ValueError, IndexError, KeyError):
        yield _failed(path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.last = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)) and f.attribute == ("frame_index",):
                cap = f.value - 1 if isinstance(f, LessThan) else f.value
                self.last = cap if self.last is None else min(self.last, cap)
            yield f  # Spark still applies it: rows below the cap may have to go

    def partitions(self):
        found: list[str] = []
        for path in self.paths:
            plain = re.sub("^file:/+", "/", path)
            if os.path.isdir(plain):
                found += sorted(p for p in glob.glob(f"{glob.escape(plain)}/**/*", recursive=True) if is_video_path(p))
            else:
                found += [plain] if os.path.exists(plain) else sorted(glob.glob(plain, recursive=True))
        return [_File(p) for p in found]

    def read(self, partition):
        if partition is not None:  # Spark reads one such partition where there is none
            yield from read_frames(partition.path, self.last)


class VideoFrameSource(DataSource):
    """``path`` (a file, a folder or a pattern) or ``paths`` (a JSON list of files)."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoFrameSource)


def _standard_tables(spark: SparkSession) -> bytes:
    """The segment of prefix codes that Motion JPEG leaves out of its frames, from the JVM's constants."""
    kind = spark._jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    body = b""
    for place, table in ((0x00, kind.StdDCLuminance), (0x10, kind.StdACLuminance), (0x01, kind.StdDCChrominance), (0x11, kind.StdACChrominance)):
        lengths, values = list(table.getLengths()), list(table.getValues())
        body += bytes([place]) + bytes(lengths + [0] * (16 - len(lengths))) + bytes(v & 255 for v in values)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


def decoded(coded: DataFrame) -> DataFrame:
    """(video_id, frame_index, image) of coded frames (video_id, frame_index, coded, data), by the JVM's decoders.

    The frames are written as still files to shared storage once; a frame that can't be decoded has the failure image.
    """
    spark = coded.sparkSession
    folder = shared_dir(spark, "coded-frames")
    tables = _standard_tables(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for v, i, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "jpeg" and b"\xff\xc4" not in data[: max(0, data.find(b"\xff\xda"))]:
                    data = data[:2] + tables + data[2:]
                with fs.open_output_stream(f"{root}/{v}_{i}.{'jpg' if kind == 'jpeg' else 'png'}") as f:  # the same bytes at every attempt
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    coded.select("video_id", "frame_index", "coded", "data").filter(F.col("data").isNotNull()).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    images = files.image_files(spark, folder)
    part = lambda n: F.regexp_extract("filename", r"(-?\d+)_(\d+)\.[a-z]+\z", n)
    return images.select(part(1).cast("long").alias("video_id"), part(2).cast("int").alias("frame_index"), "image")


def video_tables(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``videos`` (with ``error``) and ``frames`` of files, folders or patterns, from one source."""
    register(spark)
    source = spark.read.format("video_frames").option("paths", json.dumps([path] if isinstance(path, str) else list(path))).load()
    raw = source.withColumn("video_id", F.xxhash64("path"))
    videos = raw.filter(F.col("frame_index") <= 0).select("video_id", "path", "frame_count", "fps", "width", "height", "error")
    image = F.struct(F.col("path").alias("origin"), "height", "width", "nChannels", F.when(F.col("nChannels") == 1, 0).otherwise(16).alias("mode"), "data")
    frames = raw.filter((F.col("frame_index") >= 0) & F.col("coded").isNull()).select("video_id", "frame_index", image.cast(schemas.IMAGE_DDL).alias("image"))
    coded = raw.filter((F.col("frame_index") >= 0) & F.col("coded").isNotNull())
    if raw.filter("frame_index = 0").filter("coded is not null").limit(1).count():
        frames = frames.unionByName(decoded(coded.filter(F.col("frame_index") <= schemas.SCENE_LAST)))
    return videos, frames

