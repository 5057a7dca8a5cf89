"""Report and still-image sinks."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import jpeg, kernels, slices, webp
from pixelloom.functions.classify import first_frame_name
from pixelloom.operators.frames import first_frames
from pixelloom.scratch import filesystem


def _clean(x):
    """Absent keys instead of nulls, as plain Python values."""
    if hasattr(x, "asDict"):
        x = x.asDict(recursive=True)
    return {k: _clean(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else x


def records(df: DataFrame) -> Iterator[dict]:
    return (_clean(r) for r in df.toLocalIterator())


def write_report(path: str, images: DataFrame | None, videos: DataFrame | None) -> None:
    """One pretty JSON document with both lists; rows come to the driver one partition at a time.

    Made for reports that people read; use ``df.write`` for a dataset.
    """
    with open(path, "w") as f:
        f.write("{\n")
        for i, (name, df) in enumerate((("images", images), ("videos", videos))):
            f.write(f'  "{name}": [')
            first = True
            for r in records(df) if df is not None else ():
                body = json.dumps(r, indent=2, sort_keys=True).replace("\n", "\n    ")
                f.write(("" if first else ",") + "\n    " + body)
                first = False
            f.write(("" if first else "\n  ") + "]" + ("," if i == 0 else "") + "\n")
        f.write("}\n")


def png(data: bytes, width: int, height: int, channels: int) -> bytes:
    """B,G,R or gray samples as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    step = width * channels
    rows = []
    for y in range(height):
        row = bytearray(data[y * step : (y + 1) * step])
        if channels >= 3:
            row[0::channels], row[2::channels] = row[2::channels], row[0::channels]
        rows.append(b"\0" + bytes(row))
    color = {1: 0, 3: 2, 4: 6}[channels]
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def _encoded(kind: str, image: dict, px: np.ndarray) -> bytes:
    if kind == "jpg":
        return jpeg.encode(px)
    if kind == "png":
        return png(image["data"], image["width"], image["height"], image["nChannels"])
    if px.shape[2] > 1 and (px[:, :, :3] != px[:, :, :1]).any():
        raise ValueError("WebP stills are written from gray images")
    return webp.encode_gray([px[:, :, 0]])[0]


def write_images(images: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Write each ``image`` under its name, whose extension (png, jpg, webp) is the format; (name, saved) of every row.

    A task writes what it reads, so nothing is shuffled; a payload that is no image is not saved.  Names must not repeat, and
    may have folders in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        made: set[str] = set()
        for b, found in slices.images(batches, 1):
            saved = []
            for n, image in zip(b.column(0).to_pylist(), found, strict=True):
                px = kernels.decoded(image)
                if px is not None:
                    below = n.rpartition("/")[0]
                    if below and below not in made:
                        fs.create_dir(f"{root}/{below}", recursive=True)
                        made.add(below)
                    with fs.open_output_stream(f"{root}/{n}") as f:
                        f.write(_encoded(n.rsplit(".", 1)[-1].lower(), image, px))
                saved.append(px is not None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(saved, pa.bool_())], names=["name", "saved"])

    return images.select(F.col(name).alias("name"), "image").mapInArrow(run, "name string, saved boolean")


def _avi_head(n: int, stored: int, width: int, height: int, fps: float) -> bytes:
    """Everything of an AVI file before its frames: n of them, of which ``stored`` have a payload."""
    frame = (width * 3 + 3) // 4 * 4 * height
    movi = 4 + 8 * n + stored * (frame + (frame & 1))
    part = lambda kind, name, body: kind + struct.pack("<I", len(body) + 4) + name + body if name else kind + struct.pack("<I", len(body)) + body
    avih = part(b"avih", b"", struct.pack("<14I", round(1e6 / fps) if fps > 0 else 0, 0, 0, 0, n, 0, 1, 0, width, height, 0, 0, 0, 0))
    strh = part(b"strh", b"", b"vids" + bytes(52))
    strf = part(b"strf", b"", struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, bytes(4), frame, 0, 0, 0, 0))
    hdrl = part(b"LIST", b"hdrl", avih + part(b"LIST", b"strl", strh + strf))
    return b"RIFF" + struct.pack("<I", 4 + len(hdrl) + 8 + movi) + b"AVI " + hdrl + b"LIST" + struct.pack("<I", movi) + b"movi"


def _avi_frame(px: np.ndarray | None) -> bytes:
    if px is None:
        return b"00db" + bytes(4)
    rows = np.repeat(px, 3, axis=2) if px.shape[2] < 3 else px[:, :, :3]
    body = np.pad(rows[::-1].reshape(len(rows), -1), ((0, 0), (0, -3 * px.shape[1] % 4))).tobytes()
    return b"00db" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)


def write_avi(videos: DataFrame, frames: DataFrame, folder: str) -> DataFrame:
    """Write each video that has frames as ``<video_id>.avi`` with raw frames of 24 bits; (video_id, frames) of each file.

    One shuffle by video; a partition streams its frames in order into one file after another.  Frames without a payload, or
    of another size than the video's, become dropped frames.  A file holds at most 4 GB.
    """
    image, wide, high = F.col("image"), F.col("_w"), F.col("_h")
    need = image["width"].cast("long") * image["height"] * image["nChannels"]
    good = F.coalesce((image["width"] == wide) & (image["height"] == high) & (image["nChannels"] > 0) & (F.length(image["data"]) >= need), F.lit(False))
    shape = videos.select("video_id", "fps", F.col("width").alias("_w"), F.col("height").alias("_h"))
    every = frames.join(shape, "video_id").select("video_id", "frame_index", F.when(good, image).alias("image"), "fps", "_w", "_h")
    totals = every.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), F.count("image").alias("_stored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        video, out = None, None
        done: list[tuple[int, int]] = []
        for b, found in slices.images(batches, 2):
            for row, picture in zip(zip(*(c.to_pylist() for i, c in enumerate(b.columns) if i != 2), strict=True), found, strict=True):
                v, _, fps, w, h, n, stored = row
                if v != video:
                    if out is not None:
                        out.close()
                    video, out = v, fs.open_output_stream(f"{root}/{v}.avi")  # a repeated attempt writes the same bytes
                    out.write(_avi_head(n, stored, w, h, fps))
                    done.append((v, n))
                out.write(_avi_frame(kernels.decoded(picture)))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], names=["video_id", "frames"])

    ordered = every.join(totals, "video_id").repartition("video_id").sortWithinPartitions("video_id", "frame_index")
    return ordered.mapInArrow(run, "video_id long, frames long")


def save_first_frames(videos: DataFrame, frames: DataFrame, folder: str, *, unique: bool = False, kind: str = "jpg") -> DataFrame:
    """Write the first frame of each video as ``<stem>_first_frame.jpg`` (or ``.png``) on shared storage.

    Returns (video_id, saved, path), one row a video.  ``unique`` puts the id before the stem, which keeps videos of equal
    stems apart; without it the last one written stays.  A frame that can't be written gives saved = false.
    """
    if kind not in ("jpg", "png"):
        raise ValueError("kind must be jpg or png")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, images in slices.images(batches, 2):
            out = []
            for v, name, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), images, strict=True):
                px = kernels.decoded(image)
                path, ok = os.path.join(folder, f"{v}_{name}" if unique else name), px is not None
                if ok:
                    part = f"{path}.{os.getpid()}"
                    try:
                        with open(part, "wb") as f:
                            f.write(_encoded(kind, image, px))
                        os.replace(part, path)  # a repeated attempt writes the same bytes
                    except OSError:
                        ok = False
                out.append((v, ok, path if ok else None))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())], names=["video_id", "saved", "path"])

    name = F.regexp_replace(first_frame_name(F.col("path")), r"jpg\z", kind)
    named = first_frames(videos, frames).select("video_id", name.alias("name"), "image")
    return named.mapInArrow(run, "video_id long, saved boolean, path string")
