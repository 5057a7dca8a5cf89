"""Calls by file name for users who want dictionaries, not a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelloom import sinks
from pixelloom.functions.classify import is_image_path as is_image_file  # noqa: F401
from pixelloom.functions.classify import is_video_path as is_video_file  # noqa: F401
from pixelloom.operators import records
from pixelloom.scratch import shared_dir
from pixelloom.sources import files
from pixelloom.sources.video import video_tables


def _by_path(rows: list[dict], paths: Sequence[str], error: str) -> list[dict]:
    """One record an asked path, in that order, under the name it was asked by."""
    known = {os.path.abspath(r["filename"].split(":", 1)[-1] if r["filename"].startswith("file:") else r["filename"]): r for r in rows}
    return [{**known.get(os.path.abspath(p), {"error": error}), "filename": p} for p in paths]


def process_images(spark: SparkSession, paths: Sequence[str]) -> list[dict]:
    """The records of many files, from one job."""
    there = sorted({os.path.abspath(p) for p in paths if os.path.isfile(p) and is_image_file(p)})
    rows = list(sinks.records(records.process_images(files.image_files(spark, [files.literal(p) for p in there])))) if there else []
    return _by_path(rows, paths, "Failed to load image")


def process_videos(spark: SparkSession, paths: Sequence[str], stills: str | None = None) -> list[dict]:
    """The records of many files, from one source; with ``stills`` each first frame is saved in that folder."""
    there = sorted({os.path.abspath(p) for p in paths if os.path.isfile(p) and is_video_file(p)})
    if not there:
        return _by_path([], paths, "Failed to load video")
    videos, frames = video_tables(spark, there)
    saved = None
    if stills is not None:  # written once, however often the record's plan reads what was saved
        folder = shared_dir(spark, "stills") + "/table"
        sinks.save_first_frames(videos, frames, stills).write.parquet(folder)
        saved = spark.read.parquet(folder)
    return _by_path(list(sinks.records(records.process_videos(videos, frames, stills=saved).drop("video_id"))), paths, "Failed to load video")


def process_image(spark: SparkSession, filename: str) -> dict:
    return process_images(spark, [filename])[0]


def process_video(spark: SparkSession, filename: str, stills: str | None = None) -> dict:
    return process_videos(spark, [filename], stills)[0]


def extract_first_frame(spark: SparkSession, filename: str) -> dict | None:
    """The first frame of a video as an image struct (height, width, nChannels, data in B,G,R); None where there is none."""
    if not os.path.isfile(filename):
        return None
    _, frames = video_tables(spark, os.path.abspath(filename))
    row = frames.filter(F.col("frame_index") == 0).select("image").first()
    return None if row is None or row["image"]["data"] is None else row["image"].asDict()
