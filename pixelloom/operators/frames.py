"""Video operators over ``videos`` and ``frames``.

Every frame is read once: the map task reduces it to what the asked metrics need (mean level, one gray byte a pixel,
distinct colours with their counts and the pixels that can seed a cluster), and only frames under the highest cap of
those metrics are read at all (a plain filter, pushed into the source).  One shuffle by video brings the reduced
frames together in order; a partition streams them, keeps one gray plane and emits one row a video.  However long a
video is, no more than the cap is shuffled.

A frame without payload, or with fewer bytes than its size needs (a truncated file), counts for no metric.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.functions import kernels, slices
from pixelloom.functions.classify import first_frame_name

#: What can be asked for, and the last frame that it looks at.
LAST = {
    "brightness": schemas.BRIGHTNESS_LAST,
    "motion": schemas.MOTION_LAST,
    "scenes": schemas.SCENE_LAST,
    "consistency": schemas.CONSISTENCY_LAST,
    "colors": schemas.COLOR_LAST,
    "first": 0,
}
REDUCED = "video_id long, frame_index int, level double, plane binary, colors binary, counts binary, seeds array<struct<at:int,color:int>>, pixels int, width int, height int, channels int"
SUMMARY = "video_id long, brightness double, motion double, scenes array<int>, mean double, spread double, colors array<array<double>>, width int, height int, channels int"
_REDUCED = pa.schema(
    [
        ("video_id", pa.int64()), ("frame_index", pa.int32()), ("level", pa.float64()), ("plane", pa.binary()), ("colors", pa.binary()), ("counts", pa.binary()),
        ("seeds", pa.list_(pa.struct([("at", pa.int32()), ("color", pa.int32())]))), ("pixels", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()),
    ]
)
_SUMMARY = pa.schema(
    [
        ("video_id", pa.int64()), ("brightness", pa.float64()), ("motion", pa.float64()), ("scenes", pa.list_(pa.int32())), ("mean", pa.float64()), ("spread", pa.float64()),
        ("colors", pa.list_(pa.list_(pa.float64()))), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()),
    ]
)


def _level(px: np.ndarray) -> float:
    return float(px[:, :, :3].sum()) / (px.shape[0] * px.shape[1] * min(px.shape[2], 3))


def _seed_places(index: int, size: int, k: int) -> list[int]:
    """The pixels of the index-th frame that are at equal strides of 1, 2, ... frames of this size taken together."""
    every = (j * m * size // min(k, m * size) for m in range(index + 1, schemas.COLOR_LAST + 2) for j in range(min(k, m * size)))
    return sorted({at - index * size for at in every if at // size == index})


def reduced(frames: DataFrame, need: Iterable[str], k: int = 3) -> DataFrame:
    """The frames under the caps of what is needed, each as little more than those metrics take; map-only."""
    need = frozenset(need)
    caps = {n: LAST[n] for n in need}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in slices.images(batches, 2):
            rows = []
            for v, i, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), images, strict=True):
                px = kernels.decoded(image)
                row: list = [v, i, *[None] * 9]
                if px is not None:
                    if i <= max(caps.get("brightness", -1), caps.get("consistency", -1)):
                        row[2] = _level(px)
                    if i <= max(caps.get("motion", -1), caps.get("scenes", -1)):
                        row[3] = kernels.gray(px).tobytes()
                    row[7:] = [px.shape[0] * px.shape[1], px.shape[1], px.shape[0], px.shape[2]]
                    if i <= caps.get("colors", -1):
                        packed = kernels.packed_colors(kernels.color_rows(px))
                        values, counts = np.unique(packed, return_counts=True)
                        row[4], row[5] = values.astype("<i4").tobytes(), counts.astype("<i4").tobytes()
                        row[6] = [{"at": at, "color": int(packed[at])} for at in _seed_places(i, len(packed), k)]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _REDUCED, strict=True)], schema=_REDUCED)

    capped = frames.filter(F.col("frame_index").between(0, max(caps.values()))).select("video_id", "frame_index", "image")
    return capped.mapInArrow(run, REDUCED)


class _Video:
    """One video's frames as they come, in order."""

    def __init__(self, video: int | None, threshold: float, k: int):
        self.video, self.threshold, self.k = video, threshold, k
        self.levels: list[tuple[int, float]] = []
        self.changes: list[tuple[int, float]] = []
        self.before: np.ndarray | None = None
        self.colors: list[tuple] = []
        self.first: tuple = (None, None, None)

    def add(self, i: int, level, plane, colors, counts, seeds, pixels, *shape) -> None:
        if level is not None:
            self.levels.append((i, level))
        now = None if plane is None else np.frombuffer(plane, np.uint8).astype(np.int16)
        if i > 0 and now is not None and self.before is not None and len(now) == len(self.before):
            self.changes.append((i, int(np.abs(now - self.before).sum(dtype=np.int64)) / len(now)))
        self.before = now
        if colors is not None:
            self.colors.append((np.frombuffer(colors, "<i4"), np.frombuffer(counts, "<i4"), seeds, pixels))
        if i == 0:
            self.first = shape

    def _clusters(self) -> list[list[float]] | None:
        if not self.colors:
            return None
        total, k = sum(c[3] for c in self.colors), self.k
        seeds = []
        for j in range(min(k, total)):
            at = j * total // min(k, total)
            for _, _, places, pixels in self.colors:
                if at < pixels:
                    break
                at -= pixels
            # exactly there where the frames are of one size, as a video's are; else the nearest that was kept
            seeds.append(min(places, key=lambda s: abs(s["at"] - at))["color"] if places else 0)
        packed, weights = np.concatenate([c[0] for c in self.colors]).astype(np.int64), np.concatenate([c[1] for c in self.colors])
        values, at = np.unique(packed, return_inverse=True)
        return [list(c) for c in kernels.clusters(values, np.bincount(at, weights=weights), np.array(seeds, dtype=np.int64))]

    def row(self) -> tuple:
        mean = lambda x: sum(x) / len(x) if x else None
        steady = [x for i, x in self.levels if i <= schemas.CONSISTENCY_LAST]
        return (
            self.video,
            mean([x for i, x in self.levels if i <= schemas.BRIGHTNESS_LAST]),
            mean([x for i, x in self.changes if i <= schemas.MOTION_LAST]),
            [i for i, x in self.changes if x > self.threshold],
            mean(steady),
            float(np.std(steady)) if steady else None,
            self._clusters(),
            *self.first,
        )


def summaries(frames: DataFrame, need: Iterable[str] = LAST, threshold: float = 30.0, k: int = 3) -> DataFrame:
    """One row a video that has frames: the raw values of the needed metrics, null for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video: _Video | None = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if video is None or video.video != row[0]:
                    if video is not None:
                        done.append(video.row())
                    video = _Video(row[0], threshold, k)
                video.add(*row[1:])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)
        if video is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(video.row(), _SUMMARY, strict=True)], schema=_SUMMARY)

    ordered = reduced(frames, need, k).repartition("video_id").sortWithinPartitions("video_id", "frame_index")
    return ordered.mapInArrow(run, SUMMARY)


def consistency(mean: Column, spread: Column) -> Column:
    return F.when(mean.isNull(), -1.0).when(mean <= 0, 0.0).otherwise(spread / mean)


def color_lists(colors: Column, order: str = "bgr") -> Column:
    """Centres without their sizes, in the asked order of channels; [] where there are none."""
    slots = (1, 2, 3) if order == "bgr" else (3, 2, 1)
    return F.coalesce(F.transform(colors, lambda c: F.array(*(F.element_at(c, i) for i in slots))), F.array().cast("array<array<double>>"))


def _with(videos: DataFrame, frames: DataFrame, need: str, **options) -> DataFrame:
    """The videos with the raw values of one metric; ``_`` keeps them apart from the videos' columns."""
    raw = summaries(frames, [need], **options)
    raw = raw.select([F.col(c).alias(f"_{c}") for c in raw.columns])
    return videos.join(raw, F.col("video_id") == F.col("_video_id"), "left")


def video_brightness(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Unweighted mean of frame brightness; -1.0 for a video without frames."""
    return _with(videos, frames, "brightness").select("video_id", F.coalesce("_brightness", F.lit(-1.0)).alias("average_brightness"))


def video_motion_score(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean absolute gray difference over the first differences; 0.0 where there is none."""
    return _with(videos, frames, "motion").select("video_id", F.coalesce("_motion", F.lit(0.0)).alias("motion_score"))


def video_scene_changes(videos: DataFrame, frames: DataFrame, threshold: float = 30.0) -> DataFrame:
    """Ascending indices of frames that differ from the one before by more than the threshold; [] where none does."""
    return _with(videos, frames, "scenes", threshold=threshold).select("video_id", F.coalesce("_scenes", F.array().cast("array<int>")).alias("scene_changes"))


def video_color_consistency(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Coefficient of variation (population) of frame brightness: lower is steadier; -1.0 without frames."""
    return _with(videos, frames, "consistency").select("video_id", consistency(F.col("_mean"), F.col("_spread")).alias("color_consistency"))


def video_dominant_colors(videos: DataFrame, frames: DataFrame, k: int = 3, order: str = "bgr") -> DataFrame:
    """Clusters of the pixels of the first ten frames together."""
    return _with(videos, frames, "colors", k=k).select("video_id", color_lists(F.col("_colors"), order).alias("dominant_colors"))


def first_frames(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """video_id, path and the first frame itself as ``image``; null where there is none or it has no payload."""
    image = F.col("image")
    good = (image["width"] > 0) & (image["height"] > 0) & (image["nChannels"] > 0) & (F.length(image["data"]) >= image["width"].cast("long") * image["height"] * image["nChannels"])
    first = frames.filter(F.col("frame_index") == 0).select("video_id", F.when(good, image).alias("image"))
    return videos.select("video_id", "path").join(first, "video_id", "left")


def first_frame_columns(width: Column, height: Column, channels: Column, path: Column) -> dict[str, Column]:
    there = width.isNotNull()
    info = F.when(there, F.struct(width.alias("width"), height.alias("height"), channels.alias("channels")))
    return {
        "first_frame_extracted": there,
        "first_frame_info": info,
        "is_grayscale": F.coalesce(channels == 1, F.lit(True)),  # a video without frames counts as gray
        "first_frame_path": F.when(there, first_frame_name(path)),
    }


def video_first_frame(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Whether there is a first frame, its shape, and whether the video counts as gray."""
    image = F.col("image")
    columns = first_frame_columns(image["width"], image["height"], image["nChannels"], F.col("path"))
    return first_frames(videos, frames).select("video_id", *(c.alias(n) for n, c in columns.items()))


def duration(videos: DataFrame) -> DataFrame:
    fps = F.col("fps")
    return videos.withColumn("duration_seconds", F.when((fps > 0) & (F.col("frame_count") >= 0), F.col("frame_count") / fps).otherwise(-1.0))


def frame_rate_stability(videos: DataFrame) -> DataFrame:
    """0.0 for any positive frame rate (timestamps are not looked at), else -1.0."""
    return videos.withColumn("frame_rate_stability", F.when(F.col("fps") > 0, 0.0).otherwise(-1.0))
