"""Record builders: one row of features per image or video file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import frames as V
from pixelloom.operators import images as I


def process_images(df: DataFrame, metrics: Iterable[str] = I.METRICS, **options) -> DataFrame:
    """``df`` has ``filename`` and ``image``.  A file that could not be decoded has ``error`` and null metrics."""
    metrics = list(metrics)
    image = options.get("image", "image")
    good = I.loaded(F.col(image))
    source = df.withColumn("error", F.when(~good, F.lit("Failed to load image")))
    out = I.image_metrics(source, metrics, **options)
    nulled = [F.when(F.col("error").isNull(), F.col(m)).alias(m) for m in metrics]
    return out.select(*(c for c in out.columns if c not in metrics), *nulled)


def process_videos(videos: DataFrame, frames: DataFrame, threshold: float = 30.0, *, stills: DataFrame | None = None, order: str = "bgr") -> DataFrame:
    """The full video record, from one pass over the frames.

    ``stills`` is what ``sinks.save_first_frames`` has written (video_id, saved, path); without it nothing is saved.
    """
    raw = V.summaries(frames, threshold=threshold)
    raw = raw.select([F.col(c).alias(f"_{c}") for c in raw.columns])
    record = V.frame_rate_stability(V.duration(videos)).join(raw, F.col("video_id") == F.col("_video_id"), "left")
    if stills is not None:
        own = stills.select(F.col("video_id").alias("_still"), F.col("saved").alias("_saved"), F.col("path").alias("_path"))
        record = record.join(own, F.col("video_id") == F.col("_still"), "left")
    else:
        record = record.withColumns({"_saved": F.lit(False), "_path": F.lit(None).cast("string")})
    first = V.first_frame_columns(F.col("_width"), F.col("_height"), F.col("_channels"), F.col("path"))
    columns = {
        "frame_count": F.col("frame_count"),
        "fps": F.col("fps"),
        "width": F.col("width"),
        "height": F.col("height"),
        "duration_seconds": F.col("duration_seconds"),
        "first_frame_extracted": first["first_frame_extracted"],
        "first_frame_info": first["first_frame_info"],
        "first_frame_saved": F.coalesce("_saved", F.lit(False)),
        "first_frame_path": F.when(F.col("_saved"), F.col("_path")),
        "average_brightness": F.coalesce("_brightness", F.lit(-1.0)),
        "is_grayscale": first["is_grayscale"],
        "motion_score": F.coalesce("_motion", F.lit(0.0)),
        "dominant_colors": V.color_lists(F.col("_colors"), order),
        "scene_changes": F.coalesce("_scenes", F.array().cast("array<int>")),
        "frame_rate_stability": F.col("frame_rate_stability"),
        "color_consistency": V.consistency(F.col("_mean"), F.col("_spread")),
    }
    said = F.col("error") if "error" in videos.columns else F.lit(None).cast("string")
    error = F.coalesce(said, F.when(F.col("frame_count") == -1, F.lit("Failed to load video")))
    bad = error.isNotNull()
    return record.select(
        "video_id",
        F.col("path").alias("filename"),
        error.alias("error"),
        *(F.when(~bad, c).alias(n) for n, c in columns.items()),
    )
