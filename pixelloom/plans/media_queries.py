"""Registered queries over the media views.  Doubles are rounded so that two engines agree to the last digit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import media_kind
from pixelloom.functions.classify import first_frame_name, is_image_file, is_video_file
from pixelloom.operators import frames as V
from pixelloom.operators import images as I
from pixelloom.operators import recipes, records
from pixelloom.plans import file_queries, views

Query = Callable[[SparkSession, str], DataFrame]


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def file_router(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return views.files(spark, d).select("path", is_image_file(p).alias("is_image"), is_video_file(p).alias("is_video"), media_kind(p).alias("kind"), first_frame_name(p).alias("still"))


def file_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).groupBy(media_kind(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def image_shape(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions, aspect ratio, channels and gray flag, failure values included."""
    out = I.image_metrics(views.gray_images(spark, d, corrupt=True), I.SHAPE_METRICS)
    return out.select("image_id", "width", "height", "aspect_ratio", "channels", "is_grayscale")


def image_brightness_gray(spark: SparkSession, d: str) -> DataFrame:
    return I.average_brightness(views.gray_images(spark, d, corrupt=True)).select("image_id", _r("average_brightness"))


def _color(metric: str, digits: int = 6) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return I.image_metrics(views.color_images(spark, d), [metric]).select("image_id", _r(metric, digits))

    return query


def image_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = I.histogram(views.color_images(spark, d))
    long = h.select("image_id", F.posexplode("histogram").alias("channel", "bins")).select("image_id", "channel", F.posexplode("bins").alias("bin", "n"))
    return long.select("image_id", "channel", "bin", F.col("n").cast("long").alias("n"))


def image_blur_gray(spark: SparkSession, d: str) -> DataFrame:
    return I.blur_score(views.gray_images(spark, d)).select("image_id", _r("blur_score", 4))


def image_edges_gray(spark: SparkSession, d: str) -> DataFrame:
    return I.edge_count(views.gray_images(spark, d)).select("image_id", F.col("edge_count").cast("long").alias("edge_count"))


def _centres(df: DataFrame, key: str) -> DataFrame:
    long = df.select(key, F.posexplode("dominant_colors").alias("k", "c"))
    return long.select(key, "k", *(F.round(F.element_at("c", i + 1), 4).alias(n) for i, n in enumerate("bgr")))


def image_dominant_colors(spark: SparkSession, d: str) -> DataFrame:
    return _centres(I.dominant_colors(views.color_images(spark, d)), "image_id")


def image_dominant_colors_k5(spark: SparkSession, d: str) -> DataFrame:
    return _centres(I.dominant_colors(views.color_images(spark, d), k=5), "image_id")


def image_features(spark: SparkSession, d: str) -> DataFrame:
    """The flat image record (list columns left out) of gray images, failures included."""
    metrics = ["width", "height", "aspect_ratio", "is_grayscale", "average_brightness", "channels", "blur_score", "contrast_ratio", "entropy"]
    out = records.process_images(views.gray_images(spark, d, corrupt=True), metrics)
    return out.select("image_id", "filename", "error", "width", "height", _r("aspect_ratio"), "is_grayscale", _r("average_brightness"), "channels", _r("blur_score", 4), _r("contrast_ratio", 4), _r("entropy"))


def video_metadata(spark: SparkSession, d: str) -> DataFrame:
    v = V.frame_rate_stability(V.duration(views.videos(spark, d)))
    return v.select("video_id", "frame_count", "fps", "width", "height", _r("duration_seconds"), "frame_rate_stability")


def _video(operator, column: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return operator(views.videos(spark, d), views.all_frames(spark, d)).select("video_id", _r(column))

    return query


def video_scene_changes(spark: SparkSession, d: str) -> DataFrame:
    s = V.video_scene_changes(views.videos(spark, d), views.all_frames(spark, d))
    return s.select("video_id", F.explode_outer("scene_changes").alias("frame_index"))


def video_dominant_colors(spark: SparkSession, d: str) -> DataFrame:
    return _centres(V.video_dominant_colors(views.videos(spark, d), views.all_frames(spark, d)), "video_id")


def video_first_frame(spark: SparkSession, d: str) -> DataFrame:
    f = V.video_first_frame(views.videos(spark, d), views.all_frames(spark, d))
    info = F.col("first_frame_info")
    return f.select("video_id", "first_frame_extracted", info["width"].alias("width"), info["height"].alias("height"), info["channels"].alias("channels"), "is_grayscale", "first_frame_path")


def video_features(spark: SparkSession, d: str) -> DataFrame:
    r = records.process_videos(views.videos(spark, d), views.all_frames(spark, d))
    return r.select(
        "video_id", "filename", "error", "frame_count", "fps", "width", "height", _r("duration_seconds"), "first_frame_extracted",
        _r("average_brightness"), "is_grayscale", _r("motion_score"), F.size("scene_changes").alias("n_scenes"),
        F.size("dominant_colors").alias("n_colors"), "frame_rate_stability", _r("color_consistency"),
    )


def _features(spark: SparkSession, d: str) -> DataFrame:
    return records.process_images(views.gray_images(spark, d), ["average_brightness", "blur_score", "edge_count"])


def qc_report(spark: SparkSession, d: str) -> DataFrame:
    return recipes.quality_report(_features(spark, d), blur=2000.0, bright=135.0, dark=120.0).select("image_id", "qc")


def motion_activity(spark: SparkSession, d: str) -> DataFrame:
    m = V.video_motion_score(views.videos(spark, d), views.all_frames(spark, d))
    return recipes.motion_activity(m).select("video_id", "activity")


def ml_features_scaled(spark: SparkSession, d: str) -> DataFrame:
    names = ["average_brightness", "edge_count", "blur_score"]
    out = recipes.label_from_directory(recipes.standardised(_features(spark, d), names))
    return out.select("image_id", "label", *(F.round(f"{n}_scaled", 4).alias(f"{n}_scaled") for n in names))


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return recipes.batch_summary(_features(spark, d)).select("filename", _r("average_brightness"), _r("blur_score", 4))


def queries() -> dict[str, Query]:
    return {
        "file_router": file_router,
        "file_kind_counts": file_kind_counts,
        "image_shape": image_shape,
        "image_brightness_gray": image_brightness_gray,
        "image_brightness_bgr": _color("average_brightness"),
        "image_contrast_ratio": _color("contrast_ratio"),
        "image_saturation": _color("saturation_level"),
        "image_histogram": image_histogram,
        "image_entropy": _color("entropy"),
        "image_blur_score": _color("blur_score", 4),
        "image_blur_gray": image_blur_gray,
        "image_edge_count": image_edges_gray,
        "image_dominant_colors": image_dominant_colors,
        "image_dominant_colors_k5": image_dominant_colors_k5,
        "image_features": image_features,
        "video_metadata": video_metadata,
        "video_brightness": _video(V.video_brightness, "average_brightness"),
        "video_motion_score": _video(V.video_motion_score, "motion_score"),
        "video_scene_changes": video_scene_changes,
        "video_color_consistency": _video(V.video_color_consistency, "color_consistency"),
        "video_dominant_colors": video_dominant_colors,
        "video_first_frame": video_first_frame,
        "video_features": video_features,
        "qc_report": qc_report,
        "motion_activity": motion_activity,
        "ml_features_scaled": ml_features_scaled,
        "batch_summary": batch_summary,
        **file_queries.queries(),
    }
