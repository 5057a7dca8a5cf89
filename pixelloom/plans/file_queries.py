"""Registered queries over real files: the media views are written as files to shared storage and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom import scratch, sinks
from pixelloom.operators import images as I
from pixelloom.operators import records
from pixelloom.plans import views
from pixelloom.sources import frame_directories, image_files, media_files, video_tables
from pixelloom.sources.files import existing
from pixelloom.streaming import stream_image_features


def _id():
    return F.regexp_extract("filename", r"g(\d+)\.[a-z]+\z", 1).cast("long").alias("image_id")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _image_folder(spark: SparkSession, d: str) -> str:
    """The wide images as PNG and WebP files."""
    folder = scratch.shared_dir(spark, "image-files")
    sinks.write_images(views.wide_images(spark, d), folder).agg(F.count(F.lit(1))).collect()
    return folder


def file_image_features(spark: SparkSession, d: str) -> DataFrame:
    """Records of image files in two formats, of images that aren't square."""
    metrics = ["width", "height", "aspect_ratio", "channels", "is_grayscale", "average_brightness", "blur_score", "contrast_ratio", "entropy", "edge_count"]
    out = records.process_images(image_files(spark, _image_folder(spark, d)), metrics)
    return out.select(_id(), "error", "width", "height", _r("aspect_ratio"), "channels", "is_grayscale", _r("average_brightness"), _r("blur_score", 4), _r("contrast_ratio", 4), _r("entropy"), F.col("edge_count").cast("long").alias("edge_count"))


def file_image_native(spark: SparkSession, d: str) -> DataFrame:
    """Channels as the files have them."""
    out = I.image_metrics(image_files(spark, _image_folder(spark, d), decode="native"), ["channels", "is_grayscale"])
    return out.groupBy(F.regexp_extract("filename", r"([a-z]+)\z", 1).alias("format"), "channels", "is_grayscale").agg(F.count(F.lit(1)).alias("n"))


def file_folder(spark: SparkSession, d: str) -> DataFrame:
    """What a folder holds, by the router."""
    files = media_files(spark, _image_folder(spark, d))
    return files.groupBy("kind", F.regexp_extract("path", r"([a-z]+)\z", 1).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def _video_folder(spark: SparkSession, d: str) -> str:
    folder = scratch.shared_dir(spark, "video-files")
    sinks.write_avi(views.videos(spark, d), views.all_frames(spark, d), folder).agg(F.count(F.lit(1))).collect()
    return folder


def file_video_features(spark: SparkSession, d: str) -> DataFrame:
    """Records of video files; their first frames are saved as JPEG files of the record's name."""
    folder = _video_folder(spark, d)
    videos, frames = video_tables(spark, folder)
    stills = scratch.shared_dir(spark, "stills")
    sinks.save_first_frames(videos, frames, stills.removeprefix("file:")).write.parquet(f"{stills}/table")
    r = records.process_videos(videos, frames, stills=spark.read.parquet(f"{stills}/table"))
    name = lambda c: F.regexp_extract(c, r"([^/]*)\z", 1)
    return r.select(
        name("filename").alias("filename"), "error", "frame_count", "fps", "width", "height", _r("duration_seconds"), "first_frame_extracted", "first_frame_saved",
        name("first_frame_path").alias("first_frame_path"), _r("average_brightness"), "is_grayscale", _r("motion_score"), F.size("scene_changes").alias("n_scenes"),
        F.size("dominant_colors").alias("n_colors"), "frame_rate_stability", _r("color_consistency"),
    )


def file_video_colors(spark: SparkSession, d: str) -> DataFrame:
    """Dominant colours of video files, centre by centre."""
    videos, frames = video_tables(spark, _video_folder(spark, d))
    long = records.process_videos(videos, frames).select(F.regexp_extract("filename", r"(\d+)\.avi\z", 1).cast("long").alias("video_id"), F.posexplode("dominant_colors").alias("k", "c"))
    return long.select("video_id", "k", *(F.round(F.element_at("c", i + 1), 4).alias(n) for i, n in enumerate("bgr")))


def file_report(spark: SparkSession, d: str) -> DataFrame:
    """The JSON report of the image files, read back."""
    folder = scratch.shared_dir(spark, "report")
    out = records.process_images(image_files(spark, _image_folder(spark, d)), ["width", "height", "average_brightness"])
    sinks.write_report(f"{folder.removeprefix('file:')}/report.json", out, None)
    schema = "images array<struct<filename:string,width:long,height:long,average_brightness:double,error:string>>, videos array<string>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/report.json").select(F.explode("images").alias("r"), F.size("videos").alias("videos"))
    return rows.select("r.filename", "videos", "r.width", "r.height", "r.average_brightness", "r.error").select(_id(), "videos", "width", "height", _r("average_brightness"), "error")


def file_stream_features(spark: SparkSession, d: str) -> DataFrame:
    """The image files as a stream of newly arriving files, processed until there are no more."""
    out = scratch.shared_dir(spark, "stream")
    stream_image_features(spark, _image_folder(spark, d), f"{out}/rows", f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(_id(), "width", "height", _r("average_brightness"), _r("blur_score", 4), "error")


def file_frame_folders(spark: SparkSession, d: str) -> DataFrame:
    """Frames as stills in a folder a video."""
    folder = scratch.shared_dir(spark, "frame-folders")
    frames = views.gray_frames(spark, d)
    name = F.concat(F.lit("v"), F.col("video_id").cast("string"), F.lit("/"), F.col("frame_index").cast("string"), F.lit(".png"))
    sinks.write_images(frames.withColumn("name", name), folder).agg(F.count(F.lit(1))).collect()
    found = I.average_brightness(frame_directories(spark, folder))
    return found.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("folder"), "frame_index", _r("average_brightness"))


def file_existence(spark: SparkSession, d: str) -> DataFrame:
    """Which paths of a table exist."""
    folder = _image_folder(spark, d)
    i = F.col("image_id")
    asked = views.wide_images(spark, d).select("image_id", F.concat(F.lit(folder + "/"), F.when(i % 5 == 0, F.concat(F.lit("gone-"), "name")).otherwise(F.col("name"))).alias("path"))
    return existing(asked).select("image_id", "exists")


def queries() -> dict:
    found = (
        file_image_features, file_image_native, file_folder, file_video_features, file_video_colors, file_report, file_stream_features, file_frame_folders, file_existence,
    )
    return {f.__name__: f for f in found}
