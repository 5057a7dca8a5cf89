"""Media views over plain relational tables.

The test tables hold no media, so embeddings and events are read as small images and videos through a fixed
quantiser.  Each view is a deterministic projection that any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom import schemas

# Quantiser range and the side of the square images.
SIDE = 8
#: Width and height of the images that aren't square.
WIDE = (16, 4)
QUANT = "CAST(least(255, greatest(0, floor((CAST({v} AS DOUBLE)+0.6e0)/1.2e0*256))) AS INT)"
#: Suffixes given to generated paths, by part key modulo their number.
SUFFIXES = (".jpg", ".JPG", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".gif", ".webp", ".mp4", ".avi", ".mov", ".mkv", ".WMV", ".flv", ".webm", ".m4v", "", ".txt", ".jpg?x=1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(px: Column) -> Column:
    """array<int> of 0..255 to binary, inside codegen-free but JVM-side expressions."""
    return F.unhex(F.array_join(F.transform(px, lambda p: F.lpad(F.hex(p), 2, "0")), ""))


def _image(px: Column, channels: int, mode: int, origin: Column) -> Column:
    return F.struct(
        origin.alias("origin"),
        F.when(px.isNotNull(), SIDE).otherwise(-1).cast("int").alias("height"),
        F.when(px.isNotNull(), SIDE).otherwise(-1).cast("int").alias("width"),
        F.when(px.isNotNull(), channels).otherwise(-1).cast("int").alias("nChannels"),
        F.when(px.isNotNull(), mode).otherwise(-1).cast("int").alias("mode"),
        _bytes(px).alias("data"),
    ).cast(schemas.IMAGE_DDL)


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.expr(f"transform(embedding, v -> {QUANT.format(v='v')})").alias("px"))


def gray_images(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """One 8x8 gray image per vector; with ``corrupt``, one in fifty has no payload."""
    px = F.when(F.col("vec_id") % 50 != 49, F.col("px")) if corrupt else F.col("px")
    name = F.concat(F.lit("/media/gray/"), (F.col("vec_id") % 7).cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png"))
    return quantised(spark, sf_dir).select(F.col("vec_id").alias("image_id"), name.alias("filename"), _image(px, 1, 0, name).alias("image"))


def wide_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gray images as 16 by 4 pixels, named by format: every third is WebP, the others are PNG."""
    px, i = F.col("px"), F.col("vec_id")
    name = F.concat(F.lit("g"), i.cast("string"), F.when(i % 3 == 0, ".webp").otherwise(".png"))
    image = F.struct(name.alias("origin"), F.lit(WIDE[1]).alias("height"), F.lit(WIDE[0]).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), _bytes(px).alias("data"))
    return quantised(spark, sf_dir).select(i.alias("image_id"), name.alias("name"), image.cast(schemas.IMAGE_DDL).alias("image"))


def color_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 B,G,R image per three consecutive vectors; an incomplete last triple is left out."""
    q = quantised(spark, sf_dir)
    plane = lambda c: F.max(F.when(F.col("vec_id") % 3 == c, F.col("px")))
    g = q.groupBy(F.expr("vec_id div 3").alias("image_id")).agg(plane(0).alias("b"), plane(1).alias("g"), plane(2).alias("r"))
    g = g.filter(F.col("b").isNotNull() & F.col("g").isNotNull() & F.col("r").isNotNull())
    px = F.flatten(F.zip_with(F.arrays_zip("b", "g"), F.col("r"), lambda bg, r: F.array(bg["b"], bg["g"], r)))
    name = F.concat(F.lit("/media/color/"), (F.col("image_id") % 7).cast("string"), F.lit("/"), F.col("image_id").cast("string"), F.lit(".png"))
    return g.select("image_id", name.alias("filename"), _image(px, 3, 16, name).alias("image"))


def gray_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gray videos: even and odd vectors."""
    g = gray_images(spark, sf_dir)
    return g.select((F.col("image_id") % 2).alias("video_id"), F.expr("CAST(image_id div 2 AS INT)").alias("frame_index"), "image")


def color_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color_images(spark, sf_dir).select(F.lit(10).cast("long").alias("video_id"), F.col("image_id").cast("int").alias("frame_index"), "image")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One video of 1x1 frames, long enough to cross every cap."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr("CAST(least(255, greatest(0, floor(value))) AS INT)").alias("g"))
    image = F.struct(
        F.lit(None).cast("string").alias("origin"),
        F.lit(1).alias("height"), F.lit(1).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"),
        F.unhex(F.lpad(F.hex("g"), 2, "0")).alias("data"),
    ).cast(schemas.IMAGE_DDL)
    return e.select(F.lit(20).cast("long").alias("video_id"), F.col("event_id").cast("int").alias("frame_index"), image.alias("image"))


def all_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_frames(spark, sf_dir).unionByName(color_frames(spark, sf_dir)).unionByName(event_frames(spark, sf_dir))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the videos above, one empty one (30) and one that can't be opened (40)."""
    counted = all_frames(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("frame_count"))
    more = spark.createDataFrame([(30, 0), (40, -1)], "video_id long, frame_count int")
    v = counted.unionByName(more)
    side = F.when(F.col("video_id") == 20, 1).otherwise(SIDE)
    return v.select(
        "video_id",
        F.concat(F.lit("/media/clips/v"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("path"),
        "frame_count",
        F.when(F.col("frame_count") == -1, -1.0).when(F.col("video_id") % 20 == 1, 0.0).otherwise(25.0).alias("fps"),
        F.when(F.col("frame_count") == -1, -1).otherwise(side).alias("width"),
        F.when(F.col("frame_count") == -1, -1).otherwise(side).alias("height"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    path = F.concat(F.lit("/media/"), "p_brand", F.lit("/"), "p_name", F.lit("_"), F.col("p_partkey").cast("string"), ext)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
