"""Per-image operators.

Every operator takes a DataFrame with an ``image`` struct and adds columns.  Shape metrics are plain Catalyst
expressions; pixel metrics come from one Arrow pass that decodes each payload once, computes only the statistics that
the asked metrics need and drops the payload, so nothing is shuffled and no pixels leave the map task.
A payload that could not be decoded (negative width, or null data) yields the failure value of each metric.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions import kernels, slices

STATS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("low", T.IntegerType()),
        T.StructField("high", T.IntegerType()),
        T.StructField("sat", T.LongType()),
        T.StructField("lap1", T.LongType()),
        T.StructField("lap2", T.LongType()),
        T.StructField("edges", T.IntegerType()),
        T.StructField("gray_hist", T.ArrayType(T.IntegerType())),
        T.StructField("hist", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("colors", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)
#: Which statistics each pixel metric is derived from.
NEEDS = {
    "average_brightness": {"total"},
    "contrast_ratio": {"low"},
    "saturation_level": {"sat"},
    "blur_score": {"lap"},
    "edge_count": {"edges"},
    "entropy": {"gray_hist"},
    "histogram": {"hist"},
    "dominant_colors": {"colors"},
}
SHAPE_METRICS = ("width", "height", "aspect_ratio", "is_grayscale", "channels")
METRICS = (*SHAPE_METRICS, *NEEDS)


def loaded(image: Column) -> Column:
    return F.coalesce((image["width"] >= 0) & image["data"].isNotNull(), F.lit(False))


def image_width(image: Column) -> Column:
    return F.when(loaded(image), image["width"]).otherwise(-1)


def image_height(image: Column) -> Column:
    return F.when(loaded(image), image["height"]).otherwise(-1)


def image_channels(image: Column) -> Column:
    return F.when(loaded(image), image["nChannels"]).otherwise(-1)


def image_is_grayscale(image: Column) -> Column:
    return loaded(image) & (image["nChannels"] == 1)


def image_aspect_ratio(image: Column) -> Column:
    """Width over height; 0.0 where nothing was decoded."""
    h = image_height(image)
    return F.when(h > 0, image_width(image).cast("double") / h).otherwise(0.0)


def _stats(image: dict | None, need: frozenset[str], k: int, low: int, high: int) -> dict | None:
    px = kernels.decoded(image)
    if px is None:
        return None
    out: dict = dict.fromkeys(f.name for f in STATS)
    out["n"] = px.shape[0] * px.shape[1]
    g = kernels.gray(px) if need & {"low", "lap", "edges", "gray_hist"} else None
    if "total" in need:
        out["total"] = int(px[:, :, :3].sum())
    if "low" in need:
        out["low"], out["high"] = int(g.min()), int(g.max())
    if "sat" in need and px.shape[2] >= 3:
        out["sat"] = kernels.saturation_sum(px)
    if "lap" in need:
        out["lap1"], out["lap2"] = kernels.laplacian_sums(g)
    if "edges" in need:
        out["edges"] = kernels.edge_count(g, low, high)
    if "gray_hist" in need:
        out["gray_hist"] = kernels.histogram(g[:, :, None])[0]
    if "hist" in need:
        out["hist"] = kernels.histogram(px)
    if "colors" in need:
        out["colors"] = [list(c) for c in kernels.dominant_colors(kernels.color_rows(px), k)]
    return out


def _scalar(name: str, k: int, order: str) -> Column:
    s, channels = F.col("_stats"), F.col("_channels")
    n = s["n"].cast("double")
    ok = s.isNotNull()
    if name == "average_brightness":
        return F.when(ok, s["total"] / (n * F.when(channels == 1, 1).otherwise(3))).otherwise(-1.0)
    if name == "contrast_ratio":
        return F.when(~ok, -1.0).when(s["high"] == 0, 0.0).otherwise(s["high"] / (s["low"] + F.lit(1e-6)))
    if name == "saturation_level":
        return F.when(s["sat"].isNotNull(), s["sat"] / n).otherwise(-1.0)
    if name == "blur_score":
        spread = n * s["lap2"] - s["lap1"].cast("double") * s["lap1"]
        return F.when(ok, spread / (n * n)).otherwise(-1.0)
    if name == "edge_count":
        return F.when(ok, s["edges"]).otherwise(-1)
    if name == "entropy":
        part = lambda a, c: a - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)
        return F.when(ok, F.aggregate(s["gray_hist"], F.lit(0.0), part)).otherwise(-1.0)
    if name == "histogram":
        return F.coalesce(s["hist"], F.array().cast("array<array<int>>"))
    slots = (1, 2, 3) if order == "bgr" else (3, 2, 1)
    colors = F.transform(s["colors"], lambda c: F.array(*(F.element_at(c, i) for i in slots)))
    return F.coalesce(colors, F.array().cast("array<array<double>>"))


def image_metrics(
    df: DataFrame,
    metrics: Iterable[str] = METRICS,
    *,
    image: str = "image",
    k: int = 3,
    edge_low: int = 100,
    edge_high: int = 200,
    order: str = "bgr",
) -> DataFrame:
    """Replace the image column by the named metrics; other columns pass through.

    Columns named like a metric are replaced by it.  Empty input gives an empty result with the same schema.
    """
    metrics = list(metrics)
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    img = F.col(f"`{image}`")
    shape = {
        "width": image_width(img),
        "height": image_height(img),
        "aspect_ratio": image_aspect_ratio(img),
        "is_grayscale": image_is_grayscale(img),
        "channels": image_channels(img),
    }
    kept = [F.col(f"`{c}`") for c in df.columns if c != image and c not in metrics]
    shape_columns = [shape[m].alias(m) for m in metrics if m in shape]
    need = frozenset().union(*(NEEDS.get(m, set()) for m in metrics))
    if not need:
        return df.select(*kept, *shape_columns)
    source = df.select(*kept, *shape_columns, img["nChannels"].alias("_channels"), img.alias("_image"))
    schema = T.StructType([f for f in source.schema if f.name != "_image"] + [T.StructField("_stats", STATS)])
    stats_type = pa.struct(
        [
            ("n", pa.int64()), ("total", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("sat", pa.int64()),
            ("lap1", pa.int64()), ("lap2", pa.int64()), ("edges", pa.int32()), ("gray_hist", pa.list_(pa.int32())),
            ("hist", pa.list_(pa.list_(pa.int32()))), ("colors", pa.list_(pa.list_(pa.float64()))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in slices.images(batches, last):
            stats = [_stats(x, need, k, edge_low, edge_high) for x in images]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stats, type=stats_type)], names=[*batch.schema.names[:-1], "_stats"])

    last = len(source.columns) - 1
    out = source.mapInArrow(run, schema)
    inherited = [F.col(f"`{f.name}`") for f in schema if f.name not in ("_stats", "_channels")]
    return out.select(*inherited, *(_scalar(m, k, order).alias(m) for m in metrics if m in NEEDS))


def _single(metric: str):
    def operator(df: DataFrame, **options) -> DataFrame:
        return image_metrics(df, [metric], **options)

    operator.__name__ = f"image_{metric}"
    operator.__doc__ = f"``image_metrics`` for the metric {metric} alone."
    return operator


average_brightness = _single("average_brightness")
edge_count = _single("edge_count")
dominant_colors = _single("dominant_colors")
blur_score = _single("blur_score")
contrast_ratio = _single("contrast_ratio")
saturation_level = _single("saturation_level")
histogram = _single("histogram")
entropy = _single("entropy")
aspect_ratio = _single("aspect_ratio")
channels = _single("channels")
is_grayscale = _single("is_grayscale")


def dimensions(df: DataFrame, **options) -> DataFrame:
    return image_metrics(df, ["width", "height"], **options)
