"""Media files as DataFrames, over Spark's own readers (partitioned by file, also usable as streams)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.streaming import DataStreamReader

from pixelloom import schemas
from pixelloom.functions import slices, webp
from pixelloom.functions.classify import IMAGE_EXTENSIONS, is_image_path, media_kind
from pixelloom.scratch import filesystem

BINARY = "path string, modificationTime timestamp, length long, content binary"
#: Image extensions that the JVM's decoders read.
JVM_EXTENSIONS = tuple(e for e in IMAGE_EXTENSIONS if e != "webp")
_IMAGE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])


def media_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, kind, length) of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", media_kind(F.col("path")).alias("kind"), "length")


def existing(paths: DataFrame, path: str = "path") -> DataFrame:
    """Add ``exists``: whether the executors can open the path, looked up where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p is not None and os.path.exists(re.sub("^file:/+", "/", p)) for p in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.bool_())], names=[*b.schema.names, "exists"])

    column = paths.columns.index(path)
    return paths.mapInArrow(run, T.StructType([*paths.schema, T.StructField("exists", T.BooleanType())]))


def _glob(extensions: Sequence[str]) -> str:
    """File names with one of the extensions in any case, and something before the dot."""
    return "?*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def _color(image: Column) -> Column:
    """Three channels whatever the file has: gray is repeated, alpha is dropped; by hex digits, inside the JVM."""
    hexed, n = F.hex(image["data"]), image["nChannels"]
    pixels = F.when(n == 1, F.regexp_replace(hexed, "(..)", "$1$1$1")).when(n == 4, F.regexp_replace(hexed, "(......)..", "$1"))
    good = image["width"] >= 0
    return F.struct(
        image["origin"].alias("origin"), image["height"].alias("height"), image["width"].alias("width"),
        F.when(good, 3).otherwise(-1).alias("nChannels"), F.when(good, 16).otherwise(-1).alias("mode"),
        F.when(good, F.coalesce(F.unhex(pixels), image["data"])).alias("data"),
    ).cast(schemas.IMAGE_DDL)


def _failed(origin: Column) -> Column:
    return F.struct(origin.alias("origin"), *(F.lit(-1).alias(c) for c in ("height", "width", "nChannels", "mode")), F.lit(None).cast("binary").alias("data")).cast(schemas.IMAGE_DDL)


def webp_image(origin: str, content: bytes, native: bool) -> dict:
    """The image struct of a lossless file; any other content gives the failure image."""
    try:
        px = webp.decode(content)
    except (ValueError, IndexError):
        return {"origin": origin, "height": -1, "width": -1, "nChannels": -1, "mode": -1, "data": None}
    channels = 4 if native and (px[:, :, 0] != 255).any() else 3
    data = np.ascontiguousarray(px[:, :, [3, 2, 1, 0][:channels]]).tobytes()
    return {"origin": origin, "height": px.shape[0], "width": px.shape[1], "nChannels": channels, "mode": 16 if channels == 3 else 24, "data": data}


def _webp(files: DataFrame, native: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices.cut(batch, batch.column(1)) if batch.num_rows else ():
                paths, contents = (c.to_pylist() for c in part.columns)
                images = [webp_image(p, c or b"", native) for p, c in zip(paths, contents, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, _IMAGE)], names=["filename", "image"])

    return files.select("path", "content").mapInArrow(run, f"filename string, image {schemas.IMAGE_DDL}")


def literal(path: str) -> str:
    """A path as Spark's readers take it when none of its characters is meant as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


class _Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _EmptyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])

    def partitions(self):
        """The entries directly below each path; what lies deeper is listed by the tasks."""
        found = []
        for path in self.paths:
            fs, root = filesystem(re.sub(r"\\(.)", r"\1", path))
            info = fs.get_file_info(root)
            found += [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [_Folder(i.path) for i in found if not i.is_file or (i.size == 0 and is_image_path(i.path))]

    def read(self, partition):
        if partition is not None:  # Spark reads one such partition where there is none
            fs, _ = filesystem(self.paths[0])
            info = fs.get_file_info(partition.path)
            found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(partition.path, recursive=True, allow_not_found=True))
            for i in found:
                # like Spark's readers, nothing below hidden folders
                if i.is_file and i.size == 0 and is_image_path(i.path) and not any(x[:1] in "._" for x in i.path[len(partition.path) :].split("/") if x):
                    yield (f"file:{i.path}" if fs.type_name == "local" else i.path,)


class EmptyFileSource(DataSource):
    """Image files of no bytes below folders (``paths``: a JSON list); Spark's own file readers pass over them."""

    @classmethod
    def name(cls) -> str:
        return "empty_image_files"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema):
        return _EmptyReader(self.options)


def _images(reader: DataFrameReader | DataStreamReader, paths: str | list[str], decode: str) -> DataFrame:
    """(filename, image) from two readings that share no file: the JVM's formats, and WebP."""

    def read(kind: str, extensions: Sequence[str]) -> DataFrame:
        # options stay with a reader, so each reading names all of its own
        own = reader.format(kind).schema(BINARY if kind == "binaryFile" else f"image {schemas.IMAGE_DDL}")
        return own.option("recursiveFileLookup", "true").option("dropInvalid", "false").option("pathGlobFilter", _glob(extensions)).load(paths)

    image = F.col("image") if decode == "native" else _color(F.col("image"))
    # that reader gives names as URLs; the others, and Spark's file listing, give plain paths
    plain = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    jvm = read("image", JVM_EXTENSIONS).select(F.regexp_replace(plain, "^file:/+", "file:/").alias("filename"), image.alias("image"))
    return jvm.unionByName(_webp(read("binaryFile", ("webp",)), decode == "native"))


def image_files(spark: SparkSession, path: str | list[str], decode: str = "color") -> DataFrame:
    """(filename, image) of every image file below folders, or of the files named; undecodable and empty files have the failure image.

    ``decode='native'`` keeps the channels that the file has.
    """
    spark.dataSource.register(EmptyFileSource)
    empty = spark.read.format("empty_image_files").option("paths", json.dumps([path] if isinstance(path, str) else list(path))).load()
    failed = empty.select(F.col("path").alias("filename"), _failed(F.col("path")).alias("image"))
    return _images(spark.read, path, decode).unionByName(failed)


def frame_directories(spark: SparkSession, path: str, decode: str = "color") -> DataFrame:
    """(video_id, frame_index, image) of folders of stills: ``<video>/<index>.<extension>``; video_id is a hash of the folder's path."""
    images = image_files(spark, path, decode)
    folder = F.regexp_extract("filename", r"^(.*)/[^/]*\z", 1)
    index = F.regexp_extract("filename", r"([0-9]+)\.[^./]*\z", 1)
    return images.filter(index != "").select(F.xxhash64(folder).alias("video_id"), index.cast("int").alias("frame_index"), "image", folder.alias("path"))


def image_stream(spark: SparkSession, path: str, decode: str = "color") -> DataFrame:
    """The same table as a stream of newly arriving files; Spark's file streams hand on no file of no bytes."""
    return _images(spark.readStream, path, decode)
