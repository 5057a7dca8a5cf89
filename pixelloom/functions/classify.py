"""File routing by extension: Column expressions and their plain-Python twins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions that the router accepts.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "gif", "webp")
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "m4v")


def _pattern(extensions: tuple[str, ...]) -> str:
    # A name before the dot is needed (".jpg" has no extension); \z, as $ would accept a final newline.
    return r"(?i)(^|/)[^/]+\.(" + "|".join(extensions) + r")\z"


IMAGE_PATTERN = _pattern(IMAGE_EXTENSIONS)
VIDEO_PATTERN = _pattern(VIDEO_EXTENSIONS)


def is_image_file(path: Column) -> Column:
    return path.rlike(IMAGE_PATTERN)


def is_video_file(path: Column) -> Column:
    return path.rlike(VIDEO_PATTERN)


def media_kind(path: Column) -> Column:
    """'image', 'video' or 'unsupported'; the image test comes first."""
    return F.when(is_image_file(path), "image").when(is_video_file(path), "video").otherwise("unsupported")


def first_frame_name(path: Column) -> Column:
    """Name of the still that belongs to a video: its stem and a fixed suffix."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.concat(F.regexp_replace(name, r"(?s)(.)\.[^.]*\z", "$1"), F.lit("_first_frame.jpg"))


def is_image_path(path: str) -> bool:
    return re.search(IMAGE_PATTERN.replace(r"\z", r"\Z"), path) is not None


def is_video_path(path: str) -> bool:
    return re.search(VIDEO_PATTERN.replace(r"\z", r"\Z"), path) is not None
