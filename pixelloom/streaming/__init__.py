"""Feature records of newly arriving images: a stateless stream, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixelloom.operators import records
from pixelloom.sources.files import image_stream


def stream_image_features(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    features = records.process_images(image_stream(spark, folder))
    return features.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
