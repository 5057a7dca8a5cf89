"""Explicit schemas of every table the engine exchanges.  Nothing is inferred."""

from pyspark.sql import types as T

IMAGE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
IMAGE_DDL = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"

VIDEOS = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("frame_count", T.IntegerType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField("video_id", T.LongType()),
        T.StructField("frame_index", T.IntegerType()),
        T.StructField("image", IMAGE),
    ]
)

#: Number of frames, counted from the first, that each video metric looks at (highest index used).
BRIGHTNESS_LAST = 100
MOTION_LAST = 49
COLOR_LAST = 9
SCENE_LAST = 1000
CONSISTENCY_LAST = 49
