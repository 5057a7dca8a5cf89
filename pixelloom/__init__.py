"""Media feature analytics on Spark: files, images, videos and frames as DataFrames."""

__version__ = "0.1.0"
