"""Command line: ``python -m pixelloom.cli FILE... [--output REPORT]``."""

from __future__ import annotations

import json
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelloom import api
from pixelloom.functions.classify import media_kind
from pixelloom.sources.files import existing

log = logging.getLogger("pixelloom")


def main(argv: list[str]) -> int:
    if not argv:
        print("usage: python -m pixelloom.cli FILE... [--output REPORT]")
        return 1
    output, paths = "results.json", []
    i = 0
    while i < len(argv):
        if argv[i] == "--output" and i + 1 < len(argv):  # without a value it is a file name like any other
            output, i = argv[i + 1], i + 1
        else:
            paths.append(argv[i])
        i += 1
    spark = SparkSession.builder.getOrCreate()
    # one table of all arguments: which exist, and what each is
    asked = spark.createDataFrame([(i, p, os.path.abspath(p)) for i, p in enumerate(paths)], "place int, path string, full string")
    rows = existing(asked, "full").withColumn("kind", media_kind(F.col("path"))).orderBy("place").collect()
    for r in rows:
        if not r["exists"]:
            log.error("file not found: %s", r["path"])
        elif r["kind"] == "unsupported":
            log.error("unsupported file type: %s", r["path"])
    of = lambda kind: [r["path"] for r in rows if r["exists"] and r["kind"] == kind]
    report = {"images": api.process_images(spark, of("image")), "videos": api.process_videos(spark, of("video"), stills=os.getcwd())}
    try:
        with open(output, "w") as f:
            json.dump(report, f, indent=2, sort_keys=True)
    except OSError:
        log.error("could not write %s", output)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
