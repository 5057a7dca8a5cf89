"""Connected components of an edge table, in tables: large-star and small-star steps until nothing changes.

Each step is one aggregate (combined in the map task) and one join; the table of a step is written to shared storage,
so plans stay short and lost executors cost one step.  The number of steps grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to its least neighbour; ``large``: those above the node, else those below."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(back) if large else back  # b < a in every row of back
    # written, so that the join deals both sides by itself and can split a node with very many neighbours
    least = store.staged(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "components-least")
    joined = around.join(least, "a")
    far = joined.filter(F.col("b") > F.col("a")) if large else joined
    pairs = far.select(F.col("m").alias("x"), F.col("b").alias("y"))
    if not large:
        pairs = pairs.unionByName(least.select(F.col("m").alias("x"), F.col("a").alias("y")))
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): every node of an edge (a < b) with the least node of its component."""
    now, rows, same = edges, edges.count(), False
    while not same:
        after = store.staged(_star(_star(now, large=True), large=False), "components")
        # both tables are distinct rows, so as many rows and none that is new mean the same rows
        before, rows = rows, after.count()
        same = before == rows and not after.join(now, ["a", "b"], "left_anti").limit(1).count()
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
