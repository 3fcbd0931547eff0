"""Connected components of an edge table by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few_shuffle_files, materialise


def _state(edges: DataFrame) -> tuple:
    with few_shuffle_files(edges.sparkSession):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of every node of edges a, b (longs), stored. Every pass is two grouped minima and joins, whatever a node's degree; the minima are stored, so that Spark may split a node of many edges in the joins. What passes leave in the shared folder goes when the next is done."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = materialise(large.where("a <> b").distinct(), "large-star")
        discard(now, low)
        least = materialise(kept.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least")
        small = kept.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("u", "m"))
        now = materialise(small.where("a <> b").distinct(), "small-star")
        discard(kept, least)
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    out = materialise(roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    discard(now)
    return out
