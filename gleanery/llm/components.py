"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanery.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(v, u): every vertex of the links (a, b) that is not the smallest of its component, with that smallest.

    In each step a vertex hands its neighbours the smallest vertex it knows; the number of links never grows, and
    a vertex with very many links is an ordinary join key that Spark may split.
    """
    found = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    found = stored(found, name)
    before = None
    while True:
        mark = _mark(found)
        if mark == before:
            return found
        before = mark
        # Large star: larger neighbours of x move to the smallest neighbour of x (x included).
        both = found.select(F.col("v").alias("x"), F.col("u").alias("y")).union(found.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # Small star: x and its smaller neighbours move to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        found = stored(small.where("u < v").distinct(), name)
