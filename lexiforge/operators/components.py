"""Connected components by alternating large-star and small-star steps, cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, rep``: each vertex but the least of its component, with that one. Vertices of any type that compares; links may repeat."""
    edges = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = cut(both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        edges = cut(small.select("e.v", "e.u").where("v != u").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select("v", F.col("u").alias("rep"))


def labels(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, label`` of all linked vertices: the least vertex of each component."""
    found = stars(links, a, b)
    return found.select("v", F.col("rep").alias("label")).unionByName(found.select(F.col("rep").alias("v"), F.col("rep").alias("label")).distinct())
