"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: every linked node with the smallest node it reaches.

    Alternating large and small stars: each round hangs a node's neighbours on
    the smallest of them, and the diameter shrinks to one in a logarithmic
    number of rounds.  Each round is aggregations and equi-joins over the links
    and is written to the shared folder, so a lost executor costs one round at
    most.  Links to oneself and with a null end are ignored.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while True:
        ends = edges.union(edges.select("v", "u"))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ends.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(hung.union(smallest).distinct(), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links, and otherwise but for a chance of 2^-64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
