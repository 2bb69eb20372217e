"""Connected components of a stored edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslens.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round links neighbours to the smallest node seen (first those above a node, then
    those below it), which takes a number of rounds in the order of log squared of the
    nodes; edges that form stars already take two. A round is one job. Minima are combined
    before the shuffle, and the edges of a node with very many meet its minimum in a join
    that can be split. The edges are stored each round.
    """
    pairs = edges.filter(F.col(a) != F.col(b))
    now = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = large.join(below, F.col("u") == F.col("at")).select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "m"))).otherwise(
            F.array(F.struct(F.col("v").alias("u"), "m")))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        now = stored(small.distinct(), "edges")
        before, seen = seen, _state(now)
        if before == seen:
            break
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
