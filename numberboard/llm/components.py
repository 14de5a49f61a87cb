"""Connected components of an edge table, by smallest label, without gathering anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numberboard.llm.frames import discard, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of ``u``, itself included.

    The least neighbours are added up in the map tasks first. A hub's edges meet its one row in a join, whose large
    partitions adaptive execution splits.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("near")).select("u", F.least("u", "near").alias("least"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the vertex's least neighbour instead."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the least of these; ``edges`` lead to the smaller end."""
    met = _with_least(edges)
    ends = met.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
    return ends.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Component of every vertex of ``edges`` (a, b): rows (id, component), component the least id.

    Alternates large stars and small stars (Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, 2014) until
    nothing moves. Every round ties vertices to smaller ones of their component, so it ends with each
    vertex tied to the least; rounds grow with the logarithm of the vertices (squared at worst), however
    long the chains and in whatever order their names, and there is no limit to them. Every round is a written table, and the one before is removed.
    Null ends and loops are left out, repeated edges count once; no edges give no rows.
    """
    ends = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ends).distinct(), purpose)
    mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before, state = None, tuple(now.agg(*mark).first())
    while state[0] and state != before:
        after = written(_small_star(_large_star(now)), purpose)
        discard(now)
        now, before, state = after, state, tuple(after.agg(*mark).first())
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
