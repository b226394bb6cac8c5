"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two shuffles over the edges and is written to the shared folder;
stars with many leaves are skewed only in joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, stage


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge (a, b); no edges, no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage(e, "components")
    before = _mark(e)
    while before[0]:
        # large star: each larger neighbour of u to u's smallest
        sym = _both(e)
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = sym.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: u and its smaller neighbours to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, stage(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "components")
        discard(last)
        after = _mark(e)
        if after == before:
            break
        before = after
    roots = e.groupBy("b").agg(F.count("*")).select(F.col("b").alias("id"), F.col("b").alias("component"))
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(roots)
