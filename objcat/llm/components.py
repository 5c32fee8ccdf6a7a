"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objcat.session import staged


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _reduced(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").distinct()


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): for each node with an edge, the smallest node it reaches.

    Alternating large and small stars: every node links its larger neighbours to its smallest one, then
    itself and its smaller neighbours to the smallest. Each round is a few joins and map-side reduced
    groupings; a hub is never gathered in one task (its smallest neighbour is a minimum, and the join
    back is an equi-join whose large keys adaptive execution splits). Rounds grow with the logarithm of
    the longest chain. Each round is written to the shared folder, so a lost executor costs one round.
    Edges with a null end, from a node to itself or repeated say nothing and change nothing; no edges give no rows.
    """
    pairs = edges.select(F.col(left).alias("_a"), F.col(right).alias("_b")).filter("_a is not null and _b is not null")
    pairs = _reduced(pairs.select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")))
    now = staged(pairs, "edges")
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _reduced(both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = staged(_reduced(small.select("e.u", "e.v")), "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
