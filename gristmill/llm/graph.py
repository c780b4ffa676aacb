"""Connected components by alternating large and small stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_counted, drop_cut, few_tasks


def _held(edges: DataFrame) -> tuple:
    """The edges as a table, its path, and a count and checksum of them."""
    held, path, seen = cut_counted(edges, F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    return held, path, (seen["rows"], seen["sum"])


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each end of an edge; ``component`` is the smallest node reachable.

    Edges with a null end and loops say nothing and are left out, so their ends are
    missing from the result; repeated edges count once.  Every round is one pair of
    aggregations whose partial results combine before the shuffle, and joins on the node,
    which adaptive execution splits where a hub is hot.  The state is written to the
    shared folder after each round; only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u != v")
    # (u, v) with u > v throughout
    now, path, state = _held(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not state[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        # large star: neighbours above u move to the least of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: lower neighbours of u and u itself move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        rest = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
        new, new_path, new_state = _held(few_tasks(rest, 2 * state[0]))
        drop_cut(spark, path)
        now, path, before, state = new, new_path, state, new_state
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
