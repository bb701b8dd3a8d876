"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import forget, written


def _least(edges: DataFrame) -> DataFrame:
    """For each u: the least of u and its neighbours v.  An aggregate, combined before the shuffle, so that a hub's
    neighbours never meet in one place."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges u > v, as edges u > v again.

    large: each node's greater neighbours are linked to the least node around it; small: its lesser neighbours and itself are."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        linked = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = _least(edges)
        joined = edges.join(least, "u")
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another one; component is the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until nothing changes.  Each round is two joins
    with an aggregate of one row a node; the edges of a round are written to the shared folder.  Loops and repeated edges do
    no harm; edges with a null end are ignored."""
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == mark or not state.n:
            break
        mark = (state.n, state.h)
        after = written(_star(_star(now, True), False), "edges")
        forget(now)
        now = after
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
