"""Intervals on a line: overlap, tightest enclosure, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .stores import dealt


def overlapping(a: DataFrame, b: DataFrame, on: str, width: int) -> DataFrame:
    """Pairs of a (a_id, a_lo, a_hi) and b (b_id, b_lo, b_hi) that share ``on`` and overlap.

    Both sides are cut into bins of ``width``; pairs meet by (on, bin), and count in the first bin that they share."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x, y = a.withColumn("_bin", bins("a_lo", "a_hi")), b.withColumn("_bin", bins("b_lo", "b_hi"))
    meet = (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & (F.col("_bin") == F.floor(F.greatest("a_lo", "b_lo") / width))
    return x.join(dealt(y), [on, "_bin"]).where(meet).drop("_bin")


def tightest(points: DataFrame, spans: DataFrame, on: str, width: int) -> DataFrame:
    """For each point (p_id, p_at) the narrowest span (s_id, s_lo, s_hi) around it, the least id of equal ones; null if none."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s_lo") / width), F.floor(F.col("s_hi") / width))))
    held = points.withColumn("_bin", F.floor(F.col("p_at") / width)).join(binned, [on, "_bin"]).where("p_at between s_lo and s_hi")
    best = held.groupBy(on, "p_id").agg(F.min_by("s_id", F.struct(F.col("s_hi") - F.col("s_lo"), "s_id")).alias("s_id"))
    return points.select(on, "p_id").join(best, [on, "p_id"], "left")


def merged(hits: DataFrame, on: str, at: str, pad: int) -> DataFrame:
    """Islands of windows [at - pad, at + pad] that overlap or touch."""
    w = Window.partitionBy(on).orderBy(at)
    new = F.when(F.col(at) - pad > F.lag(F.col(at) + pad).over(w) + 1, 1).otherwise(0)
    island = hits.select(on, at, new.alias("_new")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(on, "_island").agg((F.min(at) - pad).alias("lo"), (F.max(at) + pad).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_island")
