"""Chunks under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


LEAST = 500


def fit(chunks: DataFrame, key: str, budget: int, overhead: int = 8) -> DataFrame:
    """Kept chunks (key, ord, rank, length, cost) of each key: in order of rank, text length and ord, those that still fit; rank 0 always, and it counts; a budget is LEAST or more.

    The fold is over one key's chunks, a request's context, as an array: a later, smaller chunk may be kept after a larger one was left out."""
    budget = max(budget, LEAST)
    ordered = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "length", "ord", "cost"))).alias("list"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(state, x):
        cost = x["cost"] + overhead
        take = (x["rank"] == 0) | (state["used"] + cost <= budget)
        return F.struct(F.when(take, state["used"] + cost).otherwise(state["used"]).alias("used"), F.when(take, F.array_append(state["kept"], x["ord"])).otherwise(state["kept"]).alias("kept"))

    folded = ordered.select(key, F.aggregate("list", start, step).alias("s"))
    return folded.select(key, F.col("s.used").alias("used"), F.size("s.kept").cast("long").alias("n_kept"), F.array_join(F.transform(F.array_sort("s.kept"), lambda x: x.cast("string")), ",").alias("kept"))
