"""Tiered look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def best_tier(candidates: DataFrame, tier: str = "tier", by: list[str] | None = None) -> DataFrame:
    """Rows of the lowest tier that any row has, for each key of ``by``; over all rows the least tier is one aggregate, joined back."""
    if by:
        return candidates.withColumn("_t", F.min(tier).over(Window.partitionBy(*by))).where(F.col(tier) == F.col("_t")).drop("_t")
    least = candidates.agg(F.min(tier).alias("_t"))
    return candidates.join(F.broadcast(least), F.col(tier) == F.col("_t")).drop("_t")  # one row


def match_target(df: DataFrame, column: str, target: str) -> DataFrame:
    """Rows equal to the target, else ending with it, else containing it."""
    c, t = F.lower(column), F.lit(target.lower())
    tier = F.when(c == t, 1).when(c.endswith(t), 2).when(c.contains(t), 3)
    return best_tier(df.withColumn("tier", tier).where("tier is not null"))


def longest_prefix(rows: DataFrame, path: str, units: DataFrame, root: str) -> DataFrame:
    """Each row with the longest root that its path begins with; an equi-join on all prefixes of the path, not a comparison with all roots."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = rows.withColumn("_p", F.explode(prefixes)).join(units.select(F.col(root).alias("_p"), F.col(root)), "_p")
    best = met.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return rows.join(best, path, "left")
