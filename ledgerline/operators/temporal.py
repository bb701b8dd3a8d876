"""The state of things at a moment: joins with the last version at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .stores import dealt


def as_of(points: DataFrame, versions: DataFrame, key: str, at: str, version_at: str, width: int) -> DataFrame:
    """points with ``version_at``: of the versions (key, version_at) of the same key the last one at or before ``at``; null if there is none.

    Moments are whole numbers; null ones, and null keys, have no version.  Distinct points and versions are sorted together within windows of a key and ``width`` moments, and a window over
    one row for each of these takes the last version across them: a key with many points or versions is spread over as many tasks as it has stretches, and no pairs are formed."""
    asked = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).alias("_at")).distinct()
    rows = asked.withColumn("_version", F.lit(None).cast("long")).unionByName(versions.where(F.col(key).isNotNull()).select(key, F.col(version_at).cast("long").alias("_at"), F.col(version_at).cast("long").alias("_version")).distinct())
    rows = rows.withColumn("_stretch", F.floor(F.col("_at") / width))
    inside = Window.partitionBy(key, "_stretch").orderBy("_at", F.asc_nulls_last("_version")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, "_stretch").agg(F.max("_version").alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    found = rows.withColumn("_found", F.last("_version", ignorenulls=True).over(inside)).where("_version is null").join(dealt(carried), [key, "_stretch"])
    found = found.select(F.col(key), F.col("_at").alias(at), F.coalesce("_found", "_carried").alias(version_at))
    return points.join(dealt(found), [key, at], "left")
