"""First, last and capped rows of a key, duplicates and precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The row of each key that comes first (or last) by order; an aggregate, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(order, *[c for c in rest if c != order]))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def cap_per_key(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, the first ones by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def duplicate_keys(df: DataFrame, key: str, member: str) -> DataFrame:
    """key, n, member: one row for each member of a key that several members have; one aggregate joined back, so that no list of a key's members is built."""
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.join(many, key).select(key, "n", member)


def precedence_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last of second if it has the key, else the first of first; overridden tells where both have it."""
    one = first_per_key(first, [key], order).withColumn("_side", F.lit(0))
    two = first_per_key(second, [key], order, last=True).withColumn("_side", F.lit(1))
    rest = [c for c in first.columns if c != key]
    both = one.unionByName(two).groupBy(key).agg(F.max_by(F.struct(*rest), "_side").alias("_row"), (F.count(F.lit(1)) > 1).alias("overridden"))
    return both.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], "overridden")
