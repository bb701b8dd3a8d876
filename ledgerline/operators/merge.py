"""Merges that leave each side what it owns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def owned_merge(live: DataFrame, built: DataFrame, key: str, built_owns: list[str], live_owns: list[str]) -> DataFrame:
    """Upsert: the built side gives built_owns; the live side keeps its live_owns unless they are empty; rows of one side stay."""
    b = built.select(key, *[F.col(c).alias(f"_b_{c}") for c in [*built_owns, *live_owns]], F.lit(True).alias("_in_b"))
    out = live.select(key, *built_owns, *live_owns).join(b, key, "full")
    code = [F.when(F.col("_in_b"), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) for c in built_owns]
    human = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_b_{c}")).alias(c) for c in live_owns]
    return out.select(key, *code, *human)


def overlay(base: Column, patch: Column) -> Column:
    """Map with the patch's value where it has the key."""
    return F.map_zip_with(base, patch, lambda k, a, b: F.coalesce(b, a))


def deprecate(name: Column, mark: str = "[DEPRECATED] ") -> Column:
    """The name with the mark before it, once."""
    return F.when(name.startswith(mark.strip()), name).otherwise(F.concat(F.lit(mark), name))
