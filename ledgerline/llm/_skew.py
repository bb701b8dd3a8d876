"""Joins of many rows with one row a key, where a few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more than one in SHARE of the rows.  At most SHARE keys can be, whatever the input, so they may be told to all tasks.
SHARE = 10_000


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], how: str = "inner", count: str = "c") -> DataFrame:
    """rows joined with facts, which hold each key once and in ``count`` how many rows have it; ``count`` is left out of the result.

    Rows of a hot key are dealt by the hash of their ``spread`` columns over as many salts as SHARE allows, and its fact is repeated for each: no
    salt gets much more than one in SHARE of the rows, and facts grow by at most 2 * SHARE rows.  Hash and counts are fixed, so a task that
    runs again deals alike.  Null keys meet nothing.  facts are read three times and should be a written table."""
    total = facts.agg(F.sum(count).alias("n")).first().n or 0
    hot = facts.where(F.col(count) * SHARE > total).select(*keys, F.ceil(F.col(count) * SHARE / F.lit(max(total, 1))).cast("int").alias("_salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))).drop("_salts")
    salts = F.when(F.col(count) * SHARE > total, F.ceil(F.col(count) * SHARE / F.lit(max(total, 1))).cast("int")).otherwise(1)
    told = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(count)
    return dealt.join(told, [*keys, "_salt"], how).drop("_salt")
