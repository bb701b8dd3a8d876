"""Drift between two keyed sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .dedupe import first_per_key


def classify(built: DataFrame, live: DataFrame, key: str, order: str, compared: list[str]) -> DataFrame:
    """key, change: new (built only), deprecated (live only), modified or unchanged (by null-safe comparison).  Repeated keys count by their first row."""
    b = first_per_key(built, [key], order).select(key, F.struct(*compared).alias("_b"))
    v = first_per_key(live, [key], order).select(key, F.struct(*compared).alias("_v"))
    change = F.when(F.col("_v").isNull(), "new").when(F.col("_b").isNull(), "deprecated").when(F.col("_b").eqNullSafe(F.col("_v")), "unchanged").otherwise("modified")
    return b.join(v, key, "full").select(key, change.alias("change"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def rollback(current: DataFrame, snapshot: DataFrame, key: str, raw: str) -> DataFrame:
    """What a rollback would restore, remove or change, by raw inequality."""
    c, s = current.select(key, F.col(raw).alias("_c"), F.lit(1).alias("_in_c")), snapshot.select(key, F.col(raw).alias("_s"), F.lit(1).alias("_in_s"))
    action = F.when(F.col("_in_c").isNull(), "restore").when(F.col("_in_s").isNull(), "remove").when(~F.col("_c").eqNullSafe(F.col("_s")), "change")
    return c.join(s, key, "full").select(key, action.alias("action")).where("action is not null")


def accuracy(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """recall, precision and F1 of two sets; with nothing expected or found the ratio is 1."""
    e, f = expected.select(*key).distinct().withColumn("_e", F.lit(1)), found.select(*key).distinct().withColumn("_f", F.lit(1))
    n = e.join(f, key, "full").agg(F.count("_e").alias("n_expected"), F.count("_f").alias("n_found"), F.count(F.when(F.col("_e").isNotNull() & F.col("_f").isNotNull(), 1)).alias("n_common"))
    recall = F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_common") / F.col("n_expected"))
    precision = F.when(F.col("n_found") == 0, 1.0).otherwise(F.col("n_common") / F.col("n_found"))
    n = n.select("*", recall.alias("recall"), precision.alias("precision"))
    return n.withColumn("f1", F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))))


def field_accuracy(expected: DataFrame, actual: DataFrame, key: str, exact: str, dims: list[str]) -> DataFrame:
    """dim, rate: the share of equal values of ``exact``, and for each set column the lesser of recall and precision of its summed sizes.

    A key that actual lacks misses in every dimension; keys that expected lacks don't count.  Without anything to find a rate is 1."""
    found = actual.select(key, F.col(exact).alias("_exact"), *(F.array_distinct(d).alias(f"_{d}") for d in dims))
    both = expected.select(key, exact, *(F.array_distinct(d).alias(d) for d in dims)).join(found, key, "left")
    size = lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), F.size(c))), F.lit(0))
    sums = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("_exact") == F.col(exact)).alias("right")]
    for d in dims:
        sums += [size(F.array_intersect(d, f"_{d}")).alias(f"m_{d}"), size(F.col(d)).alias(f"e_{d}"), size(F.col(f"_{d}")).alias(f"x_{d}")]
    share = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.try_divide(F.col(a), F.col(b)))
    rows = [F.struct(F.lit(exact).alias("dim"), share("right", "total").alias("rate"))] + [F.struct(F.lit(d).alias("dim"), F.least(share(f"m_{d}", f"e_{d}"), share(f"m_{d}", f"x_{d}")).alias("rate")) for d in dims]
    return both.agg(*sums).select(F.inline(F.array(*rows)))
