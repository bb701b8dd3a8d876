"""What a target needs around it: the classes it names, and the lines that mention it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .stores import counted, spread, streamed


def expand_types(symbols: DataFrame, depth: int = 3) -> DataFrame:
    """owner, name, depth: other classes reached from each class over capitalised names in its text, in at most ``depth`` steps, with the least number.

    symbols holds name and text.  A name that several symbols have resolves to none of them.  Each step is a join by name; steps are
    few, so that no recursion is needed.  Names that very many texts hold run past the names and edges, of which a class has as many as its text holds."""
    n = symbols.count()
    known = spread(symbols.select("name"), n, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("name")
    named = symbols.join(streamed(known), "name", "left_semi").select("name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Za-z0-9_]*)"), 1))).alias("to"))
    edges, n = counted(named.join(streamed(known.withColumnRenamed("name", "to")), "to", "left_semi").select(F.col("name").alias("from"), "to"), "edges")
    fan = -(-n // max(1, edges.select("from").distinct().count()))
    front = edges.select(F.col("from").alias("owner"), F.col("to").alias("name"), F.lit(1).alias("depth"))
    found, rows, total = front, n, n
    for step in range(2, depth + 1):
        past = spread(front, max(n, rows), "name").join(streamed(spread(edges.withColumnsRenamed({"from": "name"}), max(n, rows), "name")), "name").select("owner", F.col("to").alias("name"))
        front, rows = counted(spread(past, rows * max(1, fan), "owner", "name").distinct().withColumn("depth", F.lit(step)), "types")
        found, total = found.unionByName(front), total + rows
    return spread(found.where("owner <> name"), total, "owner", "name").groupBy("owner", "name").agg(F.min("depth").alias("depth"))


def line_windows(docs: DataFrame, key: str, text: str, hit: Column | str, pad: int = 3) -> DataFrame:
    """key, lo, hi: lines with a hit and ``pad`` lines around them, windows that overlap or touch as one, inside the text.

    hit is a pattern.  All is done inside a row, so nothing is shuffled."""
    lines = F.split(text, "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(hit), i + 1)), lambda x: x.isNotNull())
    rows = docs.select(key, F.size(lines).alias("total"), at.alias("at"))
    apart = lambda a, b: F.coalesce(b - pad > a + pad + 1, F.lit(True))
    first = F.filter("at", lambda x, i: apart(F.get("at", i - 1), x))
    last = F.filter("at", lambda x, i: apart(x, F.get("at", i + 1)))
    window = F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("w")
    return rows.select(key, "total", window).select(key, F.greatest(F.lit(1), F.col("w.a") - pad).alias("lo"), F.least("total", F.col("w.b") + pad).alias("hi"))
