"""Names as a file sees them, and what a text reaches through them.

symbols: sid, ord, file, name, kind, parent (empty at the top of a file), text; imports: src, dst, ord, names (empty: the whole module)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .stores import BROADCAST_ROWS, counted, dealt, spread, streamed

#: Capitalised words that are never looked up, and how many steps types are followed.
STOP_WORDS = ["True", "False", "None", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Any", "Callable", "Type", "String", "Number", "Boolean", "Promise", "Array", "Object", "Depends", "Field", "BaseModel", "Enum", "Exception", "Error"]
TYPE_STEPS = 3
#: What looks like the name of a type, and like a call.
_TYPE, _CALL = r"\b([A-Z][A-Za-z0-9_]{2,})\b", r"\b([a-z_][a-z0-9_]{2,})\s*\("


def resolved(asked: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """name, file, sid, tier of the distinct names that files ask for (asked: name, file); names that lead nowhere are left out.

    1: the first symbol of the file itself; 2: of a file from which the name is imported, in the order of imports; 3: of a file that is imported as a whole; 4: the only one
    of that name anywhere.  Only symbols at the top of a file count.  Each tier is an equi-join; tier 3 joins the modules that a file imports, not their symbols."""
    asked, n = counted(asked.select("name", "file"), "asked")
    return _found(asked, n, symbols, imports).select("name", "file", "sid", "tier")


def _found(asked: DataFrame, n: int, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """resolved() of n rows, with kind and file (there) of what was found, in partitions by name and file.

    A name or file that all others use makes very many rows of one key; these run past the symbols, of which a name and file has one, and past the names of one symbol."""
    want, n = counted(spread(asked.select("name", "file"), n, "name", "file").distinct(), "asked")
    want = spread(want, n, "name", "file")
    found = F.struct(F.col("ord").cast("long").alias("place"), "sid", "kind", F.col("file").alias("there"))
    top = symbols.where("parent = ''").select("name", F.col("file").alias("at"), found.alias("s"))
    first = streamed(top.groupBy("name", "at").agg(F.min("s").alias("s")))
    row = lambda df, tier, edge: df.select("name", "file", F.struct(F.lit(tier).alias("tier"), edge.cast("long").alias("edge"), "s.place", "s.sid", "s.kind", "s.there").alias("b"))
    own = row(want.join(first.withColumnRenamed("at", "file"), ["name", "file"]), 1, F.lit(0))
    edges = imports.select(F.col("src").alias("file"), F.col("dst").alias("at"), F.col("ord").cast("long").alias("edge"), "names")
    named = edges.where("size(names) > 0").select("file", "at", "edge", F.explode(F.array_distinct("names")).alias("name")).groupBy("file", "at", "name").agg(F.min("edge").alias("edge"))
    second = row(want.join(dealt(named), ["name", "file"]).join(first, ["name", "at"]), 2, F.col("edge"))
    whole = edges.where("size(names) = 0").groupBy("file", "at").agg(F.min("edge").alias("edge"))
    third = row(want.join(dealt(whole), "file").join(first, ["name", "at"]), 3, F.col("edge"))
    single = top.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s")).where("n = 1").drop("n")
    fourth = row(want.join(streamed(single), "name").withColumn("s", F.col("s").withField("place", F.lit(0).cast("long"))), 4, F.lit(0))
    every = own.unionByName(second).unionByName(third).unionByName(fourth)
    best = spread(every, 4 * n, "name", "file").groupBy("name", "file").agg(F.min("b").alias("b"))
    return best.select("name", "file", "b.sid", "b.tier", "b.kind", "b.there")


def _seen(words: DataFrame, symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, int]:
    """words (sid, file, name) with what each name leads to: to, kind, there; and the number of words."""
    words, n = counted(words, "words")
    found = _found(words, n, symbols, imports).withColumnRenamed("sid", "to")
    return spread(words, n, "name", "file").join(dealt(spread(found, n, "name", "file")), ["name", "file"]), n


def type_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """sid, to: classes that each symbol's text names, as its file sees them, stop words left out."""
    words = symbols.select("sid", "file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TYPE), 1))).alias("name")).where(~F.col("name").isin(STOP_WORDS))
    seen, n = _seen(words, symbols, imports)
    return spread(seen.where("kind = 'class'").select("sid", "to"), n, "sid").distinct()


def expanded_types(seeds: DataFrame, symbols: DataFrame, imports: DataFrame, steps: int = TYPE_STEPS) -> DataFrame:
    """seed, sid, depth: classes reached from each seed (seed, sid) in at most steps, with the least number of steps.

    A round follows what the round before found and takes off all that the seed has seen, itself included, so that rings end and nothing is followed twice.  Classes that many reach run
    past the edges, of which a class has as many as its text names."""
    edges, n_edges = counted(type_edges(symbols, imports), "edges")
    fan = -(-n_edges // max(1, edges.select("sid").distinct().count()))
    seen, n = counted(seeds.select("seed", "sid").distinct().withColumn("depth", F.lit(0)), "types")
    front, out, total = seen, [], n
    for depth in range(1, steps + 1):
        step = spread(front.select("seed", "sid"), max(n, n_edges), "sid").join(streamed(spread(edges, max(n, n_edges), "sid")), "sid").select("seed", F.col("to").alias("sid"))
        rows = max(n * max(1, fan), total)
        fresh = spread(step, rows, "seed", "sid").distinct().join(dealt(spread(seen.select("seed", "sid"), rows, "seed", "sid")), ["seed", "sid"], "left_anti")
        front, n = counted(fresh.withColumn("depth", F.lit(depth)), "types")
        seen, total = seen.unionByName(front), total + n
        out.append(front)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return dealt(found) if total > BROADCAST_ROWS else found


def called(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """sid, callee: functions of other files that a symbol's text calls, as its file sees their names; one step."""
    words = symbols.select("sid", "file", F.col("name").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_CALL), 1))).alias("name")).where("name <> own").drop("own")
    seen, n = _seen(words, symbols, imports)
    return spread(seen.where("kind = 'function' and there <> file").select("sid", F.col("to").alias("callee")), n, "sid").distinct()
