"""Filters that choose what an action works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.routes import normalize_path


def mentions(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Rows one of whose columns holds the target, in lower case, dashes before it left out."""
    needle = F.lit(target.strip().lstrip("-").strip().lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), needle)
    return df.where(hit)


def of_changed_files(routes: DataFrame, ref: str, changed: DataFrame, file: str) -> DataFrame:
    """Routes whose reference holds one of the changed files, or is held by one, as text; all routes, if none does and no reference names a file.

    All pieces of either text that are as long as some text of the other side are met in equi-joins, so the work grows with the lengths of paths, not with references times files."""
    tidy = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "/+", "/")
    refs = routes.select(F.col(ref).alias("_ref"), tidy(F.col(ref)).alias("_r")).distinct().where("_r <> ''")
    files = changed.select(tidy(F.col(file)).alias("_f")).distinct().where("_f <> ''")

    def pieces(text: str, others: DataFrame, other: str) -> Column:
        sizes = sorted(r[0] for r in others.select(F.length(other)).distinct().collect())  # no more than the longest path has characters
        runs = F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length(text)), lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n)))
        return F.explode(F.array_distinct(F.flatten(runs))) if sizes else F.explode(F.array().cast("array<string>"))

    holds = refs.select("_ref", pieces("_r", files, "_f").alias("_f")).join(files, "_f", "left_semi").select("_ref")
    held = refs.join(files.select(pieces("_f", refs, "_r").alias("_r")).distinct(), "_r", "left_semi").select("_ref")
    hit = routes.join(holds.unionByName(held).distinct(), F.col(ref) == F.col("_ref"), "left_semi")
    # one row tells whether the whole answer is empty and no reference looks like a file
    state = hit.agg((F.count(F.lit(1)) == 0).alias("_none")).crossJoin(routes.agg(F.coalesce(F.bool_and(F.coalesce(~F.contains(ref, F.lit("/")), F.lit(True))), F.lit(True)).alias("_bare")))
    return hit.unionByName(routes.crossJoin(F.broadcast(state)).where("_none and _bare").select(*routes.columns))


def grounded_spans(spans: DataFrame, symbols: DataFrame, candidates: DataFrame, pad: int = 2, block: int = 256) -> DataFrame:
    """spans (id, file, lo, hi) with grounded: a symbol (file, s_lo, s_hi) overlaps them, or a candidate (file, line) lies in them or pad lines around.

    Nothing is paired: of what begins at or before a span's end only the furthest end counts, which is a running maximum along the file.  It is taken within blocks of lines and carried over by one row a
    block, so that one large file is dealt out; equal spans, and symbols that begin at the same line, are one row."""
    known = symbols.where("s_lo <= s_hi").select("file", F.lit(0).alias("kind"), F.col("s_lo").cast("long").alias("at"), F.col("s_hi").cast("long").alias("end")).unionByName(candidates.select("file", F.lit(1).alias("kind"), F.col("line").cast("long").alias("at"), F.col("line").cast("long").alias("end")))
    known = known.where("file is not null and at is not null and end is not null").groupBy("file", "kind", "at").agg(F.max("end").alias("end"))
    around = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("lo") - p).cast("long").alias("from"), (F.col("hi") + p).cast("long").alias("at")) for k, p in ((0, 0), (1, pad))])
    asked = spans.where("file is not null").select("file", "lo", "hi", F.inline(around)).distinct()
    rows = known.select("file", "kind", "at", "end", F.lit(None).cast("long").alias("from"), F.lit(None).cast(spans.schema["lo"].dataType).alias("lo"), F.lit(None).cast(spans.schema["hi"].dataType).alias("hi")).unionByName(asked.withColumn("end", F.lit(None).cast("long")))
    rows = rows.withColumn("_b", F.floor(F.col("at") / block))
    before = Window.partitionBy("file", "kind").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file", "kind", "_b").agg(F.max("end").alias("end")).select("file", "kind", "_b", F.max("end").over(before).alias("_past"))
    upto = Window.partitionBy("file", "kind", "_b").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("_end", F.max("end").over(upto)).where("lo is not null").join(carried, ["file", "kind", "_b"])
    hit = ends.where(F.greatest("_end", "_past") >= F.col("from")).select("file", "lo", "hi").distinct().withColumn("grounded", F.lit(True))
    return spans.join(hit, ["file", "lo", "hi"], "left").select(*spans.columns, F.coalesce("grounded", F.lit(False)).alias("grounded"))


def corroborated(routes: DataFrame, corpus: DataFrame) -> DataFrame:
    """Routes (method, path) that the corpus (method, path) has with the same method, or with none; two equi-joins on the path in normal form."""
    known = corpus.select(normalize_path(F.col("path")).alias("_p"), F.upper("method").alias("_m")).distinct()
    rows = routes.withColumn("_p", normalize_path(F.col("path"))).withColumn("_m", F.explode(F.array_distinct(F.array(F.upper("method"), F.lit("")))))
    return rows.join(known, ["_p", "_m"], "left_semi").drop("_p", "_m").distinct()


def exclusions(verified: DataFrame, duplicates: DataFrame, approved: DataFrame) -> DataFrame:
    """key, reasons of what may not be written: verified (key, status, failures), duplicate keys, but for approved keys."""
    reason = F.concat(F.when(F.col("status") == "fabricated", F.array(F.lit("identity citation does not match code"))).otherwise(F.array().cast("array<string>")), F.coalesce("failures", F.array().cast("array<string>")))
    one = verified.select("key", reason.alias("list")).join(duplicates.select("key").distinct().withColumn("_twice", F.lit(True)), "key", "left")
    full = F.concat("list", F.when(F.col("_twice"), F.array(F.lit("duplicate endpoint definition"))).otherwise(F.array().cast("array<string>")))
    return one.select("key", full.alias("list")).where("size(list) > 0").join(approved.select("key"), "key", "left_anti").select("key", F.array_join("list", "; ").alias("reasons"))


def in_scope(rows: DataFrame, uids: list[str] | None, file: str | None) -> DataFrame:
    """The named uids, else rows whose first file holds the text, else all."""
    if uids:
        return rows.where(F.col("uid").isin(uids))
    return rows.where(F.contains("file", F.lit(file))) if file else rows


def broken_items(items: DataFrame) -> DataFrame:
    """id, error of stored items (id, name, is_folder, has_request, method) that may not be written; no rows: all is well."""
    error = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "no name").when(F.col("is_folder") & F.col("has_request"), "folder with a request").when(~F.col("is_folder") & ~F.col("has_request"), "neither folder nor request").when(F.col("has_request") & (F.coalesce(F.col("method"), F.lit("")) == ""), "no method")
    return items.select("id", error.alias("error")).where("error is not null")


def unknown(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def broken_environments(environments: DataFrame) -> DataFrame:
    """id, error of environments (id, text) that may not be written: no object, no name, no values, and no key for each value without one; no rows: all is well."""
    d = F.col("d")
    rows = environments.select("id", F.expr("try_parse_json(text)").alias("d"))
    values = F.try_variant_get(d, "$.values", "array<variant>")
    keyless = F.transform(F.filter(values, lambda v: F.coalesce(F.try_variant_get(v, "$.key", "string"), F.lit("")) == ""), lambda v: F.lit("no key"))
    found = F.when(F.coalesce(F.try_variant_get(d, "$", "map<string,variant>").isNull(), F.lit(True)), F.array(F.lit("no object"))).otherwise(
        F.concat(F.array_compact(F.array(F.when(F.coalesce(F.try_variant_get(d, "$.name", "string"), F.lit("")) == "", "no name"), F.when(values.isNull(), "no values"))), F.coalesce(keyless, F.array().cast("array<string>"))))
    return rows.select("id", F.explode(found).alias("error"))
