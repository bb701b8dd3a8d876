"""Citations made from spans, evidence located by symbol, and models widened to facts and narrowed to routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.routes import is_confined, normalize_path, snippet_hash

#: The most lines of a citation and characters of a quote.
MOST_LINES, MOST_QUOTE = 200, 200
#: Confidence of facts that a parser found, and of bodies that it guessed.
CONFIDENCE = {"path": 0.95, "query": 0.9, "header": 0.9, "body": 0.9, "response": 0.85, "auth": 0.9, "description": 0.6}
GUESSED_BODY = 0.5
#: Fixed value: below this a body counts as uncertain.
LEAST_BODY = 0.75


def file_lines(text: Column) -> Column:
    """Lines of a text, however they end; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))


def quote(line: Column) -> Column:
    return F.left(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit(MOST_QUOTE))


def citations(spans: DataFrame, files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """spans (file, line_start, line_end as text) with first, last, snippet_sha256 and quote, or with an error, row by row.

    A missing start is 0, a missing end the start.  Errors are looked for in this order: not integers, outside of the root, bad range, too large, no file, past the end."""
    joined = spans.join(files.select(file, file_lines(F.col(text)).alias("_lines")), file, "left")
    given, end = F.trim("line_start").try_cast("int"), F.trim("line_end").try_cast("int")
    first = F.coalesce(given, F.lit(0))
    last = F.coalesce(end, first)
    wrong = (F.col("line_start").isNotNull() & given.isNull()) | (F.col("line_end").isNotNull() & end.isNull())
    error = (
        F.when(wrong, "not integers").when(~is_confined(F.coalesce(file, F.lit(""))), "outside of the root").when((first < 1) | (last < first), "bad range")
        .when(last - first >= MOST_LINES, "too large").when(F.col("_lines").isNull(), "no file").when(last > F.size("_lines"), "past the end")
    )
    cited = F.slice("_lines", F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0)))
    good = error.isNull()
    return joined.select(*spans.columns, F.when(good, first).alias("first"), F.when(good, last).alias("last"), F.when(good, snippet_hash(cited)).alias("snippet_sha256"), F.when(good, quote(F.get(cited, F.lit(0)))).alias("quote"), error.alias("error"))


def located(routes: DataFrame, files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """routes (file, symbol) with line, quote and snippet_sha256 of the first line that holds the symbol; without one, or without a symbol, of the first line.
    A missing or empty file counts as one empty line."""
    none = F.array(F.lit(""))
    lines = files.select(file, file_lines(F.col(text)).alias("_lines"))
    joined = routes.join(lines, file, "left").withColumn("_lines", F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(none))
    at = F.array_position(F.transform("_lines", lambda x: F.contains(x, F.col("symbol"))), F.lit(True)).cast("int")
    joined = joined.withColumn("line", F.when((F.coalesce("symbol", F.lit("")) != "") & (at > 0), at).otherwise(1))
    line = F.get("_lines", F.col("line") - 1)
    return joined.select(*routes.columns, "line", quote(line).alias("quote"), snippet_hash(F.array(line)).alias("snippet_sha256"))


def widened(routes: DataFrame, files: DataFrame, service: str) -> DataFrame:
    """A row for each fact of the parser's routes, with its evidence.

    routes: method, path, file, symbol, from_spec, path_params, query_params, headers, statuses (arrays), low_confidence (null without a body), description."""
    found = located(routes.withColumn("uid", F.concat(F.lit(service + ":"), F.upper("method"), F.lit(":"), normalize_path(F.col("path")))), files)
    several = {"path": "path_params", "query": "query_params", "header": "headers", "response": "statuses"}
    fact = lambda kind, name, confidence: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), confidence.alias("confidence"))

    def listed(kind: str, names: str) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: fact(kind, x, F.lit(CONFIDENCE[kind])))

    lists = [listed(kind, names) for kind, names in several.items()]
    body = F.when(F.col("low_confidence").isNotNull(), F.array(fact("body", F.lit(None), F.when(F.col("low_confidence"), GUESSED_BODY).otherwise(CONFIDENCE["body"]))))
    said = F.when(F.coalesce("description", F.lit("")) != "", F.array(fact("description", F.lit(None), F.lit(CONFIDENCE["description"]))))
    auth = F.array(fact("auth", F.lit(None), F.lit(CONFIDENCE["auth"])))
    none = F.filter(auth, lambda x: F.lit(False))
    facts = F.concat(*lists, F.coalesce(body, none), auth, F.coalesce(said, none))
    rows = found.select("uid", F.explode(facts).alias("f"), "file", "line", "snippet_sha256", F.when(F.col("from_spec"), "openapi_verified").otherwise("ast_verified").alias("extraction_method"))
    proven = F.col("kind") != "description"  # a description is no claim on the code
    return rows.select("uid", "f.*", *(F.when(proven, F.col(c)).alias(c) for c in ("file", "line", "snippet_sha256", "extraction_method")))


def narrowed(endpoints: DataFrame) -> DataFrame:
    """endpoints (method, path, description, summary, body_confidence, evidence: array of (file, symbol, extraction_method)) as routes.

    The text is the description, else the summary; the reference is the first evidence's file and symbol; the source is openapi if any evidence is."""
    first = F.get("evidence", F.lit(0))
    symbol = first["symbol"]
    ref = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(first["file"], F.lit("::"), symbol)).otherwise(first["file"])
    spec = F.coalesce(F.exists("evidence", lambda e: e["extraction_method"] == "openapi_verified"), F.lit(False))
    rest = [c for c in endpoints.columns if c not in ("method", "description", "summary", "body_confidence", "evidence")]
    return endpoints.select(F.upper("method").alias("method"), *rest, F.coalesce("description", "summary").alias("docstring"), ref.alias("code_ref"), F.when(spec, "openapi").otherwise("code").alias("source"), (F.col("body_confidence") < LEAST_BODY).alias("low_confidence"))
