"""Rows from text: lines, quoted paths, request files, specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """file, line (from 1), text: one row a line."""
    return files.select(F.col(file), F.posexplode(F.split(text, "\n")).alias("_at", "text")).select(file, (F.col("_at") + 1).alias("line"), "text")


def quoted_paths(files: DataFrame, file: str, text: str, pattern: str) -> DataFrame:
    """file, path: what the pattern's group finds in each text."""
    return files.select(F.col(file), F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("path"))


def request_lines(files: DataFrame, file: str, text: str, most: int = 40) -> DataFrame:
    """file, line, method, path of METHOD url lines; scheme, host and {{variables}} are left out; at most ``most`` a file, as the format has it."""
    found = lines(files, file, text).select(file, "line", F.regexp_extract("text", rf"^\s*({'|'.join(METHODS)})\s+(\S+)", 1).alias("method"), F.regexp_extract("text", rf"^\s*({'|'.join(METHODS)})\s+(\S+)", 2).alias("url"))
    path = F.regexp_replace(F.regexp_replace("url", r"^(?:[A-Za-z]+://[^/]+|\{\{[^}]*\}\})", ""), r"\?.*$", "")
    found = found.where("method <> ''").select(file, "line", "method", path.alias("path")).where("path like '/%'")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy("line"))).where(F.col("_n") <= most).drop("_n")


#: Route definitions by shape: a verb called with a path, a verb and "mapping", a general routing word; and the most of a file.
_PATH = r"""["']([A-Za-z0-9_\-{}<>:./]*)["']"""
VERB_CALL = r"(?i)\b(get|post|put|patch|delete)\b\s*\(\s*" + _PATH
VERB_MAPPING = r"""(?i)\b(get|post|put|patch|delete)mapping\b[^\n"']{0,40}""" + _PATH
ROUTING_WORD = r"""(?i)(?:\b(?:route|api_view|re_path|url|path)\b|\w*mapping\b)[^\n"']{0,40}""" + _PATH
MOST_CANDIDATES = 60


def candidate_lines(files: DataFrame, file: str, text: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """file, line, method (empty if unknown), path, quote of lines that look like route definitions, by the first shape that fits; the first ones of each file."""
    t = F.col("text")
    method = F.when(t.rlike(VERB_CALL), F.upper(F.regexp_extract(t, VERB_CALL, 1))).when(t.rlike(VERB_MAPPING), F.upper(F.regexp_extract(t, VERB_MAPPING, 1))).otherwise("")
    path = F.when(t.rlike(VERB_CALL), F.regexp_extract(t, VERB_CALL, 2)).when(t.rlike(VERB_MAPPING), F.regexp_extract(t, VERB_MAPPING, 2)).when(t.rlike(ROUTING_WORD), F.regexp_extract(t, ROUTING_WORD, 1))
    rows = lines(files, file, text).select(file, "line", method.alias("method"), path.alias("path"), F.left(F.trim("text"), F.lit(200)).alias("quote")).where("path is not null")
    rows = rows.withColumn("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(file).orderBy("line"))).where(F.col("_n") <= most).drop("_n")


def spec_routes(specs: DataFrame, file: str, text: str) -> DataFrame:
    """file, method, path, operation of JSON specifications: paths times operations, in Spark's own JSON types; what is no JSON gives none."""
    doc = F.from_json(F.get_json_object(text, "$.paths"), "map<string,map<string,string>>")
    ops = specs.select(F.col(file), F.explode(doc).alias("path", "_ops")).select(file, "path", F.explode("_ops").alias("_m", "operation"))
    return ops.select(file, F.upper("_m").alias("method"), "path", "operation").where(F.col("method").isin(METHODS))
