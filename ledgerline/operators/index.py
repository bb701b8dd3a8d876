"""Tables of an index as they are stored: in a fixed order, and as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The order of each table.
ORDER = {"symbols": ["file", "line_start"], "imports": ["src", "dst"], "corpus": ["file", "line"], "candidates": ["file", "line"], "services": ["root"]}


def in_order(rows: DataFrame, table: str) -> DataFrame:
    """The rows of one of the tables in its order: a range sort, so the files that a write makes follow each other."""
    return rows.orderBy(*ORDER[table])


def to_documents(rows: DataFrame) -> DataFrame:
    """doc: each row as a JSON object; parts that are null are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("doc"))


def from_documents(docs: DataFrame, schema: str, defaults: dict) -> DataFrame:
    """The rows of JSON objects: parts that the schema doesn't know are left out, those that a document lacks get their default.  What is no object gives no row."""
    parsed = docs.where(F.expr("try_variant_get(try_parse_json(doc), '$', 'map<string,variant>') is not null")).select(F.from_json("doc", schema).alias("r")).select("r.*")
    return parsed.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in parsed.columns])
