"""Queries of versioned tables: an index that is brought up to date, and guarded writes, each with its DuckDB counterpart."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import plan, versions
from ..operators.stores import shared_folder
from .catalogue import query, table


def _derive(files: DataFrame) -> DataFrame:
    return files.select("path", "sha256", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def _files(docs: DataFrame, text) -> DataFrame:
    return docs.select(F.col("doc_id").alias("path"), text.alias("text")).withColumn("sha256", F.sha2("text", 256))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT doc_id AS path, sha256(text) AS sha256, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM d)
    SELECT 'second' AS state, n.path, sha256(CASE WHEN n.path % 10 = 0 THEN text || ' old' ELSE text END) AS sha256, n_lines, CASE WHEN n.path % 5 = 0 AND n.path % 10 <> 0 THEN 2 ELSE 1 END AS derived_in, 2 AS current FROM n JOIN d ON doc_id = n.path WHERE n.path % 11 <> 0
    UNION ALL SELECT 'damaged', path, sha256, n_lines, CASE WHEN path % 5 = 0 THEN 3 ELSE 1 END, 3 FROM n UNION ALL SELECT 'old format', path, sha256, n_lines, 5, 5 FROM n UNION ALL SELECT 'unchanged', path, sha256, n_lines, 5, 5 FROM n"""
)
def refreshed_index(spark, sf):
    """Three states of the documents: as they were, with some deleted and some of the changed ones, as they are.  The version of the second state is damaged before the third
    is indexed, which so starts from the first; then an index of an older format is published, which is built anew; then nothing changes."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    folder = f"{shared_folder(spark)}/ledgerline/index-{uuid.uuid4().hex}"
    old = F.concat("text", F.lit(" old"))
    i = F.col("doc_id")
    first, second, third = _files(docs, F.when(i % 5 == 0, old).otherwise(F.col("text"))), _files(docs.where("doc_id % 11 <> 0"), F.when(i % 10 == 0, old).otherwise(F.col("text"))), _files(docs, F.col("text"))
    out = []

    def keep(state: str, now: versions.Version) -> None:
        out.append(now.rows.select(F.lit(state).alias("state"), "path", "sha256", "n_lines", "derived_in", F.lit(now.number).alias("current")))

    versions.refreshed_index(first, folder, _derive, form=2)
    now = versions.refreshed_index(second, folder, _derive, form=2)
    keep("second", now)
    fs, at = versions._file_system(spark, folder)
    fs.delete(at("data", now.facts["data"], "_SUCCESS"), False)
    now = versions.refreshed_index(third, folder, _derive, form=2)
    keep("damaged", now)
    versions.publish(now.rows.limit(1), folder, now.last, form=1)
    keep("old format", versions.refreshed_index(third, folder, _derive, form=2))
    keep("unchanged", versions.refreshed_index(third, folder, _derive, form=2))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE c_mktsegment END AS content, CAST(2 AS BIGINT) AS version, 4 AS refused FROM customer")
def guarded_writes(spark, sf):
    """Four plans lose against one: made from the same version by a slower writer, checked in time but written too late, made from other rows, and too old."""
    state = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("content"))
    folder = f"{shared_folder(spark)}/ledgerline/state-{uuid.uuid4().hex}"
    versions.publish(state, folder, 0, form=1)
    base = versions.newest(spark, folder, 1)
    line = lambda rows: rows.withColumn("line", F.concat_ws("|", "key", "content"))
    made = {"base": base.number, "hash": plan.state_hash(line(base.rows), "line").first().hash, "created": time.time()}
    to = lambda name, each: lambda rows: rows.select("key", F.when(F.col("key") % each == 0, name).otherwise(F.col("content")).alias("content"))
    now = lambda v: versions.Version(v.number, v.last, line(v.rows), v.facts)
    refused = 0

    def tried(at: versions.Version, what: dict, change, later: float = 0) -> None:
        nonlocal refused
        try:
            plan.guarded_apply(now(at), what, change, "line", folder, 1, hours=24, at=time.time() + later)
        except versions.Conflict:
            refused += 1

    tried(base, made | {"hash": "of other rows"}, to("third", 5))
    tried(base, made, to("fourth", 7), later=90_000)
    tried(base, made, to("first", 2))
    tried(base, made, to("late", 3))  # it looked before the first one wrote
    tried(versions.newest(spark, folder, 1), made, to("second", 3))
    end = versions.newest(spark, folder, 1)
    return end.rows.select("key", "content", F.lit(end.number).cast("long").alias("version"), F.lit(refused).alias("refused"))
