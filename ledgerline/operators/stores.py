"""Tables and documents in a shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F


#: Written tables of more rows than this are dealt().
BROADCAST_ROWS = 50_000
#: Rows that spread() means for one task.
TASK_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; there is no other place that would be safe on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """df, whose joins deal out both sides by key, unless the other side is marked to be broadcast.

    Spark judges a table by the size of its files.  Rows that repeat are packed a hundredfold there, so what it takes for a few MB and sends through the driver may be a GB."""
    return df.hint("merge")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df in as many partitions as that number of rows needs, by keys or else in turn.

    Spark reads files, and joins partitions after a shuffle, by their packed size.  Rows that repeat are packed a hundredfold, so that a table of millions lies in one task; these stay apart."""
    return df.repartition(max(2, -(-rows // TASK_ROWS)), *keys)


def streamed(df: DataFrame) -> DataFrame:
    """df, which joins hold by key while the other side runs past it unsorted: for a side with few rows a key, where the other one may have very many."""
    return df.hint("shuffle_hash")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once below the shared folder and read back; cuts lineage and plan."""
    return written_with(df, name)[0]


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """written(), not yet dealt out, and the number of rows, seen by the write itself."""
    rows, told = _stored(df, name, F.lit(True))
    return rows, told["rows"]


def written_with(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, bool]:
    """written(), and whether any row (for which the condition holds) is there: seen by the write itself, so rounds that end when nothing is left need no job to find out."""
    rows, told = _stored(df, name, F.lit(True) if condition is None else condition)
    return dealt(rows) if told["rows"] > BROADCAST_ROWS else rows, told["n"] > 0


def grown(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, bool]:
    """written_with() for what a round adds to: always dealt(), since a row gets longer with each round, and few long ones may be more than many short ones."""
    rows, told = _stored(df, name, F.lit(True) if condition is None else condition)
    return dealt(rows), told["n"] > 0


def _stored(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, dict]:
    seen = Observation()
    path = f"{shared_folder(df.sparkSession)}/ledgerline/{name}-{uuid.uuid4().hex}"
    df.observe(seen, F.count_if(condition).alias("n"), F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def save_by_content(docs: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """Writes documents under the hash of their content; one that is there already is left as it is.  Returns id and content of all given ones."""
    named = docs.select(F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("id"), F.col(content).alias("content")).dropDuplicates(["id"])
    there = load_documents(docs.sparkSession, folder)
    new = named if there is None else named.join(there.select("id"), "id", "left_anti")
    new.write.mode("append").parquet(folder)
    return named


def load_documents(spark: SparkSession, folder: str) -> DataFrame | None:
    """What save_by_content wrote; None where there is nothing, or nothing that can be read."""
    try:
        return spark.read.schema("id string, content string").parquet(folder)
    except Exception as e:  # the reader's own error classes for missing and damaged tables
        if "PATH_NOT_FOUND" in str(e) or "CANNOT_READ" in str(e):
            return None
        raise


def load_version(spark: SparkSession, folder: str, version: int) -> DataFrame | None:
    """The newest table below folder whose column version is the given one; None if there is none: the caller then rebuilds."""
    docs = load_index(spark, folder)
    if docs is None or docs.where(F.col("version") != version).limit(1).count():
        return None
    return docs


def load_index(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def refreshed(files: DataFrame, before: DataFrame | None, derive, key: str = "path", sha: str = "sha256") -> DataFrame:
    """Derived rows for all files (key, sha): those of unchanged files come from before, the others are derived; deleted files drop out."""
    if before is None:
        return derive(files)
    kept = before.join(files.select(key, sha), [key, sha], "left_semi")
    return kept.unionByName(derive(files.join(before.select(key, sha).distinct(), [key, sha], "left_anti")).select(*before.columns))


def newest_first(snapshots: DataFrame, collection: str | None, limit: int, payload: str) -> DataFrame:
    """At most limit snapshots, the newest first, without their payload."""
    rows = snapshots if collection is None else snapshots.where(F.col("collection_id") == collection)
    return rows.orderBy(F.desc("snapshot_id")).limit(limit).drop(payload)


def last_lines(trail: DataFrame, ordinal: str, line: str, n: int, schema: str) -> DataFrame:
    """The events of the last n lines, in order; blank and damaged lines among them count, but are left out, so there may be fewer."""
    tail = trail.orderBy(F.desc(ordinal)).limit(n).select(ordinal, F.from_json(line, schema, {"mode": "PERMISSIVE"}).alias("e"), F.expr(f"try_parse_json({line}) is not null").alias("_ok"))
    return tail.where("_ok").select(ordinal, "e.*").orderBy(ordinal)


def prune(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest keep snapshots of each collection, by exact id."""
    n = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("snapshot_id")))
    return snapshots.withColumn("_n", n).where(F.col("_n") <= keep).drop("_n")
