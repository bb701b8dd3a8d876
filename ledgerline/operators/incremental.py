"""Incremental refresh, retention and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def refresh(before: DataFrame, now: DataFrame, key: str, sha: str) -> DataFrame:
    """key, state: unchanged (same content), modified, added or deleted."""
    b, n = before.select(key, F.col(sha).alias("_b")), now.select(key, F.col(sha).alias("_n"))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_b") == F.col("_n"), "unchanged").otherwise("modified")
    return b.join(n, key, "full").select(key, state.alias("state"))


def to_process(before: DataFrame, now: DataFrame, key: str, sha: str) -> DataFrame:
    """The rows of now that were not there with the same content."""
    return now.join(before.select(key, sha), [key, sha], "left_anti")


def newest(df: DataFrame, by: str, order: list[Column], keep: int) -> DataFrame:
    """The newest rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, in order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def expired(created: Column, now: Column, hours: float) -> Column:
    return (F.unix_micros(now) - F.unix_micros(created)) / F.lit(3.6e9) > hours


def changed_files(commits: DataFrame, changes: DataFrame, last: int | None = None, since: str | None = None) -> DataFrame:
    """file, each once: what the last commits touched, or all commits since a date or after one of the commits; without either, what isn't in a commit yet.

    commits: commit, ord (the newest has the greatest), at; changes: commit (null: not in one yet), file.  last below 1 gives nothing.  A date begins with a digit and holds - or /."""
    if last is None and since is None:
        picked = changes.where("commit is null")
    elif last is not None:
        newest_ = commits.orderBy(F.desc("ord")).limit(max(last, 0)).select("commit")
        picked = changes.join(newest_, "commit", "left_semi")
    else:
        since = since.strip()
        if since[:1].isdigit() and ("-" in since or "/" in since):
            picked = changes.join(commits.where(F.col("at") >= F.lit(since).cast("timestamp")).select("commit"), "commit", "left_semi")
        else:
            anchor = commits.where(F.col("commit") == since).agg(F.max("ord").alias("_anchor"))  # one row
            picked = changes.join(commits.join(F.broadcast(anchor), F.col("ord") > F.col("_anchor")).select("commit"), "commit", "left_semi")
    return picked.where(F.trim("file") != "").select(F.trim("file").alias("file")).distinct()


def snapshot(spark, folder: str, collections: DataFrame, stamp: str, label: str | None = None, keep: int = 20) -> DataFrame:
    """Writes collections (collection_id, collection) as snapshots, then returns the ones to keep: the newest ``keep`` of each collection, by exact id.

    A snapshot's id is its stamp, the collection's id and its label, in which all but letters, digits, - and _ become _.  Snapshots are only added; whoever owns the folder publishes what is kept as its next version."""
    from .stores import prune

    tidy = "" if label is None else "-" + "".join(c if c.isalnum() or c in "-_" else "_" for c in label)
    named = collections.select(F.concat_ws("-", F.lit(stamp), F.col("collection_id").cast("string")).alias("snapshot_id"), F.col("collection_id").cast("string").alias("collection_id"), F.lit(label).cast("string").alias("label"), "collection")
    named.withColumn("snapshot_id", F.concat("snapshot_id", F.lit(tidy))).write.mode("append").parquet(folder)
    return prune(spark.read.parquet(folder), keep)
