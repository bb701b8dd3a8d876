"""Tables as numbered versions in a shared folder: the newest complete one is read, the next one is claimed by whoever creates its entry first.

``folder/data/<id>`` holds the rows of a version, ``folder/log/<number>.json`` says which data it is, in which format.  Data are written first; a version is
there once its entry is, and entries are created without overwriting, so of two writers that start from one version one succeeds and the other gets Conflict.  That
is atomic where the store's create is (HDFS, object stores with conditional writes).  Whoever reads finds the last entry that is whole and whose data are."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .stores import refreshed


class Conflict(RuntimeError):
    """Another writer was first, or the state is no longer the one that a change was planned on."""


@dataclass
class Version:
    """number: of the newest complete version, 0 if there is none.  last: the highest number that an entry claims, complete or not.  rows: None if there is none, or one of another format."""

    number: int
    last: int
    rows: DataFrame | None
    facts: dict


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder.rstrip("/"), *parts]))


def _entries(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of all entries, the highest first: one name a version, no rows."""
    fs, at = _file_system(spark, folder)
    if not fs.exists(at("log")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at("log"))]
    return sorted((int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()), reverse=True)


def _entry(spark: SparkSession, folder: str, number: int) -> dict | None:
    """What an entry says; None for one that was cut off or is no object."""
    fs, at = _file_system(spark, folder)
    stream = fs.open(at("log", f"{number:020d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and isinstance(found.get("data"), str) else None


def newest(spark: SparkSession, folder: str, form: int) -> Version:
    """The newest complete version: entries that are damaged, or whose data were not written to the end, are passed over; one of another format has no rows."""
    fs, at = _file_system(spark, folder)
    numbers = _entries(spark, folder)
    for number in numbers:
        entry = _entry(spark, folder, number)
        if entry is not None and fs.exists(at("data", entry["data"], "_SUCCESS")):
            rows = spark.read.parquet(str(at("data", entry["data"]).toString())) if entry.get("form") == form else None
            return Version(number, numbers[0], rows, entry)
    return Version(0, numbers[0] if numbers else 0, None, {})


def publish(rows: DataFrame, folder: str, base: int, form: int, **facts) -> int:
    """Writes rows as version base + 1 and returns its number; Conflict if that number is taken."""
    spark = rows.sparkSession
    fs, at = _file_system(spark, folder)
    name = uuid.uuid4().hex
    rows.write.parquet(at("data", name).toString())
    body = json.dumps({"data": name, "form": form, **facts}).encode()
    fs.mkdirs(at("log"))
    entry = at("log", f"{base + 1:020d}.json")
    try:
        if fs.exists(entry):
            raise Conflict(f"version {base + 1} is taken")
        try:
            stream = fs.create(entry, False)
        except Exception as e:  # py4j wraps what the store throws
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} is taken") from None
            raise
    except Conflict:
        fs.delete(at("data", name), True)
        raise
    stream.write(bytearray(body))
    stream.close()
    return base + 1


def refreshed_index(files: DataFrame, folder: str, derive, form: int, key: str = "path", sha: str = "sha256") -> Version:
    """The index of files (key, sha), brought up to date: rows of unchanged files come from the newest complete version, others are derived, those of deleted files
    drop out.  Column ``derived_in`` is the version that derived a row.  Without changes nothing is written; without a version of this format all rows are derived."""
    spark = files.sparkSession
    now = newest(spark, folder, form)
    stamped = lambda rows: derive(rows).withColumn("derived_in", F.lit(now.last + 1).cast("long"))
    if now.rows is not None:
        known = now.rows.select(key, F.col(sha).alias("_before")).distinct()
        changes = files.select(key, F.col(sha).alias("_now")).join(known, key, "full").where(~F.col("_now").eqNullSafe(F.col("_before")))
        if changes.isEmpty():
            return now
    publish(refreshed(files, now.rows, stamped, key, sha), folder, now.last, form)
    return newest(spark, folder, form)
