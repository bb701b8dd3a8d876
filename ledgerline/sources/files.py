"""Trees of files as tables, and versioned tables as sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Languages by suffix; others are corpus files with an empty language.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "kt": "kotlin", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "rs": "rust", "scala": "scala"}
CORPUS = ("http", "rest", "json", "yaml", "yml")
#: Folders that hold no source of the project.
IGNORED = (".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build", "site", "postman", "target", "vendor", ".next", ".nuxt", "coverage", ".tox")
MAX_FILE_BYTES = 1_000_000


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, language, size, sha256, text of the code and corpus files under root, up to MAX_FILE_BYTES, without ignored and dot folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.coalesce(*[F.when(suffix == s, F.lit(v)) for s, v in LANGUAGES.items()], F.lit(""))
    inside = F.substring_index("path", root.rstrip("/").split(":")[-1], -1)
    skip = inside.rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED) + r"|\.[^/]*)/")
    kept = raw.where((F.col("length") <= MAX_FILE_BYTES) & suffix.isin(*LANGUAGES, *CORPUS) & ~skip)
    return kept.select(F.ltrim(inside, F.lit("/")).alias("path"), language.alias("language"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.decode("content", "utf-8").alias("text"))


def only(files: DataFrame, paths: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The files that the list (path) names, once each, . and .. and double slashes in it taken out; with suffixes, only such."""
    from ..functions.paths import relative

    wanted = paths.select(relative(F.lit(""), F.col("path")).alias("path")).distinct()
    found = files.join(wanted, "path", "left_semi").dropDuplicates(["path"])
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)) if suffixes else found


def save_version(df: DataFrame, folder: str) -> str:
    """Writes df as a new version below folder; a version is there once its _SUCCESS is."""
    path = f"{folder.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def append_events(events: DataFrame, folder: str) -> None:
    events.write.mode("append").json(folder)


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Events of the trail; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
