"""A corpus pipeline of five stages, each written and reread: toxicity, line dedup, near duplicates, substring dedup, packing.

For all stages: null text counts as empty; an empty table gives an empty one; columns beside those of documents are left out, whatever their names.  A row
without an id is scored for toxicity like any other, and passes the stages that compare documents, which know them by id, as it is.  Rows that share
an id but not the text are documents of their own (row_key); rows that repeat id and text alike share one decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm._store import written
from ledgerline.llm.jaccard_join import jaccard_components
from ledgerline.llm.line_dedup import line_dedup
from ledgerline.llm.packing import pack
from ledgerline.llm.substring_dedup import substring_dedup
from ledgerline.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, which is null without an id and else tells id and text; ordered by id.  It is the id where no id has several texts."""
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(-1)).alias("n")).distinct()
    if texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    keys = written(texts.orderBy("doc_id", "h", "n").withColumn("row_key", F.monotonically_increasing_id()), "keys")
    marked = docs.withColumns({"h": F.xxhash64("text"), "n": F.coalesce(F.length("text"), F.lit(-1))})
    return marked.join(keys, ["doc_id", "h", "n"], "left").select(*COLUMNS, "row_key")


def _kept_rows(keyed: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows whose key the verdict holds; rows without an id, which these operators don't judge, stay."""
    return keyed.join(verdict.select("row_key").distinct(), "row_key", "left_semi").unionByName(keyed.where("row_key is null")).select(*COLUMNS)


def _with_text(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows with the texts that the operator kept.  Rows that repeat an id, text, lang and source count once."""
    meta = keyed.where("row_key is not null").select("row_key", "doc_id", "lang", "source").distinct()
    known = meta.join(texts.where("row_key is not null").dropDuplicates(["row_key"]), "row_key")
    out = known.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))
    return out.unionByName(keyed.where("row_key is null").select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier doesn't predict toxic, with or without an id; repeated rows all stay or all go.  Without labels of both classes the
    network stays as it began."""
    found = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("text", "lang", "source", "n_chars"))
    return found.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that come earlier.  Rows that repeat an id, text, language and source count once; a document may become empty, and stays."""
    keyed = _keyed(docs)
    return _with_text(keyed, line_dedup(keyed, "row_key").select("row_key", "kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.  Empty texts are near duplicates of nothing and stay; rows that repeat an id and text stay together."""
    keyed = _keyed(docs)
    return _kept_rows(keyed, jaccard_components(keyed, "row_key").where("row_key = component_id"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that start earlier; the words left are joined by one space.  Rows that repeat an id, text, language and source count once."""
    keyed = _keyed(docs)
    return _with_text(keyed, substring_dedup(keyed, "row_key").select("row_key", "kept_text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; every row is packed, also repeated ones and those without an id."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SQL has no classifier and no hash functions of these kinds; the tests hold run() against the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
