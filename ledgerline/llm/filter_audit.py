"""How filters overlap: which documents each order of them removes, and which filter takes what the others would have taken.

Copies are found by a range sort of fingerprint, text and id.  Partitions are bounded by fingerprint, id and row only, so that Spark's sample
of the bounds holds no texts and a large group of copies is dealt over many tasks; within a partition rows are sorted by fingerprint, full text and id, and
each is compared with the one before it.  What a partition can't know of its first fingerprint is settled by the first and last groups of all
partitions.  Failures become one mask a document; counts by part and mask are additive, and every order of the filters follows from at most 32 of them.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ._store import written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_NO_ID = np.iinfo(np.int64).max


def text_failures(text: Column) -> Column:
    """Filters A to D as bits 1, 2, 4 and 8."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return _bits(F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long"), text)


def _bits(words: Column, distinct: Column, text: Column) -> Column:
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


_COPIES = "doc long, part string, mask int, copy boolean, open_at long, fp long, body string, least long"


def _compared(batches):
    """Rows sorted by fp, body and doc, as (doc, part, mask, copy), then one row (open_at, fp, body, least) for each text of the first and last fingerprint.

    copy: a smaller doc with this body lies before, in this partition.  Rows of the first fingerprint that are none have open_at, by which
    the row of their text is found."""
    base = TaskContext.get().partitionId() << 32
    last, texts, runs = None, [], -1  # (fp, body, least) of the run before; texts with an open end, as [open_at, fp, body, least]
    first_fp, done = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, body = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
        doc = pc.fill_null(batch.column(0), _NO_ID).to_numpy(zero_copy_only=False)
        same = np.zeros(len(fp), bool)
        at = np.flatnonzero(fp[1:] == fp[:-1]) + 1
        if len(at):
            same[at] = pc.equal(body.take(pa.array(at)), body.take(pa.array(at - 1))).to_numpy(zero_copy_only=False)
        same[0] = last is not None and last[0] == fp[0] and last[1] == body[0].as_py()
        run = np.cumsum(~same) + runs
        starts = np.r_[0, np.flatnonzero(~same[1:]) + 1]
        least = np.minimum.reduceat(doc, starts)
        if same[0]:
            least[0] = min(least[0], last[2])
        copy = doc > least[run - run[0]]
        copy &= doc != _NO_ID
        first_fp = int(fp[0]) if first_fp is None else first_fp
        open_at = pa.array(base + run, mask=(fp != first_fp) | copy | (doc == _NO_ID))
        yield _rows(batch.column(0), batch.column(1), batch.column(2), pa.array(copy), open_at)
        # texts of the first and of the newest fingerprint; those in between are settled
        for i, s in enumerate(starts):
            if fp[s] != first_fp and fp[s] != fp[-1]:
                continue
            entry = [base + int(run[s]), int(fp[s]), body[int(s)].as_py() if not (same[0] and i == 0) else last[1], int(least[i])]
            if texts and texts[-1][0] == entry[0]:
                texts[-1] = entry
            else:
                if texts and texts[-1][1] != entry[1]:
                    if texts[-1][1] == first_fp:
                        done = texts
                    texts = []
                texts.append(entry)
        if texts and texts[-1][1] != int(fp[-1]):
            raise AssertionError("rows are not sorted")
        runs = int(run[-1])
        last = (int(fp[-1]), texts[-1][2], int(least[-1]))
    edges = done + texts
    if edges:
        n = len(edges)
        gone = lambda kind: pa.nulls(n, kind)
        yield _rows(gone(pa.int64()), gone(pa.string()), gone(pa.int32()), gone(pa.bool_()), *map(pa.array, zip(*edges)))


def _rows(doc, part, mask, copy, open_at, fp=None, body=None, least=None):
    n = len(doc)
    blank = lambda x, kind: pa.nulls(n, kind) if x is None else x.cast(kind)
    return pa.RecordBatch.from_arrays([doc, part, mask, copy, open_at, blank(fp, pa.int64()), blank(body, pa.string()), blank(least, pa.int64())], names=[c.split()[0] for c in _COPIES.split(", ")])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc, part and mask, whose bits 1, 2, 4, 8 and 16 are the failures of A to E.

    Rows of one text are told from each other by their id, which must be smaller for the other to be a copy: rows that repeat an id and text
    fail E together or not at all, and a row without an id neither is a copy nor makes one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    # the row's place deals out rows that repeat an id and text; the bounds' sample runs before any failure is looked for
    dealt = rows.withColumns({"fp": F.xxhash64("body"), "place": F.monotonically_increasing_id()}).repartitionByRange("fp", "doc", "place")
    ordered = dealt.drop("place").sortWithinPartitions("fp", "body", F.asc_nulls_first("doc"))
    masked = ordered.withColumn("mask", text_failures(F.col("body"))).select("doc", "part", "mask", "fp", "body")
    found = written(masked.mapInArrow(_compared, _COPIES), "copies")

    edges = found.where("mask is null")
    over_all = edges.groupBy("fp", "body").agg(F.min("least").alias("first"))
    settled = edges.join(over_all, ["fp", "body"]).select("open_at", "first").dropDuplicates(["open_at"])
    rows = found.where("mask is not null")
    known = rows.where("open_at is null").select("doc", "part", "mask", "copy")
    late = rows.where("open_at is not null").join(settled, "open_at").select("doc", "part", "mask", (F.col("doc") > F.col("first")).alias("copy"))
    return known.unionByName(late).select("doc", "part", (F.col("mask") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))


def _steps() -> str:
    """All orders of the filters, step by step: the filter's bit and the bits of those before it."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            found.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "bit": 1 << f, "before": sum(1 << i for i in order[:k])})
    return json.dumps(found)


def audit(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, filter_order, step and the counts of rows (doc, part, mask): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document is good or toxic if any of its rows in labels has 1 there.  A filter's shapley is what it removes, summed over all orders: a
    document that fails m filters is removed by each of them in 120 / m orders."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = masks.join(marks, "doc", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    every = range(1 << len(FILTERS))
    at = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in every])
    parts = counted.groupBy("part").agg(at("n").alias("n"), at("good").alias("good"), at("toxic").alias("toxic"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = parts.select("*", F.inline(steps))
    masks_all = F.sequence(F.lit(0), F.lit(len(every) - 1))
    bit, before = F.col("bit"), F.col("before")

    def total(counts: str, holds) -> Column:
        return F.aggregate(masks_all, F.lit(0).cast("long"), lambda acc, m: acc + F.when(holds(m), F.get(F.col(counts), m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    orders = 120
    share = F.aggregate(masks_all, F.lit(0).cast("long"), lambda acc, m: acc + F.when(fails(m), F.get(F.col("n"), m) * (F.lit(orders) / F.bit_count(m)).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"), F.get(F.col("n"), bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part (value of part_col; null: empty string), order of the five filters and step, with its counts; see failure_masks() and audit().

    Null text counts as empty: no words, so A fails and B and C don't.  An empty table has no parts, and gives no rows; without labels nothing
    is lost.  Repeated rows count as often as they occur.  Other columns are ignored, whatever their names."""
    return audit(failure_masks(docs, id_col, text_col, part_col), labels, id_col)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
