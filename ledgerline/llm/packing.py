"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Documents are encoded once; those longer than a sequence are cut into full pieces and a rest.  Only the histogram of piece lengths, one
number a length, goes to the driver.  There the lengths are placed, longest first: always into the shortest packs that exist, whole
groups of equal packs at once, by updating counts.  Each placement covers consecutive ranks of one length and consecutive
sequences, so a piece finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._store import written
from ._tokens import encoder, texts

SEQUENCE = 4096


def place(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Placements (length, first rank, first sequence, offset), in rank order within a length.

    The heap holds groups of equal packs: (tokens used, first sequence, number).  The shortest packs take the next length first.  Lengths
    fall, so what doesn't fit into the shortest pack fits into none, and new packs are opened."""
    out, packs, opened = [], [], 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and packs[0][0] + length <= size:
                used, first, n = heapq.heappop(packs)
                take = min(n, left)
                if take < n:
                    heapq.heappush(packs, (used, first + take, n - take))
            else:
                used, first, take = 0, opened, left
                opened += left
            out.append((length, rank, first, used))
            if used + length < size:
                heapq.heappush(packs, (used + length, first, take))
            rank, left = rank + take, left - take
    return out


def _pieces(path: str, end_id: int, size: int):
    def run(batches):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for lo, many in texts(batch.column(1)):
                rows = []
                for i, text in enumerate(many, lo):
                    got = enc.ids(text) + end
                    n = len(got) // 4
                    rows += [(doc[i], s, min(size, n - s), zlib.crc32(got[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "start", "length", "ids_crc32", "doc_tokens"])
            enc.trim()

    return run


def _seated(table: dict):
    def run(batches):
        for batch in batches:
            length, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            seat, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                here = length == n
                ranks, first, used = table[int(n)]
                k = np.searchsorted(ranks, rank[here], "right") - 1
                seat[here], offset[here] = first[k] + rank[here] - ranks[k], used[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 3, 1, 4, 5)), pa.array(seat), pa.array(offset)], ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: the id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and end_id.  The pieces of a sequence follow each other without a gap from offset 0 on and are
    at most ``size`` ids together.

    Null text counts as empty: one piece with the end id.  Null ids stay null; rows that repeat an id are packed one by one.  An empty table gives an
    empty result.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    pieces = rows.mapInArrow(_pieces(tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id, size), "doc long, start long, length long, ids_crc32 long, doc_tokens long")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("doc", "start", "ids_crc32"), F.lit(buckets)).alias("bucket")
    pieces = written(pieces.select("*", bucket), "pieces")

    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("length"), "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table: dict[int, list] = {}
    for length, rank, first, used in place(histogram, size):
        table.setdefault(length, []).append((rank, first, used))
    table = {n: tuple(np.array(c, np.int64) for c in zip(*x)) for n, x in table.items()}

    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "start", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(before, ["length", "bucket"]).select("doc", "length", (F.col("before") + F.col("within") - 1).alias("rank"), "start", "ids_crc32", "doc_tokens")
    out = ranked.mapInArrow(_seated(table), "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
