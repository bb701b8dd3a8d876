"""Line dedup by content-defined chunks of lines.

A chunk is the least repeat that counts: two neighbouring lines that hold a word, with the blank lines between them.  Each such pair is a chunk, so
chunks overlap, their bounds depend on their own lines only, and every repeated run of lines is the union of its chunks.  Chunks are grouped by
the hashes of their two parts; that no two parts share a hash is checked byte by byte, and chunks whose parts do are grouped by their bytes.
All but the first of equal chunks are removed.  A chunk that a large share of all places holds is dealt over salts where places meet the first one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._skew import salted_join
from ._store import written
from ._text import run_hashes, slices, strings, _SPACE
from .substring_dedup import _lists


def lines_of(data: np.ndarray, bounds: np.ndarray):
    """(starts, ends, first line of each document and the end) of the lines between \\n; an empty text has no line."""
    n = len(data) - 8
    cut = np.flatnonzero(data[:n] == 10)
    filled = bounds[:-1] < bounds[1:]
    doc_starts, doc_ends = bounds[:-1][filled], bounds[1:][filled]
    starts, ends = np.sort(np.r_[doc_starts, cut + 1]), np.sort(np.r_[cut, doc_ends])
    # a \n that ends a document leaves an empty last line, whose start is the next document's too: order keeps them apart
    counts = np.zeros(len(bounds) - 1, np.int64)
    counts[filled] = 1 + np.searchsorted(cut, doc_ends) - np.searchsorted(cut, doc_starts)
    return starts, ends, np.r_[0, np.cumsum(counts)]


def chunks_of(data, bounds, bits: int = 64):
    """(doc, first line, lines, hash of all but the last line, hash of the last line) of each chunk; and the lines."""
    starts, ends, first = lines_of(data, bounds)
    solid = np.r_[0, np.cumsum(~_SPACE[data[:-8]])]
    worded = np.flatnonzero(solid[ends] > solid[starts])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[worded]
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    at, last, doc = worded[pair], worded[pair + 1], doc[pair]
    drop = np.uint64(64 - bits)
    a, b = run_hashes(data, starts[at], ends[last - 1]) >> drop, run_hashes(data, starts[last], ends[last]) >> drop
    return (doc, at - first[doc], last - at + 1, a, b), (starts, ends, first)


def _hashed(bits: int, clash: list[int] | None = None):
    """The chunks; with clash, hashes of several texts, also the bytes of the chunks that have one."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1)):
                (doc, at, n, a, b), (starts, ends, first) = chunks_of(data, bounds, bits)
                ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                a, b = a.view(np.int64), b.view(np.int64)
                columns = {"a": pa.array(a), "b": pa.array(b), "doc": pa.array(ids[doc], pa.int64()), "at": pa.array(at.astype(np.int32)), "n": pa.array(n.astype(np.int32))}
                if clash is not None:
                    raw, here = data.tobytes(), (first[doc] + at).tolist()
                    columns["body"] = pa.array([raw[starts[i] : ends[i + k - 1]] if x else None for i, k, x in zip(here, n.tolist(), (np.isin(a, clash) | np.isin(b, clash)).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _parts(bits: int):
    """Hash and bytes of the parts of all chunks, each place once."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(0)):
                (doc, at, n, a, b), (starts, ends, first) = chunks_of(data, bounds, bits)
                at = first[doc] + at
                last = at + n - 1
                span = np.unique(np.c_[np.r_[starts[at], starts[last]], np.r_[ends[last - 1], ends[last]], np.r_[a, b].view(np.int64)], axis=0)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(span[:, 2]), pa.array([raw[s:e] for s, e in zip(span[:, 0].tolist(), span[:, 1].tolist())], pa.binary())], ["part", "body"])

    return run


def _kept(batches):
    for batch in batches:
        row, (at, n) = _lists(batch.column(2), ["at", "n"])
        for lo, hi, data, bounds in slices(strings(batch.column(1))):
            starts, ends, first = lines_of(data, bounds)
            gone = np.zeros(len(starts) + 1, np.int64)
            here = (row >= lo) & (row < hi)
            doc = row[here] - lo
            np.add.at(gone, np.minimum(first[doc] + at[here], first[doc + 1]), 1)
            np.add.at(gone, np.minimum(first[doc] + at[here] + n[here], first[doc + 1]), -1)
            gone = np.cumsum(gone[:-1]) > 0
            raw, out, removed = data.tobytes(), [], []
            for i in range(hi - lo):
                lines = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                removed.append(int(first[i + 1] - first[i] - len(lines)))
                out.append(b"\n".join([raw[s:e] for s, e in zip(starts[lines].tolist(), ends[lines].tolist())]) if removed[-1] else raw[bounds[i] : bounds[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], ["doc", "n_lines", "n_removed", "kept_text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: the id, n_lines, n_removed and kept_text, its lines without the removed ones, joined by \\n.

    A line is removed if it lies in a run of lines, from a line that holds a word to another one, and an equal run, byte by byte, starts
    earlier: in a document with a smaller id, or earlier in the same one.  Blank lines at the ends of a run stay.

    Null text counts as empty: no lines.  A row with a null id is never compared and keeps its lines.  Rows that repeat an id share its
    decisions.  An empty table gives an empty result.  Other columns are ignored, whatever their names.  hash_bits changes no result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    known = base.where("doc is not null")
    key, fields = ["a", "b"], "a long, b long, doc long, at int, n int"
    parts = known.select("body").mapInArrow(_parts(hash_bits), "part long, body binary").distinct()
    clash = [r.part for r in parts.groupBy("part").count().where("count > 1").select("part").collect()]  # none, but by chance of 64 bits
    if clash:
        key, fields = ["a", "b", "body"], fields + ", body binary"
    chunks = known.mapInArrow(_hashed(hash_bits, clash or None), fields)
    if clash:
        chunks = chunks.withColumn("body", F.coalesce("body", F.lit(b"")))  # no chunk is empty
    chunks = written(chunks, "chunks")
    first = written(chunks.groupBy(key).agg(F.min(F.struct("doc", "at")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1"), "first")
    later = salted_join(chunks, first, key, ["doc", "at"]).where("doc <> f.doc or at <> f.at")
    gone = later.groupBy("doc").agg(F.collect_set(F.struct("at", "n")).alias("list"))
    none = F.lit(None).cast("array<struct<at:int,n:int>>")
    both = known.join(gone, "doc", "left").select("doc", "body", "list").unionByName(base.where("doc is null").select("doc", "body", none.alias("list")))
    return both.mapInArrow(_kept, "doc long, n_lines long, n_removed long, kept_text string").withColumnRenamed("doc", id_col)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
