"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of each window of ``min_words`` consecutive words, the SEED-word shingle with the least hash.  A window
determines its anchor, so equal windows have equal anchors, and one anchor owns a run of neighbouring windows.  Documents are
joined on the anchors that occur twice or more; each seed is extended both ways over the words of all windows that it owns; equal
extensions match as a whole, and where an anchor has several extensions, the windows in them are matched one by one.
Overlapping matches are merged to maximal repeats.

A passage in a third of all documents costs one row per occurrence and anchor: first occurrences come from aggregates that
combine before the shuffle, occurrences are never paired with each other, and joins have one row a key on the other side, repeated for
the salts over which the occurrences of hot anchors and extensions are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._skew import salted_join
from ._store import forget, written
from ._text import mix, slices, split_words, strings, window_hashes, _powers

SEED = 5


def _runs(h: np.ndarray, words, width: int):
    """(anchor hash, anchor's word, first window, last window) of each run of windows that share an anchor."""
    at, _ = window_hashes(h, words.doc_end, width)
    if not len(at):
        return (np.zeros(0, np.uint64),) + (at,) * 3
    end = words.doc_end
    s = np.full(len(h), ~np.uint64(0))
    seeds, seed_hash = window_hashes(h, end, SEED)
    s[seeds] = seed_hash
    best, reach, span = np.arange(len(s)), 1, width - SEED + 1
    while reach < span:  # the place of the least of the next `reach` shingles, doubled
        step = min(reach, span - reach)
        a, b = best[:-step], best[step:]
        best = np.where(s[b] < s[a], b, a)
        reach += step
    owner = best[at]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    return s[owner[new]], owner[new], at[new], at[np.r_[new[1:] - 1, len(at) - 1]]


def _extents(h: np.ndarray, first: np.ndarray, last: np.ndarray, seat: np.ndarray, width: int) -> np.ndarray:
    """Hashes of a seed's whole extension: the words from its first window's start to its last window's end, and its seat there."""
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    body = (total[last + width] - total[first]) * down[first]
    return mix(body + mix((seat - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64) + np.uint64(77)))


_SEED_FIELDS = [("anchor", pa.int64()), ("extent", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("n", pa.int16())]


def _seeds(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, bounds in slices(batch.column(1)):
                words = split_words(data, bounds)
                h = words.hashes()
                anchor, seat, first, last = _runs(h, words, width)
                if len(anchor):
                    doc = words.doc[first]
                    cols = [anchor.view(np.int64), _extents(h, first, last, seat, width).view(np.int64), ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False)[doc], (first - words.first[doc]).astype(np.int32), (last - first + 1).astype(np.int16)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _SEED_FIELDS)], [n for n, _ in _SEED_FIELDS])

    return run


def _lists(column: pa.Array, fields: list[str]):
    """(row of each element, the fields of the elements) of a list<struct> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(int)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _windows(width: int):
    """Hashes of the single windows of the extensions that are listed with each text."""

    def run(batches):
        for batch in batches:
            ids, row, (anchor, at, n) = batch.column(0), *_lists(batch.column(2), ["anchor", "at", "n"])
            for lo, hi, data, bounds in slices(batch.column(1)):
                words = split_words(data, bounds)
                place, windows = window_hashes(words.hashes(), words.doc_end, width)
                here = (row >= lo) & (row < hi)
                if not here.any() or not len(place):
                    continue
                doc, size = row[here] - lo, n[here].astype(int)
                start = np.repeat(at[here], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                doc = np.repeat(doc, size)
                k = np.searchsorted(place, words.first[doc] + start)
                cols = [np.repeat(anchor[here], size), windows[k].view(np.int64), ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False)[doc], start]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3].astype(np.int32))], ["anchor", "window", "doc", "at"])

    return run


def _kept(batches):
    """Removes the words in the listed ranges; merges overlapping ranges to maximal ones."""
    for batch in batches:
        ids, column = batch.column(0), strings(batch.column(1))
        row, (a, b) = _lists(batch.column(2), ["a", "b"])
        for lo, hi, data, bounds in slices(column):
            words = split_words(data, bounds)
            gone = np.zeros(len(words.starts) + 1, np.int64)
            here = (row >= lo) & (row < hi)
            doc = row[here] - lo
            np.add.at(gone, np.minimum(words.first[doc] + a[here], words.first[doc + 1]), 1)
            np.add.at(gone, np.minimum(words.first[doc] + b[here], words.first[doc + 1]), -1)
            gone = np.cumsum(gone[:-1]) > 0
            raw, out, spans, removed = data.tobytes(), [], [], []
            edge = np.diff(np.r_[False, gone, False].astype(np.int8))
            on, off = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for i in range(hi - lo):
                f, t = words.first[i], words.first[i + 1]
                keep = np.flatnonzero(~gone[f:t]) + f
                out.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist())]))
                removed.append(int(t - f - len(keep)))
                x, y = on[(on < t) & (off > f)] if removed[-1] else [], off[(on < t) & (off > f)] if removed[-1] else []
                spans.append([{"start": int(max(p, f) - f), "end": int(min(q, t) - f)} for p, q in zip(x, y)])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())],
                ["doc", "n_words", "n_removed", "removed", "kept_text"],
            )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """One row per row of docs: the id, n_words, n_removed, removed (array of word ranges [start, end), maximal repeats merged), kept_text.

    A word is removed if a window of ``min_words`` words over it also starts earlier: in a document with a smaller id, or earlier in the same
    one.  Windows are judged on the input.  kept_text holds the kept words, joined by one space.

    Null text counts as empty: no words, nothing removed.  A row with a null id is never compared and keeps all its words.  Rows
    that repeat an id share its decisions: ranges found for the id hold for each of its rows, cut at the row's end.  An empty table
    gives an empty result.  Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    known = base.where("doc is not null")
    seeds = known.mapInArrow(_seeds(min_words), "anchor long, extent long, doc long, at int, n short")
    repeated = written(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "anchors")
    found = written(salted_join(seeds, repeated, ["anchor"], ["doc", "at"], "left_semi"), "seeds")
    forget(repeated)

    # extensions: all but the first of equal ones are repeats as a whole
    first = written(found.groupBy("anchor", "extent").agg(F.min(F.struct("doc", "at")).alias("f"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c")), "extents")
    again = first.where("c > 1").select("anchor", "extent", "f", "c")
    whole = salted_join(found, again, ["anchor", "extent"], ["doc", "at"]).where("doc <> f.doc or at <> f.at")
    ranges = whole.select("doc", F.col("at").alias("a"), (F.col("at") + F.col("n") + (min_words - 1)).alias("b"))

    # anchors with several extensions: their windows one by one, a copy of each extension
    several = first.groupBy("anchor").count().where("count > 1").select("anchor")
    open_ = first.join(several, "anchor", "left_semi").groupBy(F.col("f.doc").alias("doc")).agg(F.collect_list(F.struct("anchor", F.col("f.at").alias("at"), "n")).alias("list"))
    windows = known.join(open_, "doc").select("doc", "body", "list").mapInArrow(_windows(min_words), "anchor long, window long, doc long, at int")
    earliest = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc", "at")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor", "window", "f")
    single = windows.join(earliest, ["anchor", "window"]).where("doc <> f.doc or at <> f.at")
    ranges = ranges.unionByName(single.select("doc", F.col("at").alias("a"), (F.col("at") + min_words).alias("b")))

    listed = ranges.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("list"))
    none = F.lit(None).cast("array<struct<a:int,b:int>>")
    both = known.join(listed, "doc", "left").select("doc", "body", "list").unionByName(base.where("doc is null").select("doc", "body", none.alias("list")))
    return both.mapInArrow(_kept, "doc long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string").withColumnRenamed("doc", id_col)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
