"""Quality rules whose cutoffs follow the corpus.

Counts come from whole texts.  For each of a few ratios a quantile sketch is built per language and source, merged per language
and over all: counts of values in buckets whose bounds grow by the factor GROWTH, so that sketches merge by adding counts, give the same result in any
order, and each quantile is off by a relative (GROWTH - 1) / 2 at most.  Sketches merge, so the aggregation combines before its shuffle, however large one source is.

A fence is a centre and a distance.  The centre is the group's median, blended with those of its language and of all rows by a weight that grows with
the group; the distance is a robust spread of its language blended with that of all rows, so that a group's own tail never widens its fence.  Ratios that
most sound rows don't have at all (HABITS: repeated lines and words) take medians and spreads of the rows that have them, by factors instead of differences.
Fences are joined with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import written
from ._text import slices, split_words, window_hashes, run_hashes, _SPACE
from .line_dedup import lines_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A fence lies SPREAD times the distance from the median to the quartile beyond the median, and at least a margin from it: the distance
#: from the median to the FAR quantile over all rows, within the bounds of MARGIN.
QUARTILE, SPREAD, FAR = 0.75, 10.0, 0.99
MARGIN = {"symbol_ratio": (0.02, 0.05), "mean_chars": (1.0, 2.0)}
#: Ratios with an upper fence alone: the median of the values above zero times the FACTOR_POWER-th power of their OUTER quantile over their median.
#: While few values are above zero they say little: the fence is blended with PRIOR, which weighs as much as PRIOR_WEIGHT of them.
HABITS, OUTER, FACTOR_POWER, PRIOR, PRIOR_WEIGHT = ("dup_line_ratio", "repeat_ratio"), 0.9, 2.0, 0.2, 20
#: So many rows of a group weigh as much as the next wider group.
HALF_WEIGHT = 200
GROWTH = 1.01


def _counts(batches):
    for batch in batches:
        for lo, hi, data, bounds in slices(batch.column(1)):
            n = hi - lo
            words = split_words(data, bounds)
            body = data[:-8]
            points = np.r_[0, np.cumsum(((body & 0xC0) != 0x80) & ~_SPACE[body])]
            symbols = np.r_[0, np.cumsum(_SYMBOL[body])]
            starts, ends, first = lines_of(data, bounds)
            solid = np.r_[0, np.cumsum(~_SPACE[body])]
            worded = solid[ends] > solid[starts]
            line_doc = np.repeat(np.arange(n), np.diff(first))[worded]
            line = run_hashes(data, starts[worded], ends[worded])
            order = np.lexsort((line, line_doc))
            same = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
            dup = np.bincount(line_doc[order][1:][same], minlength=n)
            lines = np.bincount(line_doc, minlength=n)
            at, win = window_hashes(words.hashes(), words.doc_end, 3)
            doc = words.doc
            order = np.lexsort((win, doc[at]))
            a, w = at[order], win[order]
            same = (w[1:] == w[:-1]) & (doc[a[1:]] == doc[a[:-1]])
            twice = a[np.r_[False, same] | np.r_[same, False]] if len(a) else a
            cover = np.zeros(len(doc) + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + 3, -1)
            repeat = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
            part = batch.slice(lo, n)
            counts = [np.diff(words.first), points[bounds[1:]] - points[bounds[:-1]], symbols[bounds[1:]] - symbols[bounds[:-1]], lines, dup, repeat]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *(pa.array(c, pa.int64()) for c in counts)], ["doc", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_ratio": F.col("n_repeat_words") / words, "mean_chars": F.col("word_chars") / words}


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc, lang, source and the six counts of each row (n_lines: lines that hold a word); null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    return rows.mapInArrow(_counts, "doc long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def _sketch(sound: DataFrame, ratios: list[str]) -> DataFrame:
    """lang, source, ratio, bucket, n: how many values of each ratio lie in each bucket; bucket null holds zeros."""
    held = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.when(F.col(r) > 0, F.ceil(F.log(r) / F.lit(math.log(GROWTH)))).alias("bucket")) for r in ratios])).alias("s")
    return sound.select("lang", "source", held).groupBy("lang", "source", "s.ratio", "s.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(counts: DataFrame) -> DataFrame:
    """lang, source and for each ratio its lower and upper fence, from sketches over the rows that pass the base rules."""
    ratios = _ratios()
    sound = counts.where(~_base_failed()).select("lang", "source", *(r.alias(n) for n, r in ratios.items()))
    sketch = _sketch(sound, list(ratios))
    places = {r: {"mid": 0.5, "high": OUTER} if r in HABITS else {"low": 1 - QUARTILE, "mid": 0.5, "high": QUARTILE} for r in ratios}
    far = {r: {} if r in HABITS else {"far_low": 1 - FAR, "far_high": FAR} for r in ratios}

    def quantiles(keys: list[str], mark: str, more: dict[str, dict[str, float]] | None = None) -> DataFrame:
        """One row a group: for each ratio its number of values and their quantiles, of HABITS of values above zero; a group's buckets are few, whatever its size."""
        merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n")).where(F.col("bucket").isNotNull() | ~F.col("ratio").isin(*HABITS))
        group = Window.partitionBy(*keys, "ratio")
        ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy(F.asc_nulls_first("bucket"))), "total": F.sum("n").over(group)})
        value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket")) * (2 / (1 + GROWTH)))
        picks = [F.min(F.when((F.col("ratio") == r) & (F.col("upto") >= q * F.col("total")), value)).alias(f"{mark}_{r}_{k}") for r in ratios for k, q in (places[r] | (more or {}).get(r, {})).items()]
        return ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("ratio") == r, F.col("total"))).alias(f"{mark}_{r}_n") for r in ratios), *picks)

    wide = quantiles(["lang"], "wide").withColumnRenamed("lang", "l")
    whole = quantiles([], "whole", far)  # one row
    joined = quantiles(["lang", "source"], "fine").join(wide, F.col("lang").eqNullSafe(F.col("l"))).drop("l").crossJoin(F.broadcast(whole))

    def blend(name: str, value: Callable[[str], Column], *marks: str) -> Column:
        """value over all rows, drawn towards that of each mark's group by its number of values."""
        out = value("whole")
        for mark in marks:
            n = F.coalesce(F.col(f"{mark}_{name}_n"), F.lit(0))
            out = F.when(n == 0, out).otherwise((n * value(mark) + HALF_WEIGHT * out) / (n + HALF_WEIGHT))
        return out

    def pair(name: str) -> list[Column]:
        def at(k: str) -> Callable[[str], Column]:
            return lambda mark: F.col(f"{mark}_{name}_{k}")

        centre = blend(name, at("mid"), "wide", "fine")
        if name in HABITS:
            factor = blend(name, lambda mark: at("high")(mark) / at("mid")(mark), "wide")
            n = F.coalesce(F.col(f"whole_{name}_n"), F.lit(0))
            seen = F.coalesce(centre * F.pow(factor, F.lit(FACTOR_POWER)), F.lit(0.0))
            return [F.lit(0.0).alias(f"{name}_lo"), ((n * seen + PRIOR_WEIGHT * PRIOR) / (n + PRIOR_WEIGHT)).alias(f"{name}_hi")]
        least, most = map(F.lit, MARGIN[name])
        mid = F.col(f"whole_{name}_mid")
        down, up = (F.greatest(least, F.least(most, d)) for d in (mid - F.col(f"whole_{name}_far_low"), F.col(f"whole_{name}_far_high") - mid))
        below, above = (blend(name, lambda mark: f(at("mid")(mark), mark), "wide") for f in (lambda m, mark: m - at("low")(mark), lambda m, mark: at("high")(mark) - m))
        return [(centre - F.greatest(SPREAD * below, down)).alias(f"{name}_lo"), (centre + F.greatest(SPREAD * above, up)).alias(f"{name}_hi")]

    return joined.select("lang", "source", *(c for n in ratios for c in pair(n)))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than 50 words, or more than half of the words in 3-word windows found twice or more.  kept: base passed, and the
    ratios of symbols, repeated words and characters a word, and of repeated lines among lines that hold a word, lie within the fences of
    the row's language and source.

    Null text counts as empty and fails the base rules; null language or source is a group of its own; null ids stay null; repeated rows are
    judged alike.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    counts = written(quality_counts(docs, id_col, text_col, lang_col, source_col), "counts")
    # written once: every row is judged by the same fences, also if an executor is lost
    limits = written(fences(counts), "fences").withColumnsRenamed({"lang": "l", "source": "s"})
    inside = F.lit(True)
    for name, ratio in _ratios().items():
        inside = inside & F.coalesce(ratio.between(F.col(f"{name}_lo"), F.col(f"{name}_hi")), F.lit(True))
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    kept = ~_base_failed() & inside
    return joined.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"), kept.alias("kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
