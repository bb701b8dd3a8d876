"""Whitening of vectors by hierarchical merges of singular value decompositions.

Each partition keeps count, sums, and all singular values and right vectors of its centred rows.  Two such summaries are merged by stacking
their scaled vectors and one row for the difference of their means, and decomposing the stack again: nothing is cut off, so the last summary has the singular values of
all rows.  Merges run as a tree of Spark groups of at most FAN summaries; the driver sees the root alone, of d * d figures.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._store import forget, written

SCALE, COMPONENTS = 256, 4
#: Summaries merged in one task; rows decomposed at once, beside the summary so far.
FAN, ROWS = 8, 2_048
#: Vectors this long at most: a summary takes 8 * d * d bytes, a task of a merge FAN times as much.
MOST_DIMENSIONS = 4_096

_CODES = ("<i2", "<i4", "<i8")


def _lattice(column: pa.Array):
    """(rows, matrix of longs) for each length of the vectors of column; those that are null or hold null or non-finite entries are left out.

    An entry c becomes floor(256 * c); what is beyond a long becomes the nearest one."""
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    entry = flat.is_valid().to_numpy(zero_copy_only=False)
    value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(size, 0))
    bad = np.r_[0, np.cumsum(~(entry & np.isfinite(value)))]
    starts = ends - np.maximum(size, 0)
    sound = (size > 0) & (bad[ends] == bad[starts])
    for d in np.unique(size[sound]):
        if d > MOST_DIMENSIONS:
            raise ValueError(f"a vector of {d} entries; more than {MOST_DIMENSIONS} aren't whitened")
        rows = np.flatnonzero(sound & (size == d))
        c = np.floor(value[starts[rows][:, None] + np.arange(d)] * SCALE)
        x = np.clip(c, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        x[c >= 2.0**63] = np.iinfo(np.int64).max
        yield rows, x


def _packed(batches):
    """(d, code, x) of each sound vector, as little-endian integers of the least width that holds it: equal vectors have equal bytes."""
    for batch in batches:
        for _, x in _lattice(batch.column(0)):
            most = np.maximum(x.max(1), -1 - x.min(1))
            code = np.searchsorted([2**15 - 1, 2**31 - 1], most).astype(np.int32)
            body = [row.astype(_CODES[c]).tobytes() for row, c in zip(x, code)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(code), pa.array(body, pa.binary())], names=["d", "code", "x"])


def _unpacked(batch):
    """(d, matrix of longs) for each length and width of a batch of packed vectors."""
    d, code, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    for kind in set(zip(d.tolist(), code.tolist())):
        rows = np.flatnonzero((d == kind[0]) & (code == kind[1]))
        yield kind[0], np.frombuffer(b"".join(x.take(pa.array(rows)).to_pylist()), _CODES[kind[1]]).reshape(-1, kind[0]).astype(np.int64)


class Summary:
    """n, exact sums, and scaled right vectors W with W'W equal to the rows' centred cross products."""

    def __init__(self, n: int, sums: list[int], scaled: np.ndarray):
        self.n, self.sums, self.scaled = n, sums, scaled

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        n = len(x)
        sums = exact_sums(x)
        return cls(n, sums, _decomposed(_centred(x, n, sums) / n))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # the difference of the means, whose numerators are exact
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        correction = np.sqrt(self.n / n * other.n) * gap
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], _decomposed(np.vstack([self.scaled, other.scaled, correction])))

    def row(self) -> tuple[int, list[str], bytes]:
        np.save(out := io.BytesIO(), self.scaled, allow_pickle=False)
        return self.n, list(map(str, self.sums)), out.getvalue()

    @classmethod
    def from_row(cls, n: int, sums: list[str], scaled: bytes) -> Summary:
        return cls(n, list(map(int, sums)), np.load(io.BytesIO(scaled), allow_pickle=False))


def exact_sums(x: np.ndarray) -> list[int]:
    wide = max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 2**62
    return [int(s) for s in (x.astype(object) if wide else x).sum(0)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: longs if they hold it, else Python's integers; as doubles only in the caller's division."""
    wide = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums)) >= 2**62
    return n * x.astype(object) - np.array(sums, object) if wide else n * x - np.array(sums, np.int64)


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors, all of them: at most as many rows as columns."""
    _, s, v = np.linalg.svd(rows.astype(np.float64), full_matrices=False)
    return s[:, None] * v


_SUMMARY = "d int, place long, n long, sums array<string>, scaled binary"


def _summary_batch(found: dict[int, Summary], place: int) -> pa.RecordBatch:
    rows = [(d, place, *s.row()) for d, s in sorted(found.items())]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _SUMMARY.split(", ")])


def _summaries(batches):
    """One summary of this partition for each length."""
    found: dict[int, Summary] = {}
    for batch in batches:
        for d, x in _unpacked(batch):
            for k in range(0, len(x), ROWS):
                new = Summary.of(x[k : k + ROWS])
                found[d] = found[d].merged(new) if d in found else new
    yield _summary_batch(found, TaskContext.get().partitionId())


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    place = key[1].as_py()
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    whole = Summary.from_row(rows[0]["n"], rows[0]["sums"], rows[0]["scaled"])
    for r in rows[1:]:
        whole = whole.merged(Summary.from_row(r["n"], r["sums"], r["scaled"]))
    return pa.Table.from_batches([_summary_batch({key[0].as_py(): whole}, place)])


def merged_summaries(fit: DataFrame) -> DataFrame:
    """One row a length (d, place, n, sums, scaled): the summary of all rows of fit, merged in a tree."""
    now = written(fit.mapInArrow(_summaries, _SUMMARY), "summaries")
    most = now.agg(F.max("place").alias("m")).first().m or 0
    while most > 0:
        most //= FAN
        after = written(now.groupBy("d", F.expr(f"place div {FAN}").alias("group")).applyInArrow(_merge, _SUMMARY), "summaries")
        forget(now)
        now = after
    return now


class Whitening:
    """The leading components of one summary.  Their sign makes the largest entry positive; components whose eigenvalue is zero in double
    precision have no scale and are left out."""

    def __init__(self, s: Summary, most: int = COMPONENTS):
        _, value, vector = np.linalg.svd(s.scaled, full_matrices=False)
        e = value**2 / s.n
        self.n, self.sums, self.total = s.n, s.sums, float(e.sum())
        there = int((value > value[0] * 1e-13 * max(s.scaled.shape)).sum()) if len(value) and value[0] > 0 else 0
        self.e = e[: min(most, there)]
        v = vector[: len(self.e)]
        self.v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None] if len(v) else v

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - sums, exact; whitened coordinates)."""
        centred = _centred(x, self.n, self.sums)
        return centred, (centred / self.n).astype(np.float64) @ self.v.T / np.sqrt(self.e)


def _moments(models):
    """n, sums and cross products of the whitened rows of a partition, one row for each length."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for d, x in _unpacked(batch):
                w = models[d].project(x)[1]
                one = [len(w), w.sum(0), w.T @ w]
                found[d] = [a + b for a, b in zip(found[d], one)] if d in found else one
        rows = [(d, i, j, float(c[i]), float(c[j]), float(p[i, j])) for d, (n, c, p) in sorted(found.items()) for i in range(len(c)) for j in range(len(c))]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["d", "i", "j", "a", "b", "p"])

    return run


def _squares(centred: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; null where a long doesn't hold it."""
    most = max(abs(int(centred.max())), abs(int(centred.min())))
    if most**2 * centred.shape[1] < 2**63:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(c) ** 2 for c in row) for row in centred)]


def _whitened(models, errors):
    def run(batches):
        for batch in batches:
            for rows, x in _lattice(batch.column(1)):
                m = models[x.shape[1]]
                k = len(m.e)
                for lo in range(0, len(rows), ROWS):
                    centred, w = m.project(x[lo : lo + ROWS])
                    size = len(w)
                    ids = batch.column(0).take(pa.array(np.repeat(rows[lo : lo + ROWS], k)))
                    deviation = [s for s in _squares(centred) for _ in range(k)]
                    arrays = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n)), pa.array(deviation, pa.int64()), pa.array(w.ravel()), pa.array(np.tile(m.e / m.total, size)) if k else pa.array([], pa.float64()), pa.array(np.full(size * k, errors.get(x.shape[1], 0.0)))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each sound vector and each of the first COMPONENTS components: the id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or hold null or non-finite entries, give no rows.  An entry c counts as floor(256 * c), a long (beyond that, the nearest long).  The fit is over distinct
    vectors; covariances have the divisor n.  Vectors of each length are whitened on their own, with components, n and identity_error of their own; those of
    more than MOST_DIMENSIONS entries are an error of the job.  Components whose eigenvalue is zero in double precision give no rows, so a single distinct vector gives none.  deviation is null
    where a long doesn't hold it.

    Repeated rows and null ids are whitened like any other.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    # an aggregate: copies of a vector are combined before the shuffle, however many there are
    fit = written(rows.select("vec").mapInArrow(_packed, "d int, code int, x binary").distinct(), "fit")
    models = {r.d: Whitening(Summary.from_row(r.n, r.sums, r.scaled)) for r in merged_summaries(fit).collect()}
    found = fit.mapInArrow(_moments(models), "d int, i int, j int, a double, b double, p double").groupBy("d", "i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("p").alias("p")).collect()
    errors: dict[int, float] = {}
    for r in found:
        n = models[r.d].n
        errors[r.d] = max(errors.get(r.d, 0.0), abs(r.p / n - (r.a / n) * (r.b / n) - (r.i == r.j)))
    out = rows.mapInArrow(_whitened(models, errors), "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
