"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t.  They are rotated to principal axes and split into blocks of BLOCK
axes; each block gets a share of the squared distance in proportion to the spread it holds.  A linked pair keeps to the share of one block
at least, so each block is range-joined under its own: vectors are cut into bands of the block's first axis, as wide as the
share's radius, and a band meets itself and the next one.  What passes is checked exactly, in double precision; a pair counts in the first
block whose share it keeps to, so nothing is counted twice and no pair leaves its task: tasks return a count and one link to a
local component for each vector.

Bands are packed to pieces of at most about PIECE vectors, and pieces are joined by band and cell: the pieces of a band are dealt over groups of at
most about SIDE, and each two groups meet in a cell of their own.  So a band that holds a third of all vectors becomes many cells, of bounded
memory and work, over all tasks.  Bands with more than one in SHARE of the rows get their pieces by a broadcast of their sizes, so that their vectors
never come together in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._graph import connected_components
from ._skew import SHARE
from ._store import written

BLOCK = 16
PIECE = 512
#: Pieces of a band that a cell has on either side.
SIDE = 16
#: The axes are fitted on at most this many vectors, those with the least hash of their ids.  Results don't depend on them.
AXES_SAMPLE = 4096
_SLACK = 1e-9


def _valid(code: str):
    """Rows with a finite vector other than zero; the vector as bytes."""

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            ok, body = np.zeros(len(batch), bool), []
            for i, x in enumerate(column.to_pylist() if column.null_count or pa.types.is_null(column.type) else column.to_numpy(zero_copy_only=False)):
                v = None if x is None or not len(x) or any(c is None for c in x) else np.asarray(x, np.float64)
                if v is not None and np.isfinite(v).all() and v.any():
                    norm = np.sqrt((v * v).sum())
                    ok[i] = np.isfinite(norm) and norm > 0
                if ok[i]:
                    body.append((v + 0.0).astype(code).tobytes())
            rows = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(body, pa.binary())], ["id", "label", "vec"])

    return run


def _stacked(bodies: list[bytes], code: str) -> np.ndarray:
    """The vectors of equal length in bodies, as rows in double precision."""
    return np.frombuffer(b"".join(bodies), code).astype(np.float64).reshape(len(bodies), -1)


def _fit(sample: list[bytes], dim: int, radius2: float, code: str):
    """(axes as columns, [(first axis, behind the last, share of the squared distance)])."""
    x = _stacked(sample, code) if sample else np.eye(dim)
    x = x / np.sqrt((x * x).sum(1))[:, None]
    spread, axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))
    spread, axes = np.maximum(spread[::-1], 1e-6), axes[:, ::-1]
    cuts = list(range(0, dim, BLOCK)) + [dim]
    held = np.array([spread[a:b].sum() for a, b in zip(cuts, cuts[1:])])
    shares = radius2 * (1 + _SLACK) * held / held.sum() + 1e-12
    return np.ascontiguousarray(axes), list(zip(cuts, cuts[1:], shares.tolist()))


def _rotated(v: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes, one axis after another, so that a vector's figures are the same in any batch."""
    u = v / np.sqrt((v * v).sum(1))[:, None]
    y = np.zeros_like(u)
    for k in range(axes.shape[0]):
        y += u[:, k : k + 1] * axes[k]
    return y


def _banded(models: dict, code: str, wide: bool):
    """A row for each block and band that a vector takes part in: its own, and as a neighbour the one before.  Not wide: the bands alone."""

    def run(batches):
        for batch in batches:
            vec = batch.column(3).to_pylist()
            sizes = np.array([len(b) // np.dtype(code).itemsize for b in vec])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                axes, blocks = models[int(dim)]
                y = _rotated(_stacked([vec[i] for i in rows], code), axes)
                part = batch.take(pa.array(rows))
                n = len(rows)
                for b, (lo, _, share) in enumerate(blocks):
                    band = np.floor(y[:, lo] / (np.sqrt(share) * (1 + 1e-9))).astype(np.int64)
                    for own in (True, False):
                        columns = {"label": part.column(1), "dim": pa.array(np.full(n, dim, np.int32)), "block": pa.array(np.full(n, b, np.int32)), "band": pa.array(band if own else band - 1)}
                        if wide:
                            columns |= {"own": pa.array(np.full(n, own)), "id": part.column(0), "copies": part.column(2), "vec": part.column(3)}
                        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n points over the links a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _linked(models: dict, threshold: float, code: str):
    """For each vector of a pair of pieces: how many it links with here, and the least id of its local component."""

    def pairs(v1, v2, axes, blocks, block, same):
        lo, hi, share = blocks[block]
        n1, n2 = np.sqrt((v1 * v1).sum(1)), np.sqrt((v2 * v2).sum(1))
        u1, u2 = v1 / n1[:, None], v2 / n2[:, None]
        # matrix products, whose rounding may differ from task to task, only rule out what misses a bound by far more than that
        a, b = u1 @ axes[:, lo:hi], u2 @ axes[:, lo:hi]
        one, two = np.c_[a, -(a * a).sum(1) / 2, np.ones(len(a))], np.c_[b, np.ones(len(b)), -(b * b).sum(1) / 2]
        near = one @ two.T >= -(share / 2 + 1e-7)
        if same:
            near = np.triu(near, 1)
        if near.any():
            near &= u1 @ u2.T >= threshold - 1e-7
        i, j = np.nonzero(near)
        y1, y2 = np.zeros_like(v1), np.zeros_like(v2)
        for y, v, rows in ((y1, v1, np.unique(i)), (y2, v2, np.unique(j))):
            y[rows] = _rotated(v[rows], axes)
        for s in range(0, len(i), 1 << 14):
            p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            d = y1[p] - y2[q]
            d *= d
            here = d[:, lo:hi].sum(1) <= share
            for x, y, limit in blocks[:block]:
                here &= d[:, x:y].sum(1) > limit
            p, q = p[here], q[here]
            p_q = (v1[p] * v2[q]).sum(1) / (n1[p] * n2[q]) >= threshold
            yield p[p_q], q[p_q]

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1).to_pylist()[0]
                axes, blocks = models[row["dim"]]
                v1, v2 = _stacked(row["vecs"], code), _stacked(row["vecs2"], code)
                ids = np.array([*row["ids"], *row["ids2"]], np.int64)
                copies = np.array([*row["copies"], *row["copies2"]], np.int64)
                found = list(pairs(v1, v2, axes, blocks, row["block"], row["same"]))
                p = np.concatenate([x for x, _ in found] or [np.zeros(0, int)])
                q = np.concatenate([x for _, x in found] or [np.zeros(0, int)]) + len(v1)
                if not len(p):
                    continue
                if row["same"]:  # both pieces are the same one
                    q = q - len(v1)
                order = np.argsort(ids, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                root = _local_roots(len(ids), place[p], place[q])
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[order][root[place[hit]]])], ["id", "links", "root"])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row of vectors: the id, n_links (other vectors linked directly), component_id (least id reachable), kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine in double precision is at least
    threshold.  Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Equal vectors of one label
    are one node with a number of copies.

    A row with a null id links with nothing and is not kept apart from others: n_links 0, component null, kept null.  Rows that repeat an
    id with the same label and vector are one vector; an id with several vectors is one node of the components, and its n_links is the greatest of theirs.  An empty table gives an empty result.  Other columns are ignored, whatever
    their names.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    code = "<f4" if getattr(vectors.schema[vec_col].dataType, "elementType", None) == T.FloatType() else "<f8"  # floats travel as such
    valid = base.where("id is not null and label is not null and vec is not null").mapInArrow(_valid(code), "id long, label string, vec binary")
    sha = valid.withColumn("key", F.unhex(F.sha2("vec", 256)))
    groups = sha.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    placed = written(sha.join(groups, ["label", "key"]).select("id", "label", "rep", "copies", F.when(F.col("id") == F.col("rep"), F.col("vec")).alias("vec")), "vectors")
    nodes = placed.where("vec is not null").select("id", "label", "copies", "vec").dropDuplicates(["id", "label", "vec"])

    radius2 = 2 - 2 * threshold
    width = np.dtype(code).itemsize
    dims = [r.dim for r in nodes.select((F.length("vec") / width).cast("int").alias("dim")).distinct().collect()]
    models = {d: _fit([bytes(r.vec) for r in nodes.where(F.length("vec") == width * d).select("vec").orderBy(F.xxhash64("id")).limit(AXES_SAMPLE).collect()], d, radius2, code) for d in dims}

    key, narrow = ["label", "dim", "block", "band"], "label string, dim int, block int, band long"
    sizes = written(nodes.mapInArrow(_banded(models, code, False), narrow).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n").alias("n")).first().n or 0
    hot = F.broadcast(sizes.where(F.col("n") * SHARE > total))
    banded = nodes.mapInArrow(_banded(models, code, True), narrow + ", own boolean, id long, copies long, vec binary")
    # neighbours with no vector of the band's own, and the reverse, have nobody to meet but themselves: they stay, as pieces without partners
    sized = lambda rows: rows.withColumn("pieces", F.ceil(F.col("n") / PIECE)).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")))
    pack = lambda rows: sized(rows).groupBy(*key, "own", "pieces", "piece").agg(F.collect_list(F.struct("id", "copies", "vec")).alias("list"))
    packed = pack(banded.join(hot, key)).unionByName(pack(banded.join(hot, key, "left_anti").join(sizes, key)))
    packed = written(packed.select(*key, "own", "pieces", "piece", F.col("list.id").alias("ids"), F.col("list.copies").alias("copies"), F.col("list.vec").alias("vecs")), "pieces")
    groups = F.ceil(F.col("pieces") / SIDE)
    group, all_groups = F.pmod("piece", groups), F.explode(F.sequence(F.lit(0).cast("long"), groups - 1))
    one = packed.where("own").withColumn("left", group).withColumn("right", all_groups).drop("own", "pieces")
    two = packed.withColumn("left", all_groups).withColumn("right", group).drop("pieces").withColumnsRenamed({"own": "own2", "piece": "piece2", "ids": "ids2", "copies": "copies2", "vecs": "vecs2"})
    met = one.join(two, [*key, "left", "right"]).where("not own2 or piece <= piece2").select("dim", "block", (F.col("own2") & (F.col("piece") == F.col("piece2"))).alias("same"), "ids", "copies", "vecs", "ids2", "copies2", "vecs2")
    local = written(met.mapInArrow(_linked(models, threshold, code), "id long, links long, root long"), "links")

    links = local.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    edges = local.select("id", F.col("root").alias("to")).unionByName(placed.select("id", F.col("rep").alias("to")))
    component = connected_components(edges, "id", "to").withColumnRenamed("node", "id")
    counted = placed.select("id", "rep", "copies").distinct().join(links, "rep", "left").groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = base.select("id").join(counted, "id", "left").join(component, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
