"""Jaccard join of word-shingle sets by PartEnum signatures.

Set sizes are cut into bands, a factor BAND wide.  Scheme b finds pairs whose larger set lies in band b: the domain of shingle
hashes is cut into m ranges, and each range into SECOND parts.  A set signs a range once for every subset of all its parts but one: the combined hash of its
shingles in that subset.  Sets r, s with Jaccard similarity >= t differ in at most k = (1-t)/(1+t) * (|r|+|s|) shingles, so if each range costs two of them, they agree but for one shingle on some range, and
there on all parts but that shingle's.

Of its non-empty ranges, in order, a set needs to sign only the first ones: a range in which the sets share no signature costs at least two shingles, or one where the set fills a
single part; once these costs pass k, a shared signature has come before, for either set.  A set whose ranges all together cost no more than k signs all of them and one common mark
besides, so nothing is lost on very small sets.

Signatures meet in one shuffle.  Candidates are checked exactly, first as stars: each holder of a signature against the least id with it.
Only where the holders of a signature end up in different components are the remaining pairs across those components looked at, once for
each least holder.  Before texts are compared, a sketch of SKETCH bits, the parity of the shingles that hash to each, rules out pairs whose
sketches differ in more bits than similar sets can.  That sketch fills up on sets of more than SKETCH / 2 shingles, so those have a wide one as
well, of at least two bits a shingle; the larger of two is folded to the smaller's width.  So large groups of copies cost rows in proportion to
their size, not its square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._graph import connected_components
from ._store import forget, written
from ._text import mix, slices, split_words, window_hashes

BAND = 1.5
#: Parts of a range; subsets leave out one of them.
SECOND = 3
SKETCH = 1024
#: The ids of candidates go to all tasks, to thin the texts before their shuffle, if there are no more than this (a few MB).
MOST_BROADCAST = 300_000
_WORDS = [f"s{i}" for i in range(SKETCH // 64)]
_U = np.uint64


def shingle_sets(data, bounds, width: int):
    """(doc, hash) of each document's distinct shingles, in this order; a text shorter than a shingle is one shingle as a whole."""
    words = split_words(data, bounds)
    h = words.hashes(lower=True)
    at, s = window_hashes(h, words.doc_end, width)
    doc = words.doc[at]
    size = np.diff(words.first)
    for n in range(1, width):
        short = np.flatnonzero(size == n)
        if len(short):
            part = words.first[short]
            total = np.full(len(short), n, _U)
            for j in range(n):
                total = mix(total * _U(31) + h[part + j])
            doc, s = np.r_[doc, short], np.r_[s, total]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[new], s[new]


def _sketches(doc: np.ndarray, s: np.ndarray, rows: int) -> np.ndarray:
    """(rows, SKETCH / 64) words; each shingle turns one bit over."""
    bit = (mix(s ^ _U(0x2545F4914F6CDD1D)) % _U(SKETCH)).astype(np.int64)
    out = np.zeros((rows, SKETCH // 64), np.int64)
    for lo in range(0, rows, 512):
        a, b = np.searchsorted(doc, [lo, lo + 512])
        n = min(512, rows - lo)
        odd = np.bincount((doc[a:b] - lo) * SKETCH + bit[a:b], minlength=n * SKETCH) & 1
        out[lo : lo + n] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(n, -1)
    return out


def _wide_sketches(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> list:
    """The wide sketch of each set of more than SKETCH / 2 shingles, as bytes; None for the others."""
    out, end = [None] * len(n), np.cumsum(n)
    mixed = mix(s ^ _U(0x2545F4914F6CDD1D))
    for i in np.flatnonzero(n > SKETCH // 2):
        bits = 1 << int(2 * n[i] - 1).bit_length()
        odd = np.bincount((mixed[end[i] - n[i] : end[i]] & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return out


def _may_be_alike(percent: int):
    """Drops the pairs whose wide sketches, where both have one, differ in more bits than those of similar sets can."""

    def run(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for i in np.flatnonzero(np.array(batch.column(3).is_valid()) & np.array(batch.column(5).is_valid())):
                one, two = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (3, 5))
                if len(one) > len(two):
                    one, two = two, one
                folded = np.bitwise_xor.reduce(two.reshape(-1, len(one)), axis=0)
                differ = int(np.bitwise_count(one ^ folded).sum())
                keep[i] = differ * (100 + percent) <= (100 - percent) * (batch.column(2)[i].as_py() + batch.column(4)[i].as_py())
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _sets(width: int):
    """Of each row: its id, the size of its set, two hashes of the set, its sketch and its wide sketch."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1)):
                doc, s = shingle_sets(data, bounds, width)
                n = np.bincount(doc, minlength=hi - lo)
                h1, h2 = np.zeros(hi - lo, _U), np.zeros(hi - lo, _U)
                np.add.at(h1, doc, mix(s))
                np.add.at(h2, doc, mix(s ^ _U(0x5851F42D4C957F2D)))
                sketch = _sketches(doc, s, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T), pa.array(_wide_sketches(doc, s, n), pa.binary())], ["doc", "n", "h1", "h2", *_WORDS, "wide"])

    return run


class Bands:
    """The size bands and their schemes for similarity >= percent / 100."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        tops, lo = [], 1
        while lo <= max(most, 1):
            tops.append(max(lo, math.floor(lo * BAND)))
            lo = tops[-1] + 1
        self.tops = np.array(tops)
        k = self.differ(2 * self.tops)
        self.ranges = np.maximum(np.ceil(0.6 * (k + 1)).astype(np.int64) + 2, np.minimum(4 * self.tops, 64))

    def differ(self, both):
        """The most shingles in which two similar sets of these sizes together can differ."""
        return (100 - self.percent) * both // (100 + self.percent)

    def of(self, n):
        return np.searchsorted(self.tops, n)


def signatures(doc, s, rows: int, bands: Bands):
    """(doc, signature) of all sets."""
    n = np.bincount(doc, minlength=rows)
    partner = n * 100 // bands.percent
    home = bands.of(n)
    out_doc, out_sig = [], []
    mixed = mix(s + _U(0x632BE59BD9B4E019))
    for above in (0, 1):
        band = home + above
        here = (n > 0) & (band < len(bands.tops))
        if above:
            here &= bands.of(partner) >= band
        band = np.minimum(band, len(bands.tops) - 1)
        m, k = bands.ranges[band], bands.differ(n + np.minimum(bands.tops[band], partner))
        use = here[doc]
        d, x, v = doc[use], s[use], mixed[use]
        if not len(d):
            continue
        part = ((x >> _U(32)) * m[d].astype(_U)) >> _U(32)
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[new, len(d)])
        total = np.add.reduceat(v, new)
        second = ((x & _U(0xFFFFFFFF)) * _U(SECOND)) >> _U(32)
        d, part = d[new], part[new]
        inside = [np.add.reduceat(np.where(second == j, v, _U(0)), new) for j in range(SECOND)]
        held = [np.add.reduceat((second == j).astype(np.int64), new) for j in range(SECOND)]
        cost = 1 + (sum((h > 0).astype(np.int64) for h in held) > 1)
        upto = np.cumsum(cost)
        spent = np.bincount(d, weights=cost, minlength=rows).astype(np.int64)
        before = upto - cost - (np.cumsum(spent) - spent)[d]
        salt = mix(band.astype(_U) + _U(0x1234567))
        take = before <= k[d]
        whole = np.zeros(len(d), bool)  # whether a subset that leaves out nothing is signed already
        for j in range(SECOND):
            here_too = take & (size > held[j]) & ~((held[j] == 0) & whole)
            whole |= held[j] == 0
            out_doc.append(d[here_too])
            out_sig.append(mix((total - inside[j])[here_too] ^ salt[d[here_too]] + part[here_too] * _U(0x9E3779B97F4A7C15)))
        few = np.flatnonzero(here & (spent <= k))
        out_doc.append(few)
        out_sig.append(mix(salt[few] + _U(1)))
    return np.concatenate(out_doc or [np.zeros(0, int)]), np.concatenate(out_sig or [np.zeros(0, _U)])


def _signed(width: int, percent: int):
    def run(batches):
        bands = Bands(percent, 1 << 40)
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1)):
                doc, s = shingle_sets(data, bounds, width)
                d, sig = signatures(doc, s, hi - lo, bands)
                ids = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[d] if len(d) else np.zeros(0, np.int64))], ["sig", "doc"])

    return run


def _checked(width: int, percent: int):
    """Keeps the pairs of texts that are similar: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                sets = []
                for c in (2, 3):
                    docs, hashes = [], []
                    for a, _, data, bounds in slices(part.column(c)):
                        doc, s = shingle_sets(data, bounds, width)
                        docs.append(doc + a)
                        hashes.append(s)
                    sets.append((np.concatenate(docs), np.concatenate(hashes)))
                n = sum(np.bincount(d, minlength=len(part)) for d, _ in sets)
                doc, s = (np.concatenate(x) for x in zip(*sets))
                order = np.lexsort((s, doc))
                doc, s = doc[order], s[order]
                same = (doc[1:] == doc[:-1]) & (s[1:] == s[:-1])
                common = np.bincount(doc[1:][same], minlength=len(part))
                keep[lo : lo + len(part)] = (common > 0) & (100 * common >= percent * (n - common))
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: the id, n_shingles (size of its set of distinct shingles) and component_id.

    Words are runs outside \\x20\\x09-\\x0D, A-Z in lower case; a text with fewer than ``width`` words is one shingle as a whole.  Rows link when
    100 * intersection >= percent * union; component_id is the least id reachable by links, itself included.

    Null or wordless text: n_shingles 0, linked with nothing.  A row with a null id is linked with nothing and has a null component.
    Rows that repeat an id form one node: links of any of them count for all.  An empty table gives an empty result.  Other columns
    are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    sets = written(base.mapInArrow(_sets(width), "doc long, n long, h1 long, h2 long, " + ", ".join(f"{w} long" for w in _WORDS) + ", wide binary"), "sets")
    known = base.where("doc is not null")
    filled = sets.where("doc is not null and n > 0")

    # equal sets: one node each
    equal = filled.groupBy("h1", "h2").agg(F.min("doc").alias("rep"))
    copies = written(filled.join(equal, ["h1", "h2"]).where("doc <> rep").select("doc", "rep").distinct(), "copies")
    # an id with several sets can't stand back for another's; of those it's a copy of, only equality links count
    several = written(filled.groupBy("doc").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("h2").alias("z"), F.max("h2").alias("w")).where("x <> y or z <> w").select("doc"), "several")
    replaced = written(copies.join(several, "doc", "left_anti"), "replaced")

    # holders of each signature that several rows have, and its least holder
    signed = known.mapInArrow(_signed(width, percent), "sig long, doc long")
    key = Window.partitionBy("sig")
    held = signed.withColumns({"hub": F.min("doc").over(key), "far": F.max("doc").over(key)}).where("hub <> far").select("sig", "hub", "doc")
    held = written(held, "held")

    def needed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of documents in pairs if these are few enough to tell all tasks; else all rows."""
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "ids")
        return rows.join(F.broadcast(ids), "doc", "left_semi") if ids.count() <= MOST_BROADCAST else rows

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        texts = needed(known.select("doc", "body"), pairs)
        one = pairs.join(texts.withColumnsRenamed({"doc": "a", "body": "body_a"}), "a")
        two = one.join(texts.withColumnsRenamed({"doc": "b", "body": "body_b"}), "b").select("a", "b", "body_a", "body_b")
        return written(two.mapInArrow(_checked(width, percent), "a long, b long"), name)

    def canonical(pairs: DataFrame) -> DataFrame:
        """Ids of equal sets to the least of them; each pair once, the lesser id first."""
        for c in ("a", "b"):
            pairs = pairs.join(replaced.select(F.col("doc").alias(c), F.col("rep").alias(f"{c}_rep")), c, "left").withColumn(c, F.coalesce(f"{c}_rep", c)).drop(f"{c}_rep")
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    sketched = filled.dropDuplicates(["doc", "h1", "h2"]).select("doc", "n", *_WORDS)
    wide = filled.where("wide is not null").join(several, "doc", "left_anti").dropDuplicates(["doc"]).select("doc", "n", "wide")

    def thinned(pairs: DataFrame, name: str) -> DataFrame:
        """pairs without those that wide sketches rule out; ids with several sets pass."""
        pairs = written(pairs, f"{name}_met")
        some = needed(wide, pairs)
        one, two = (some.withColumnsRenamed({"doc": c, "n": f"{c}_n", "wide": f"{c}_wide"}) for c in ("a", "b"))
        both = pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", "a_n", "a_wide", "b_n", "b_wide")
        return written(both.mapInArrow(_may_be_alike(percent), "a long, b long"), name)

    def alike(a: str, b: str):
        """Whether the sketches a_* and b_* may be those of similar sets."""
        bits = sum((F.bit_count(F.col(f"{a}_{w}").bitwiseXOR(F.col(f"{b}_{w}"))) for w in _WORDS[1:]), F.bit_count(F.col(f"{a}_s0").bitwiseXOR(F.col(f"{b}_s0"))))
        na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bits * (100 + percent) <= (100 - percent) * (na + nb))

    def side(c: str) -> DataFrame:
        return sketched.select(F.col("doc").alias(c), F.col("n").alias(f"{c}_n"), *(F.col(w).alias(f"{c}_{w}") for w in _WORDS))

    exact = copies.select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    stars = canonical(held.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct())
    stars = thinned(stars.join(side("a"), "a").join(side("b"), "b").where(alike("a", "b")).select("a", "b").distinct(), "stars")
    links = exact.unionByName(checked(stars, "links"))
    component = written(connected_components(links, "a", "b"), "component")

    # pairs that no star has joined: holders of one signature in different components, met at the signature's least holder
    placed = held.select("sig", "doc").join(component.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = placed.withColumns({"hub": F.min("doc").over(key), "x": F.min("component").over(key), "y": F.max("component").over(key)}).where("x <> y")
    apart = mixed.select("hub", "doc", "component").distinct()
    reps = replaced.withColumnRenamed("doc", "b")
    apart = apart.withColumnRenamed("doc", "b").join(reps, "b", "left").select("hub", F.coalesce("rep", "b").alias("doc"), "component").distinct()
    apart = written(apart.join(sketched, "doc"), "apart")
    forget(held)
    one, two = (apart.select("hub", F.col("doc").alias(c), F.col("component").alias(f"{c}_c"), F.col("n").alias(f"{c}_n"), *(F.col(w).alias(f"{c}_{w}") for w in _WORDS)) for c in ("a", "b"))
    pairs = one.join(two, (one.hub == two.hub) & (F.col("a_c") < F.col("b_c")) & alike("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = checked(thinned(pairs.join(stars, ["a", "b"], "left_anti"), "rest"), "links")
    forget(apart)
    if not rest.isEmpty():
        component = written(connected_components(links.unionByName(rest), "a", "b"), "component")
    out = sets.select("doc", "n").join(component.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
