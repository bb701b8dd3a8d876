"""Token ids as files of directly addressable codes.

A segment holds the ids of some consecutive documents.  An id is cut into chunks of CHUNK_BITS bits, the lowest first; level 0 has
every id's first chunk, level l the further chunks of the ids that go on.  Each level but the last has a bitmap of the ids that go on and a
rank directory (set bits before each BLOCK bits), which gives a token's place on the next level: any token is read with one look at each
level, and nothing is decoded before it.

Layout of a segment (little-endian): magic, number of documents and of tokens, levels' sizes; document ids and ends; for each level its
chunks, bitmap and directory.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._store import new_path
from ._tokens import encoder, texts

MAGIC = 0x31434144
CHUNK_BITS = (8, 8, 16)
BLOCK = 512
SEGMENT_TOKENS = 1 << 17
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int64)


def pack_segment(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a segment; docs: document ids, sizes: their numbers of tokens, ids: all tokens."""
    parts = [np.asarray(docs, "<i8"), np.cumsum(sizes).astype("<i8")]
    rest, sizes_of_levels = np.asarray(ids, np.uint32), []
    for level, bits in enumerate(CHUNK_BITS):
        sizes_of_levels.append(len(rest))
        parts.append((rest & np.uint32((1 << bits) - 1)).astype("<u2" if bits > 8 else "u1"))
        if level + 1 == len(CHUNK_BITS):
            break
        above = rest >> np.uint32(bits)
        on = above > 0
        bitmap = np.packbits(on, bitorder="little")
        bitmap = np.r_[bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)]
        ones = _POPCOUNT[bitmap].reshape(-1, BLOCK // 8).sum(1)
        parts += [bitmap, np.r_[0, np.cumsum(ones)].astype("<u4")]
        rest = above[on]
    head = np.array([MAGIC, len(docs), len(ids), *sizes_of_levels], "<i8")
    return b"".join(p.tobytes() for p in (head, *parts))


class Segment:
    """Reads a segment in place."""

    def __init__(self, body: bytes):
        head = np.frombuffer(body, "<i8", 3 + len(CHUNK_BITS))
        if head[0] != MAGIC:
            raise ValueError("not a token segment")
        at = head.nbytes
        self.n_docs, self.n_tokens = int(head[1]), int(head[2])

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.docs, self.ends = take("<i8", self.n_docs), take("<i8", self.n_docs)
        self.levels = []
        for level, (bits, n) in enumerate(zip(CHUNK_BITS, head[3:].tolist())):
            chunks = take("<u2" if bits > 8 else "u1", n)
            if level + 1 < len(CHUNK_BITS):
                blocks = -(-n // BLOCK)
                self.levels.append((chunks, take("u1", blocks * BLOCK // 8), take("<u4", blocks + 1)))
            else:
                self.levels.append((chunks, None, None))

    def _rank(self, level: int, i: int) -> int:
        """Ids before the i-th of a level that go on to the next one."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        tail = bitmap[block * BLOCK // 8 : i // 8]
        last = int(bitmap[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[block]) + int(_POPCOUNT[tail].sum()) + int(_POPCOUNT[last])

    def __getitem__(self, i: int) -> int:
        """The i-th token, by one look at each level."""
        value, shift = 0, 0
        for level, bits in enumerate(CHUNK_BITS):
            chunks, bitmap, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if bitmap is None or not int(bitmap[i // 8]) >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + bits
        return value

    def tokens(self, lo: int, hi: int, level: int = 0) -> np.ndarray:
        """The tokens [lo, hi), from the bytes of this range only."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[lo:hi].astype("<u4")
        if bitmap is not None and hi > lo:
            bits = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo]
            on = np.flatnonzero(bits)
            if len(on):
                at = self._rank(level, lo)
                out[on] |= self.tokens(at, at + len(on), level + 1) << np.uint32(CHUNK_BITS[level])
        return out

    def documents(self):
        """(document id, first token, tokens) in file order."""
        lo = 0
        for doc, hi in zip(self.docs.tolist(), self.ends.tolist()):
            yield doc, lo, self.tokens(lo, hi)
            lo = hi


NULL_ID = -(1 << 63)


def _segments(path: str, end_id: int):
    def run(batches):
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        docs, sizes, ids, total = [], [], [], 0

        def flush():
            nonlocal seq, docs, sizes, ids, total
            body = pack_segment(np.array(docs, np.int64), np.array(sizes, np.int64), np.frombuffer(b"".join(ids), "<u4"))
            row = [[part], [seq], [docs[0]], [len(docs)], [total], [body]]
            seq, docs, sizes, ids, total = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "first_doc", "n_docs", "n_tokens", "body"])

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc = batch.column(0).fill_null(NULL_ID).to_pylist()
            for lo, many in texts(batch.column(1)):
                for i, text in enumerate(many, lo):
                    got = enc.ids(text) + end
                    docs.append(doc[i])
                    ids.append(got)
                    sizes.append(len(got) // 4)
                    total += sizes[-1]
                    if total >= SEGMENT_TOKENS:
                        yield flush()
            enc.trim()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1) -> None:
    """Writes the ids of every text, with end_id behind each, in ascending order of ids to segments under path.

    The table is dealt by ranges of ids; each task encodes, packs and writes its range.  Segments are rows of a Parquet table (part, seq,
    first_doc, n_docs, n_tokens, body): they go through Spark's committer to any store, and a lost task is simply written again.

    Null text counts as empty.  Null ids come first.  Rows that repeat an id stay apart, in the order of their texts.  An empty table writes no
    segment.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "doc").sortWithinPartitions("doc", "body")
    ranged.mapInArrow(_segments(tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id), "part int, seq int, first_doc long, n_docs long, n_tokens long, body binary").write.parquet(path)


def _read(offsets: dict):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seg, start = Segment(row["body"]), row["before"] + offsets[row["part"]]
                found = [(None if d == NULL_ID else d, start + lo, len(t), zlib.crc32(t.tobytes()), t.tobytes()) for d, lo, t in seg.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc, start (tokens of all documents before it), n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit) of each document.

    Starts come from running sums within each part, and the parts' totals, one number for each task that wrote."""
    table = spark.read.parquet(path)
    totals = sorted(table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, before = {}, 0
    for part, n in totals:
        offsets[part], before = before, before + n
    sums = table.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("before"))
    placed = table.select("part", "seq", "body").join(sums, ["part", "seq"])
    return placed.mapInArrow(_read(offsets), "doc long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path).select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")
