"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols are its characters, white space written as the mark U+2581; of all adjacent pairs whose joined text is a piece, the one with the best
score goes first (the leftmost of equal ones), until no pair is left.  The agenda of pairs is kept in score order: a heap for long
units, and for short units, by the thousand, one array from which each round takes every unit's best pair at once.  Characters that
end up outside the vocabulary become byte pieces.

No piece of a vocabulary with the needed form joins a character to a following mark, so a text's units (marks and what follows them) are
encoded one by one and kept for the next time.  What is new in an Arrow batch is checked against the sentencepiece library there.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from ._tokens import texts

MARK = "▁"
#: Units kept per worker; when there are more, all are dropped and encoded anew.
KEPT_UNITS = 400_000
#: Longer units go through the heap.
SHORT = 48


class PieceCodec:
    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if any(MARK in p.lstrip(MARK) for p in (self.pieces[i] for i in normal)):
            raise ValueError("the vocabulary has pieces with a mark behind another character")
        self.score = {i: lib.get_score(i) for i in normal}
        # symbols: pieces by their id, and characters of pieces that are no pieces themselves
        self.symbol = {self.pieces[i]: i for i in normal}
        for i in normal:
            for c in self.pieces[i]:
                self.symbol.setdefault(c, n + len(self.symbol))
        self.n_pieces = n
        rank = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = {}
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[self.score[i]], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        chars = sorted((ord(t), s) for t, s in self.symbol.items() if len(t) == 1)
        self.code_points, self.char_symbols = np.array([c for c, _ in chars], np.int64), np.array([s for _, s in chars], np.int64)
        self.raw = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.written = [b"%d," % i for i in range(n)]
        self.known_ids: dict[str, bytes] = {}
        self.known_text: dict[str, bytes] = {}

    # one unit, by a heap
    def _agenda(self, text: str) -> list[int]:
        """Symbols of a text after all merges; an unknown character is -1 - code point."""
        sym = [self.symbol.get(c, -1 - ord(c)) for c in text]
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (found := self.pairs.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        gone = [False] * len(sym)
        while heap:
            _, i, j, a, b, piece = heapq.heappop(heap)
            if gone[i] or gone[j] or sym[i] != a or sym[j] != b or right[i] != j:
                continue
            sym[i], gone[j], right[i] = piece, True, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s, g in zip(sym, gone) if not g]

    # many short units, round by round
    def _look(self, a: np.ndarray, b: np.ndarray):
        """Ranks (or a great number) and merged symbols of pairs."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[k] == key
        return np.where(hit, self.ranks[k], 1 << 30), self.merged[k]

    def _rounds(self, units: list[str]) -> list[list[int]]:
        code = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        k = np.minimum(np.searchsorted(self.code_points, code), len(self.code_points) - 1)
        sym = np.where(self.code_points[k] == code, self.char_symbols[k], -1 - code)
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        out: list = [None] * len(units)
        none = 1 << 30

        def look(at):
            at = at[(at >= 0) & (at < len(sym) - 1)]
            at = at[unit[at] == unit[at + 1]]
            rank[at], merged[at] = self._look(sym[at], sym[at + 1])

        rank, merged = np.full(len(sym), none), np.zeros(len(sym), np.int64)
        look(np.arange(len(sym)))
        while len(sym):
            head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), head)
            open_ = best >> 32 < none
            at = best[open_] & 0xFFFFFFFF
            sym[at] = merged[at]
            rank[at] = none
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            if not open_.all():
                tail = np.r_[head[1:], len(sym)]
                flat = sym.tolist()
                for u, h, t in zip(unit[head[~open_]].tolist(), head[~open_].tolist(), tail[~open_].tolist()):
                    out[u] = flat[h:t]
                stay &= np.repeat(open_, tail - head)
            at = (np.cumsum(stay) - 1)[at]
            sym, unit, rank, merged = sym[stay], unit[stay], rank[stay], merged[stay]
            rank[at] = none
            rank[at[at > 0] - 1] = none
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            look(np.flatnonzero(near))
        return out

    def _ids(self, symbols: list[int]) -> list[int]:
        if min(symbols) >= 0 and max(symbols) < self.n_pieces:
            return symbols
        out = []
        for s in symbols:
            if 0 <= s < self.n_pieces:
                out.append(s)
            else:
                c = chr(-1 - s) if s < 0 else next(t for t, x in self.symbol.items() if x == s)
                out += [self.byte_ids[b] for b in c.encode()]
        return out

    def encode_units(self, units: list[str]) -> list[list[int]]:
        short = [i for i, u in enumerate(units) if len(u) <= SHORT]
        out: list = [None] * len(units)
        for i, s in zip(short, self._rounds([units[i] for i in short])):
            out[i] = self._ids(s)
        for i, u in enumerate(units):
            if out[i] is None:
                out[i] = self._ids(self._agenda(u))
        return out

    def _check(self, units: list[str], ids: list[list[int]]) -> None:
        """Against the library: it puts a mark before each text, which a unit has already or which comes off again with a line's end."""
        units, ids = zip(*[(u, i) for u, i in zip(units, ids) if u != MARK] or [(MARK + "a", self.encode_units([MARK + "a"])[0])])  # of no text the library makes no mark
        said = self.library.encode([u.removeprefix(MARK) for u in units], num_threads=1)
        for u, mine, theirs in zip(units, ids, said):
            if u[:1] != MARK:
                theirs = theirs[1:]
            if mine != theirs:
                raise ValueError(f"the library encodes {u[:60]!r} as {theirs[:40]}, not as {mine[:40]}")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces together as UTF-8, the mark at the start left out."""
        raw = b"".join([self.raw[i] for i in ids])
        if ids and self.pieces[ids[0]].startswith(MARK):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    @staticmethod
    def units(text: str) -> list[str]:
        """Units of a text.  One without a mark or a line's end before it stands for itself behind a mark."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        text = MARK + text.replace(" ", MARK)
        out = []
        for k, line in enumerate(text.split("\n")):
            parts = line.split(MARK)
            if k:
                out.append("\n" + parts[0])
            marks = ""
            for p in parts[1:]:
                marks += MARK
                if p:
                    out.append(marks + p)
                    marks = ""
            if marks:
                out.append(marks)
        return out

    def encode_many(self, many: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: its ids as b"1,2,..." with a comma behind each, and the bytes of its pieces, marks as spaces."""
        lists = [self.units(t) for t in many]
        new = list(set().union(*lists).difference(self.known_ids))
        if new:
            full = [u if u[:1] in ("\n", MARK) else MARK + u for u in new]
            ids = self.encode_units(full)
            self._check(full, ids)
            for u, found in zip(new, ids):
                self.known_ids[u] = b"".join([self.written[i] for i in found])
                self.known_text[u] = b"".join([self.raw[i] for i in found])
        a, b = self.known_ids.__getitem__, self.known_text.__getitem__
        out = [(b"".join(map(a, units)), b"".join(map(b, units))) for units in lists]
        if len(self.known_ids) > KEPT_UNITS:
            self.known_ids.clear()
            self.known_text.clear()
        return out


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec per worker and file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _encoded(path: str):
    def run(batches):
        mine = codec(path)
        for batch in batches:
            for lo, many in texts(batch.column(1)):
                found = mine.encode_many(many)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(many)), pa.array([i[:-1].decode() for i, _ in found], pa.string()), pa.array([i.count(b",") for i, _ in found], pa.int64()), pa.array([t[1:].decode("utf-8", "replace") for _, t in found], pa.string())],
                    ["doc", "ids", "n_tokens", "decoded"],
                )

    return run


def _digests(path: str):
    inner = _encoded(path)

    def run(batches):
        for b in inner(batches):
            sha = [pa.array([hashlib.sha256(t.as_buffer()).hexdigest() if t.is_valid else None for t in b.column(c)], pa.string()) for c in (1, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *sha], ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digests: bool = False) -> DataFrame:
    """One row per row of docs: the id, ids (decimal, joined by commas), n_tokens, decoded; with digests, n_tokens, ids_sha256 and decoded_sha256.

    Ids are those of the sentencepiece library without begin and end ids; decoded is the text of all ids together.

    Null text counts as empty: no ids.  Null ids stay null; repeated rows are encoded alike.  An empty table gives an empty result.  Other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"))
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    if digests:
        out = rows.mapInArrow(_digests(path), "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    else:
        out = rows.mapInArrow(_encoded(path), "doc long, ids string, n_tokens long, decoded string")
    return out.withColumnRenamed("doc", id_col)


def op8_piece_codec(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
