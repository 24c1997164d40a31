"""Packing whole documents into fixed-length sequences: along a space-filling curve, or best fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm.encoder import shared_encoder
from gridwise.shared import stored, with_running_total

#: The id that ends each document.
END_ID = 1
#: Buckets of the hashed document vectors, dimensions of their projection, and bits of each dimension on the curve.
BUCKETS, DIMENSIONS, BITS = 256, 4, 12
SEED = 20177


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of non-negative integers (under 2**bits) on the Hilbert curve that fills the cube.

    Gray-code form of the curve: from the highest bit down, each axis either inverts or swaps the lower bits of
    the first axis, then the axes are Gray-coded together and their bits interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class CurveOrder:
    """Hashed, normalised token counts of a document, projected to a few dimensions and placed on the curve."""

    def __init__(self, n_ids: int, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.bucket = r.integers(0, buckets, n_ids)
        self.sign = r.choice([-1.0, 1.0], n_ids)
        self.projection = np.linalg.qr(r.standard_normal((buckets, dimensions)))[0]
        self.buckets, self.bits = buckets, bits
        # a projected unit vector has entries of about 1/sqrt(buckets); four of those each way fill the cube
        self.scale = np.sqrt(buckets) / 4

    def vector(self, ids: np.ndarray) -> np.ndarray:
        v = np.bincount(self.bucket[ids], weights=self.sign[ids], minlength=self.buckets)
        return v / (np.linalg.norm(v) or 1.0)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        cells = 1 << self.bits
        p = np.clip((vectors @ self.projection * self.scale + 1) / 2, 0, 1)
        return hilbert_key(np.minimum((p * cells).astype(np.int64), cells - 1), self.bits)


def encoded(docs: DataFrame, end_id: int | None, curve: bool) -> DataFrame:
    """doc_id, doc_tokens, ids (little-endian 16-bit if the vocabulary allows, else 32-bit) and, if asked for,
    the place on the curve, for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder()
        kind = "<u2" if encoder.n_ids <= 1 << 16 else "<u4"
        order = CurveOrder(encoder.n_ids) if curve else None
        end = np.asarray([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.concatenate([encoder.encode(text), end]) for text in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())]
                if order:
                    columns.append(pa.array(order.keys(np.stack([order.vector(x) for x in ids])), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_tokens", "ids", "place"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, doc_tokens long, ids binary" + ", place long" * curve)


def as_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def last_cuts(total: int, length: int) -> list[int]:
    """Where the tokens after the last full sequence are cut: into sequences of falling powers of two."""
    at, cuts = total // length * length, []
    for power in range(length.bit_length(), -1, -1):
        if (total - at) >> power & 1:
            at += 1 << power
            cuts.append(at)
    return cuts


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_along_curve(docs: DataFrame, length: int = 2048, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """Packs all documents, each followed by `end_id`, into sequences of `length` ids without any padding.

    Documents are laid end to end in the order of a Hilbert key of their hashed vectors (ties by doc_id), and the
    line is cut every `length` ids; what is left after the last full sequence becomes sequences of falling powers of
    two.  One row for each piece; with `keep_ids` also its ids as little-endian 32-bit `ids`.

    Null and empty texts hold the end id alone (without end id: no piece).  Rows with a null or repeated doc_id are
    packed each for itself; equal texts lie beside each other.  An empty table gives no rows.  Other columns are not read.

    Texts are encoded once: the ids wait in a table of the shared folder while narrow rows are sorted by range and
    summed, and meet their place in one shuffle.
    """
    tokens = stored(encoded(docs, end_id, curve=True).withColumn("row_id", F.monotonically_increasing_id()), "pack-ids")
    narrow = tokens.select("row_id", "place", F.col("doc_id").alias("by_id"), "doc_tokens")
    placed, total = with_running_total(narrow, ["place", "by_id", "row_id"], "doc_tokens", "at", "pack-order")
    cuts = last_cuts(total, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.asarray(cuts, dtype=np.int64)
        full = total // length
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, n, raw, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = as_ids(raw, n)
                inside = np.concatenate([np.arange(at // length + 1, (at + n - 1) // length + 1) * length, tail[(tail > at) & (tail < at + n)]])
                edges = np.unique(np.concatenate([[at], inside[inside <= at + n], [at + n]]))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    sequence, first = a // length, a // length * length
                    if sequence >= full:  # beyond the last full sequence
                        k = int(np.searchsorted(tail, a, side="right"))
                        sequence, first = full + k, cuts[k - 1] if k else full * length
                    piece = ids[a - at : b - at].tobytes()
                    rows.append((doc_id, a - at, b - a, zlib.crc32(piece), n, sequence, a - first, piece)[: 7 + keep_ids])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + keep_ids]
            kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    joined = tokens.select("row_id", "doc_id", "doc_tokens", "ids").join(placed.select("row_id", "at").hint("shuffle_hash"), "row_id")
    return joined.filter("doc_tokens > 0").select("doc_id", "doc_tokens", "ids", "at").mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


class OpenBins:
    """Open sequences by room left, with a segment tree over the room: the smallest room that holds a piece is
    found by walking down and up the tree."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, bin_id: int, step: int = 1) -> None:
        if step > 0:
            self.bins[room].append(bin_id)
        i = room + self.size
        while i:
            self.count[i] += step
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a bin with the smallest room of at least `least`; its room and id."""
        i = least + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        bin_id = self.bins[room].pop()
        self.add(room, bin_id, -1)
        return room, bin_id


def best_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size up to `length`, placed from the largest down into the fullest bin that holds it."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    bins, used = OpenBins(length), 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = bins.take(sizes[i])
        room, bin_id = found or (length, used)
        used += found is None
        out[i] = (bin_id, length - room)
        if room > sizes[i]:
            bins.add(room - sizes[i], bin_id)
    return out


#: Bytes of text that one task packs; tokens are never more than bytes, so a task's memory is bounded.
GROUP_BYTES = 16 << 20
MATRIX = "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, positions binary, doc_id array<long>, start array<long>, ids_crc32 array<long>, doc_tokens array<long>"


def pack_best_fit(docs: DataFrame, length: int = 2048, end_id: int | None = END_ID, group_bytes: int = GROUP_BYTES, matrix: bool = False, pad_id: int = 0) -> DataFrame:
    """Best-fit-decreasing packing of all documents into sequences of at most `length` ids.

    Rows are dealt evenly to as many groups as `group_bytes` of text ask for; each group is packed by itself, so
    that no task grows with the input.  A document longer than `length` is cut into full sequences and a rest; rests
    and short documents are placed from the largest down into the fullest sequence that holds them.

    One row for each piece (columns as in `pack_along_curve`, `sequence_id` unique over all groups but not gapless).  With `matrix`,
    one row for each sequence instead: `ids` padded with `pad_id` to `length`, `cu_seqlens` (0, then the end of each
    segment), and `positions`, which restart at 0 in each segment; ids and positions are little-endian 32-bit.  The arrays `doc_id`,
    `start`, `ids_crc32` and `doc_tokens` have one entry for each segment, so that the piece rows can be read off.

    Null and empty texts hold the end id alone (without end id: no piece); null and repeated doc_ids are packed
    each for itself; an empty table gives no rows; other columns are not read.
    """
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-text_bytes // group_bytes))
    dealt = encoded(docs, end_id, curve=False).withColumn("row_id", F.monotonically_increasing_id()).repartition(groups, "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        whole, rows = 0, []
        for batch in batches:
            for doc_id, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(doc_id, at, min(length, n - at), raw, n) for at in range(0, n, length)]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        places = best_fit_decreasing([r[2] for r in rows], length)
        order = sorted(range(len(rows)), key=places.__getitem__) if matrix else range(len(rows))
        for at in range(0, len(rows), 4096) if not matrix else ():
            out = []
            for (doc_id, start, n, raw, all_n), (b, offset) in zip(rows[at : at + 4096], places[at : at + 4096], strict=True):
                out.append((doc_id, start, n, zlib.crc32(as_ids(raw, all_n)[start : start + n].tobytes()), all_n, base + b, offset))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], names=[f.split()[0] for f in PIECES.split(", ")])
        if matrix:
            by_bin: dict[int, list[int]] = {}
            for i in order:
                by_bin.setdefault(places[i][0], []).append(i)
            bins = list(by_bin.items())
            for at in range(0, len(bins), 256):
                out = []
                for b, members in bins[at : at + 256]:
                    parts = [as_ids(rows[i][3], rows[i][4])[rows[i][1] : rows[i][1] + rows[i][2]] for i in members]
                    whole = sum(map(len, parts))
                    ids = np.concatenate([*parts, np.full(length - whole, pad_id, "<u4")]).astype("<u4")
                    positions = np.concatenate([*(np.arange(len(p)) for p in parts), np.arange(length - whole)]).astype("<u4")
                    segments = [rows[i][0] for i in members], [rows[i][1] for i in members], [zlib.crc32(p.tobytes()) for p in parts], [rows[i][4] for i in members]
                    out.append((base + b, ids.tobytes(), whole, [0, *np.cumsum([len(p) for p in parts]).tolist()], positions.tobytes(), *segments))
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary()] + [pa.list_(pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in MATRIX.split(", ")])

    return dealt.select("doc_id", "doc_tokens", "ids").mapInArrow(run, MATRIX if matrix else PIECES)
