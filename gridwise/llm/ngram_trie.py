"""Language-model scores from n-gram tries in Elias-Fano form, built and queried by shard.

The corpus is cut into blocks of whole documents.  A block sends its distinct words to word shards and its distinct word
triples, as trees under their middle word, to the shard of that word.  A shard merges the counts of all blocks into a trie, smooths
it by absolute discounting, quantises the probabilities, writes the levels compactly, maps them back into memory and answers every
block by searching them there.  The blocks, which kept their tokens, then sum up their documents.  So each task holds one block
or one shard, the answers are as large as the questions, and everything gathered grows with the corpus.

P(w | u v) = max(c(u, v, w) - d3, 0) / c(u, v) + d3 n(u, v) / c(u, v) * P(w | v), with n different followers of a context;
P(w | v) likewise over P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).  A context never seen leaves the shorter one's chance.  Only
training documents are counted.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm.rows import give_back
from gridwise.shared import shared_folder, stored

#: Tokens of a block, about; entries of one shard, about; added to each count of a word.
BLOCK_TOKENS, SHARD_ENTRIES, ADD = 1_000_000, 1_500_000, 0.1
#: Steps of a quantised probability per factor of ten; code 0 means none, code 1 means one.
STEPS = 4000
#: Hash of the token that ends each text, of the context before its first word, and of what is before that.
END, START, NONE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Distinguishes the second name of a heavy word.
HEAVY_ROOT = 0xE7037ED1A0B428DB
#: Hash bits of a word before another, under that other: two words that agree in them count as one context there.
PREDECESSOR_BITS = 24
#: What is taken off every count above the first level, for the levels after it.  A fixed number: a shard's own counts would make scores depend on
#: the number of shards.
DISCOUNT = 0.75
#: A word with more than so many times a shard's share of all tokens is dealt out over shards.
HEAVY = 1.0


def _pack(x: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane: the high bytes of most numbers here are alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits as unary gaps in a bit vector; about two bits and the logarithm of the
    mean gap for each value."""

    def __init__(self, raw: memoryview | bytes):
        self.n, self.low_bits, high_bytes = struct.unpack_from("<QQQ", raw)
        self.high = np.frombuffer(raw, np.uint8, high_bytes, 24)
        self.low = np.frombuffer(raw, np.uint8, (self.n * self.low_bits + 7) // 8 + 8, 24 + high_bytes)
        self.words = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))  # eight bytes from each byte on
        self._ones = self._runs = None  # directories of the high bits, made when they are first asked for

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n = len(v)
        low_bits = max(0, int(v[-1] // np.uint64(n)).bit_length() - 1) if n else 0
        high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        bits[high] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        low = np.zeros((n * low_bits + 7) // 8 + 8, np.uint8)
        if low_bits:
            planes = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if n <= 1 << 16 else None
            if planes is None:
                parts = [((v[a : a + (1 << 16), None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() for a in range(0, n, 1 << 16)]
                body = np.concatenate([np.packbits(p, bitorder="little") for p in parts])  # 65536 values fill whole bytes
            else:
                body = np.packbits(planes, bitorder="little")
            low[: len(body)] = body
        return struct.pack("<QQQ", n, low_bits, len(packed)) + packed + low.tobytes()

    def size_in_bytes(self) -> int:
        return 24 + len(self.high) + len(self.low)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        out = self.words[byte] >> shift
        if self.low_bits > 57:
            further = np.where(shift > 0, self.low[np.minimum(byte + 8, len(self.low) - 1)], 0).astype(np.uint64)
            out |= further << (np.uint64(64) - np.maximum(shift, np.uint64(1)))
        return out & np.uint64((1 << self.low_bits) - 1)

    def _selected(self, bit: int) -> np.ndarray:
        """Position of each one (or zero) among the high bits, in 32 bits."""
        return np.flatnonzero(np.unpackbits(self.high, bitorder="little") == bit).astype(np.int32)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at these places."""
        if self._ones is None:
            self._ones = self._selected(1)
        high = self._ones[places] - places
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(places)).astype(np.int64)

    def find(self, values: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, -1 where it is not held (or not wanted): its high bits lead to a run of values, in which its
        low bits are searched for."""
        out = np.full(len(values), -1, np.int64)
        ask = np.arange(len(values)) if wanted is None else np.flatnonzero(wanted)
        if not self.n or not len(ask):
            return out
        if self._runs is None:  # where the values of each number of high bits begin; behind the last of them, n
            zeros = self._selected(0)
            self._runs = np.concatenate([[0], np.minimum(zeros - np.arange(len(zeros)), self.n), [self.n, self.n]]).astype(np.int32)
        v = values[ask].astype(np.uint64)
        high = np.minimum(v >> np.uint64(self.low_bits), np.uint64(len(self._runs) - 2)).astype(np.int64)
        left, end = self._runs[high].astype(np.int64), self._runs[high + 1].astype(np.int64)
        some = left < end
        if not some.all():
            ask, v, left, end = ask[some], v[some], left[some], end[some]
        low = v & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(end - left > 1)
        a, b, sought = left[open_], end[open_], low[open_]
        while len(open_):  # the last place whose low bits do not exceed those sought, or the first of the run
            middle = (a + b) >> 1
            further = self._low(middle) > sought
            a, b = np.where(further, a, middle), np.where(further, middle, b)
            wide = b - a > 1
            left[open_[~wide]] = a[~wide]
            open_, a, b, sought = open_[wide], a[wide], b[wide], sought[wide]
        hit = self._low(left) == low
        out[ask[hit]] = left[hit]
        return out

    def values(self) -> np.ndarray:
        """All values, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(np.arange(self.n))


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities; 0 for none."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) * STEPS) + 1
    return np.where(p > 0, np.minimum(code, 65535), 0).astype("<u2")


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) / STEPS), 0.0)


class Trie:
    """Three compact levels under each word: the words that follow it, the words before it, and for each word before it those that
    follow the two.  The last are named by their place among all followers of the word (context-relative), so they are small
    numbers.  Every level is one Elias-Fano sequence, in which a node's number is preceded by its parent's place; probabilities and
    back-off weights lie beside them in 16 bits."""

    LEVELS = ("roots", "pointers", "followers", "before", "triples")

    def __init__(self, raw: memoryview | bytes):
        sizes = struct.unpack_from("<9Q", raw)
        at, views = 72, []
        for s in sizes:
            views.append(memoryview(raw)[at : at + s])
            at += s
        self.roots, self.pointers, self.followers, self.before, self.triples = (EliasFano(v) for v in views[:5])
        self.chance2, self.back2, self.chance3, self.back3 = (np.frombuffer(v, "<u2") for v in views[5:])

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie in a memory-mapped file of this process that is unlinked at once."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))

    def query(self, q: _Nested) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The codes of `nodes` for each triple asked for."""
        chance2, back2, chance3, back3 = self.nodes(q)
        return chance2[q.follower], back2[q.of_before[q.of_triple]], chance3, back3[q.of_triple]

    def nodes(self, q: _Nested) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the nodes asked for: chance of each follower and back-off weight of each root, by one word of context; chance of
        each triple and weight of each word before, by two.  A context that was never seen has the weight one, a word never seen
        after it the chance none."""
        root = self.roots.find(q.roots)
        follower = self.followers.find(_child(root[q.of_follower], q.followers, 32), root[q.of_follower] >= 0)
        before = self.before.find(_child(root[q.of_before], q.before, PREDECESSOR_BITS), root[q.of_before] >= 0)
        own, mine = follower[q.follower], before[q.of_triple]
        both = (own >= 0) & (mine >= 0)
        first = self.pointers.at(np.maximum(root, 0))[q.of_before][q.of_triple] if len(root) and self.roots.n else np.zeros(len(own), np.int64)
        triple = self.triples.find(_child(mine, (own - first).astype(np.uint64), 32), both)
        some = lambda x, at, none: np.where(at >= 0, x[np.maximum(at, 0)], none).astype("<u2") if len(x) else np.full(len(at), none, "<u2")
        return some(self.chance2, follower, 0), some(self.back2, root, 1), some(self.chance3, triple, 0), some(self.back3, before, 1)


def _child(parent: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    return (np.maximum(parent, 0).astype(np.uint64) << np.uint64(bits)) | own.astype(np.uint64)


class _Nested:
    """Triples as a tree: roots; for each root its followers and the words before it; for each of those the followers (by place) and
    counts.  `of_...` name the parent of each entry."""

    def __init__(self, roots, n_followers, followers, n_before, before, n_triples, follower, counts):
        self.roots, self.followers, self.before, self.counts = roots, followers, before, counts
        places = np.arange(len(roots))
        self.of_follower, self.of_before = np.repeat(places, n_followers), np.repeat(places, n_before)
        self.of_triple = np.repeat(np.arange(len(before)), n_triples)
        starts = np.cumsum(n_followers) - n_followers
        self.follower = starts[self.of_before[self.of_triple]] + follower

    @classmethod
    def unpack(cls, row: dict) -> _Nested:
        kinds = {"roots": "<u8", "n_followers": "<u4", "followers": "<u4", "n_before": "<u4", "before": None, "n_triples": "<u4", "follower": "<u4", "counts": "<u4"}
        return cls(*(_from_bytes(row[k], PREDECESSOR_BITS // 8) if kind is None else _unpack(row[k], kind).astype(np.uint64 if k in ("roots", "followers") else np.int64) for k, kind in kinds.items()))


def _from_bytes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


BLOCK = "block long, doc_ids binary, known_ids binary, lengths binary, training binary, words binary, tokens binary"


def blocks_of(docs: DataFrame, training) -> DataFrame:
    """Blocks of whole documents: their ids, numbers of tokens and training flags; the distinct words (hashes, the most frequent first)
    and the tokens as places among those.  `training`: a boolean column over doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, number = _Hashes(), TaskContext.get().partitionId() << 32
        ids, flags, hashes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.asarray([len(h) for h in hashes], np.int64)
            words, tokens, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words, tokens = words[order], place[tokens]
            known = np.asarray([i is not None for i in ids], np.uint8)
            row = [number, _pack(np.asarray([i or 0 for i in ids], "<i8")), _pack(known), _pack(lengths.astype("<i8")), _pack(np.asarray(flags, np.uint8)), _pack(words.astype("<u8")), _pack(tokens.astype("<u4"))]
            names = [f.split()[0] for f in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64()] + [pa.binary()] * 6, strict=True)], names=names)

        for batch in batches:
            for doc_id, flag, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = tokens_of(text)
                h = np.fromiter(map(table.__getitem__, own), np.uint64, len(own))
                hashes.append(np.append(h, np.uint64(END)))
                ids.append(doc_id)
                flags.append(bool(flag))
                held += len(own) + 1
                if held >= BLOCK_TOKENS:
                    yield flush()
                    ids, flags, hashes, held, number = [], [], [], 0, number + 1
                    give_back()
        if ids:
            yield flush()
        table = hashes = None
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def _spread(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Requests:
    """What one block asks, in an order that asking and summing up both derive from the block: its distinct triples (before, word,
    follower), each at the shard of its word.  The triples of a heavy word are asked twice: by pairs, dealt out by follower,
    for the chances after that word alone; and under a second name (HEAVY_ROOT), dealt out by the word before, for those after both."""

    def __init__(self, row: dict, shards: int, heavy: np.ndarray):
        self.lengths, self.training = _unpack(row["lengths"], "<i8"), _unpack(row["training"], np.uint8).astype(bool)
        self.words, tokens = _unpack(row["words"], "<u8"), _unpack(row["tokens"], "<u4")
        n = len(self.words)
        hashes = np.concatenate([self.words, np.asarray([START, NONE], np.uint64)])
        m = n + 2
        first = np.cumsum(self.lengths) - self.lengths
        self.tokens = tokens.astype(np.int64)
        self.before = np.concatenate([[n], self.tokens[:-1]])
        self.before[first] = n
        further = np.concatenate([[n + 1], self.before[:-1]])
        further[first] = n + 1
        token_training = np.repeat(self.training, self.lengths)
        self.is_heavy = np.isin(hashes, heavy)
        hot = self.is_heavy[self.before]
        # two numbers in one, then with the third: a text may have any number of different words
        contexts, context = np.unique(np.concatenate([(self.before + m * hot) * m + further, self.before[hot] * m + n + 1]), return_inverse=True)
        keys, at = np.unique(context * m + np.concatenate([self.tokens, self.tokens[hot]]), return_inverse=True)
        counts = np.bincount(at[np.concatenate([token_training, token_training[hot]])], minlength=len(keys))
        context, succ = np.divmod(keys, m)
        root, pred = np.divmod(contexts[context], m)
        split, word = root >= m, root % m
        where = np.where(split, _mix(_mix(hashes[pred]) + hashes[word]), np.where(self.is_heavy[word], _mix(hashes[succ]), hashes[word]))
        self.shard = _spread(where, shards)
        order = np.argsort(self.shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.by_two = place[at[: len(self.tokens)]]  # the triple that answers for a token by two words of context
        self.by_one = self.by_two.copy()
        self.by_one[hot] = place[at[len(self.tokens) :]]
        self.hashes, self.m = hashes, m
        self.root, self.pred, self.succ, self.counts, self.shard = root[order], pred[order], succ[order], counts[order], self.shard[order]
        self.new_root = np.concatenate([[True], (self.root[1:] != self.root[:-1]) | (self.shard[1:] != self.shard[:-1])])
        self.new_pred = self.new_root | np.concatenate([[True], self.pred[1:] != self.pred[:-1]])
        # of each triple, the places of its root, of its word before and of its follower among those of all shards
        group, place = np.cumsum(self.new_root) - 1, np.int32  # a block holds far fewer than 2**31 triples
        self.pairs, of_pair = np.unique(group * m + self.succ, return_inverse=True)
        self.of_root, self.of_pred, self.of_pair = group.astype(place), (np.cumsum(self.new_pred) - 1).astype(place), of_pair.astype(place)

    def by_shard(self, shards: int) -> Iterator[dict]:
        """The nested triples of each shard that is asked."""
        group, pairs = self.of_root, self.pairs
        first = np.searchsorted(pairs, np.arange(int(group[-1]) + 2) * self.m)
        follower = self.of_pair - first[group]
        roots, preds = np.flatnonzero(self.new_root), np.flatnonzero(self.new_pred)
        root_hash = self.hashes[self.root[roots] % self.m] ^ np.where(self.root[roots] >= self.m, np.uint64(HEAVY_ROOT), np.uint64(0))
        n_before, n_triples = np.bincount(group[preds]), np.diff(np.append(preds, len(self.root)))
        edges = np.searchsorted(self.shard, np.arange(shards + 1))
        r, p = np.searchsorted(roots, edges), np.searchsorted(preds, edges)
        followers = (self.hashes[pairs % self.m] & np.uint64(0xFFFFFFFF)).astype("<u4")
        before = self.hashes[self.pred[preds]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PREDECESSOR_BITS // 8]
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[s], edges[s + 1])
            yield {
                "shard": s, "roots": _pack(root_hash[r[s] : r[s + 1]].astype("<u8")), "n_followers": _pack(np.diff(first[r[s] : r[s + 1] + 1]).astype("<u4")),
                "followers": _pack(followers[first[r[s]] : first[r[s + 1]]]), "n_before": _pack(n_before[r[s] : r[s + 1]].astype("<u4")), "before": before[p[s] : p[s + 1]].tobytes(),
                "n_triples": _pack(n_triples[p[s] : p[s + 1]].astype("<u4")), "follower": _pack(follower[own].astype("<u4")), "counts": _pack(self.counts[own].astype("<u4")),
            }


#: What a block asks a shard.
ASKED = "shard int, block long, roots binary, n_followers binary, followers binary, n_before binary, before binary, n_triples binary, follower binary, counts binary"


def _ask(blocks: DataFrame, shards: int, heavy: np.ndarray) -> DataFrame:
    names = [f.split()[0] for f in ASKED.split(", ")]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                r = _Requests(row, shards, heavy)
                out = [x | {"block": row["block"]} for x in r.by_shard(shards)]
                yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], k) for c, k in zip(names, kinds, strict=True)], names=names)
                row = r = out = None
                give_back()

    return blocks.mapInArrow(run, ASKED)


CODES = ("chance2", "back2", "chance3", "back3")
ANSWERED = "shard int, block long, counts binary, chance2 binary, back2 binary, chance3 binary, back3 binary, words long, tokens long, hot array<long>, mass array<double>"


def _answer(heavy: dict[int, int], discount: float = DISCOUNT):
    """One shard's answers to every block that asked; a row each, and on its first row the shard's sums and what it frees of each heavy
    word's mass.  heavy: hash -> how often training documents go on after that word."""

    def run(table: pa.Table) -> pa.Table:
        n, counts, codes = table.num_rows, [], []
        # one block's tree at a time: they come apart again when their triples have met
        asked = [{c: table.column(c)[i].as_py() for c in table.column_names} for i in range(n)]
        raw, hot, mass, roots, seen = build_trie((_Nested.unpack(x) for x in asked), heavy, discount)
        trie = Trie.mapped(raw)
        for x in asked:
            q = _Nested.unpack(x)
            codes.append([_pack(x) for x in trie.nodes(q)])
            at = trie.roots.find(q.roots)
            counts.append(_pack(np.where(at >= 0, seen[np.maximum(at, 0)], 0).astype("<u8") if len(seen) else np.zeros(len(at), "<u8")))
        # a word goes on as often as it occurs, so roots count words, and the start counts the ends; heavy words are counted already
        light = ~np.isin(roots, np.asarray([*heavy, *(x ^ HEAVY_ROOT for x in heavy)], np.uint64))
        words, tokens = int(light.sum()), int(seen[light].sum())
        rest = [0] * (n - 1)
        answer = pa.table({
            "shard": table.column("shard"), "block": table.column("block"), "counts": pa.array(counts, pa.binary()), **{c: pa.array([x[i] for x in codes], pa.binary()) for i, c in enumerate(CODES)},
            "words": pa.array([words, *rest], pa.int64()), "tokens": pa.array([tokens, *rest], pa.int64()),
            "hot": pa.array([hot, *[None] * (n - 1)], pa.list_(pa.int64())), "mass": pa.array([mass, *[None] * (n - 1)], pa.list_(pa.float64())),
        })
        asked = trie = raw = q = counts = codes = roots = seen = None
        give_back()
        return answer

    return run


def build_trie(trees: Iterator[_Nested], heavy: dict[int, int], discount: float = DISCOUNT) -> tuple[bytes, list[int], list[float], np.ndarray, np.ndarray]:
    """Merges the blocks' counts of a shard into a smoothed, quantised trie, and returns with it what the shard frees of heavy words, and the
    roots and their counts here.
    Only counted (training) triples enter.  A heavy word is divided by its whole count, of which this shard sees a part."""
    parts = []
    for t in trees:
        seen = t.counts > 0
        root = t.of_before[t.of_triple[seen]]
        parts.append((t.roots[root], t.before[t.of_triple[seen]], t.followers[t.follower[seen]], t.counts[seen]))
    root, before, follower, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    roots, root = np.unique(root, return_inverse=True)
    befores, before = np.unique(_child(root, before, PREDECESSOR_BITS), return_inverse=True)
    followers, follower = np.unique(_child(root, follower, 32), return_inverse=True)
    pointers = np.searchsorted(followers, np.arange(len(roots) + 1, dtype=np.uint64) << np.uint64(32))
    triples, at = np.unique(_child(before, (follower - pointers[root]).astype(np.uint64), 32), return_inverse=True)
    summed = lambda x, n: np.bincount(x, weights=c, minlength=n)
    c1, c2, c3, of_before = summed(root, len(roots)), summed(follower, len(followers)), summed(at, len(triples)), summed(before, len(befores))
    d2 = d3 = discount
    up2, up3 = (followers >> np.uint64(32)).astype(np.int64), (triples >> np.uint64(32)).astype(np.int64)
    freed2, freed3 = d2 * np.diff(pointers), d3 * np.bincount(up3, minlength=len(befores))
    hot = np.flatnonzero(np.isin(roots, np.asarray(list(heavy), np.uint64)))
    seen = c1.astype(np.int64)
    c1[hot] = [heavy[x] for x in roots[hot].tolist()]
    levels = (roots, pointers, followers, befores, triples)
    codes = (quantised((c2 - d2) / c1[up2]), quantised(freed2 / c1), quantised((c3 - d3) / of_before[up3]), quantised(freed3 / of_before))
    encoded = [*map(EliasFano.encode, levels), *(x.tobytes() for x in codes)]
    return struct.pack("<9Q", *map(len, encoded)) + b"".join(encoded), roots[hot].view(np.int64).tolist(), (freed2[hot] / c1[hot]).tolist(), roots, seen


def _heavy_words(blocks: DataFrame, shards: int) -> dict[int, int]:
    """Words (hashes) that hold more than HEAVY times a shard's share of all tokens, and how often training documents go on after them.
    Found in the blocks where they hold half of that; so at most 2 * shards / HEAVY words a block and in the end.  START counts
    one for each document."""
    least = HEAVY / shards

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, tokens = _unpack(row["words"], "<u8"), _unpack(row["tokens"], "<u4")
                counts = np.append(np.bincount(tokens, minlength=len(words)), len(_unpack(row["lengths"], "<i8")))
                top = np.flatnonzero(counts >= max(2, least / 2 * len(tokens)))
                values = np.append(words, np.uint64(START))[top].astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(values, 0)), pa.array(np.append(counts[top], 0)), pa.array(np.append(np.zeros(len(top), np.int64), len(tokens)))], names=["word", "n", "tokens"])

    sums = blocks.select("words", "tokens", "lengths").mapInArrow(often, "word long, n long, tokens long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    sums = stored(sums, "heavy")
    tokens = sums.agg(F.sum("tokens")).first()[0] or 0
    found = np.asarray(sorted(r[0] for r in sums.filter(F.col("n") >= max(2, least * tokens)).select("word").collect()), np.int64)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, tokens, lengths = _unpack(row["words"], "<u8").astype(np.uint64), _unpack(row["tokens"], "<u4"), _unpack(row["lengths"], "<i8")
                training = np.repeat(_unpack(row["training"], np.uint8).astype(bool), lengths)
                training[np.cumsum(lengths) - 1] = False  # nothing follows the end
                counts = np.bincount(tokens[training], minlength=len(words))
                hashes = np.append(words, np.uint64(START)).view(np.int64)
                counts = np.append(counts, np.count_nonzero(_unpack(row["training"], np.uint8)))
                mine = np.flatnonzero(np.isin(hashes, found))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[mine]), pa.array(counts[mine].astype(np.int64))], names=["word", "n"])

    if not len(found):
        return {}
    rows = blocks.select("words", "tokens", "lengths", "training").mapInArrow(contexts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r.word).view(np.uint64)): r.n for r in rows}


def _summed(row: dict, words_seen: int, tokens_seen: int, shards: int, totals: dict[int, int], mass: dict[int, float]) -> pa.Table:
    """Scores of a block's documents from its answers; of each heavy word, totals: how often it occurs, mass: what it leaves to words
    that never follow it."""
    heavy = np.asarray(sorted(mass), np.uint64)
    r = _Requests(row, shards, heavy)
    answers = sorted(row["answers"], key=lambda a: a["shard"])
    n = len(r.words)
    whole = np.zeros(r.m)  # the last two are the start, which counts ends, and nothing
    own = r.root[r.new_root]
    first_name = own < r.m
    whole[own[first_name]] = np.concatenate([_unpack(a["counts"], "<u8") for a in answers])[first_name]
    whole[r.is_heavy] = [totals[x] for x in r.hashes[r.is_heavy].tolist()]
    c = np.where(r.words == np.uint64(END), whole[n], whole[:n])
    chance2, back2, chance3, back3 = (probability(np.concatenate([_unpack(a[k], "<u2") for a in answers])) for k in CODES)
    back2 = back2[r.of_root[r.by_one]]
    hot = r.is_heavy[r.before]
    back2[hot] = probability(quantised(np.asarray([mass[x] for x in heavy.tolist()])))[np.searchsorted(heavy, r.hashes[r.before[hot]])] if len(heavy) else 1.0
    p = (c + ADD)[r.tokens] / (tokens_seen + ADD * (words_seen + 1))
    shorter = chance2[r.of_pair[r.by_one]] + back2 * p
    smoothed = chance3[r.by_two] + back3[r.of_pred[r.by_two]] * shorter
    starts = np.cumsum(r.lengths) - r.lengths
    total = lambda x: np.add.reduceat(x, starts)
    ids = [i if k else None for i, k in zip(_unpack(row["doc_ids"], "<i8").tolist(), _unpack(row["known_ids"], np.uint8).tolist(), strict=True)]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(~r.training), "n_tokens": pa.array(r.lengths), "n_known": pa.array(total((c[r.tokens] > 0).astype(np.int64))),
        "train_tokens": pa.array(np.full(len(ids), tokens_seen, np.int64)), "base_score": pa.array(total(np.log10(p))), "score": pa.array(total(np.log10(smoothed))),
    })


def _bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder in buckets of `key`: what is joined to them later by that key moves to
    them, and they stay where they are."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog; the files stay
    return table


def score(docs: DataFrame, training, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of `docs`; `training` is a boolean column over
    doc_id that says which rows are counted.

    Null and empty texts consist of the end token.  Null and repeated doc_ids are rows of their own, and repeated texts
    count as often as they occur.  An empty table gives no rows; other columns are not read.  Words are told apart by hash: 64
    bits as such, 32 as followers of a word, PREDECESSOR_BITS as words before it.
    """
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // (6 * SHARD_ENTRIES)))
    blocks = _bucketed(blocks_of(docs, training), "block", "lm_blocks")
    heavy = _heavy_words(blocks, shards)
    asked = _ask(blocks, shards, np.asarray(sorted(heavy), np.uint64))
    answers = stored(asked.groupBy("shard").applyInArrow(_answer(heavy, discount), ANSWERED), "lm-answers")
    seen = answers.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    words_seen = (seen["words"] or 0) + sum(n > 0 for n in heavy.values())
    tokens_seen = (seen["tokens"] or 0) + sum(heavy.values())
    freed = answers.filter("hot IS NOT NULL").select(F.explode(F.arrays_zip("hot", "mass")).alias("x")).groupBy("x.hot").agg(F.sum("x.mass").alias("mass"))
    mass = dict.fromkeys(heavy, 1.0) | {int(np.int64(r.hot).view(np.uint64)): r.mass for r in freed.collect()}  # a row a heavy word
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "counts", *CODES)).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from _summed(row, words_seen, tokens_seen, shards, heavy, mass).to_batches()
                row = None
                give_back()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.join(by_block.hint("shuffle_hash"), "block").mapInArrow(run, schema)
