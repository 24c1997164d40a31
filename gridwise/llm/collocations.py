"""Collocations from weighted acyclic automata.

Each task counts the 1- to 3-grams of its texts and writes them, sorted, as count transducers: acyclic automata whose paths are the words
of an n-gram and whose weights are its count, with equal states held once.  A transducer is cut by prefix range, a range of the hash
of the first two words.  The transducers of a range are added up one after another into one, which keeps what is frequent.  Counts of the
parts of a candidate are read by composing the sorted parts asked of a range with its transducer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwise.llm.rows import give_back
from gridwise.shared import BROADCAST_BYTES, stored, with_running_total

#: Least count of a candidate, most candidates of a language, and share (percent) of a candidate's count that drops it.
LEAST, TOP, ABSORBED = 10, 2000, 50
#: Words of one block that a task counts, about; bytes of text of one prefix range; n-grams of a range that are added up at once.
BLOCK_WORDS, RANGE_BYTES, MERGE_GRAMS = 1_000_000, 6 << 20, 1_000_000
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
COUNTED = "range int, counts binary"
#: Rows of the merged table: an n-gram of a language (c is 0 below three words, b below two), what it counts, its one word.
MERGED = "kind int, range int, lang string, a long, b long, c long, n long, word string, counts binary"
WORDS_SEEN, FREQUENT, TRANSDUCER = range(3)
_u64 = np.uint64


class _Numbers(dict):
    def __missing__(self, token: bytes) -> int:
        n = self[token] = len(self)
        return n


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _u64(32))) * _u64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _u64(29))) * _u64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _u64(32))


def range_of(lang: np.ndarray, first: np.ndarray, second: np.ndarray, ranges: int) -> np.ndarray:
    """The prefix range of n-grams by the hashes of their language and first two words (0: none)."""
    with np.errstate(over="ignore"):
        h = _mixed(_mixed(lang * _u64(3) + first) + second)
    return ((h >> _u64(32)) * _u64(ranges) >> _u64(32)).astype(np.int64)


def _summed(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts (1 each if not given), and the place of each given key among them."""
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, place = np.unique(key, return_inverse=True)
    if count is None:
        return keys, np.bincount(place, minlength=len(keys)), place
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, count)
    return keys, total, place


def _minimal(owner: np.ndarray, states: int, *columns: np.ndarray) -> np.ndarray:
    """For each of `states` states, whose arcs are `columns` sorted by owner, the first state with equal arcs and `own` weight."""
    with np.errstate(over="ignore"):
        arc = np.full(len(owner), _u64(0))
        for c in columns:
            arc = _mixed(arc * _u64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + _u64(1))
        total = np.concatenate([[_u64(0)], np.cumsum(arc)])
        edge = np.searchsorted(owner, np.arange(states + 1))
        return _mixed(total[edge[1:]] - total[edge[:-1]])


def _planes(x: np.ndarray) -> bytes:
    """Integers by planes of bytes, which compress well."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


class CountTransducer:
    """Counts of n-grams of one to three words over several languages, as an acyclic automaton.

    root -(lang, a)-> first -(b)-> second -(c)-> end.  A first state carries the count of its word and a second state that of its
    pair; second states with the same count and arcs are one.  Words are numbers into `words`, sorted hashes.
    """

    KINDS = {"words": "<u8", "lang": "<u2", "a": "<u4", "a_n": "<u8", "a_end": "<u4", "b": "<u4", "state": "<u4", "state_n": "<u8", "state_end": "<u4", "c": "<u4", "c_n": "<u8"}

    def __init__(self, langs: list[str], arrays: dict[str, np.ndarray], text: list[bytes]):
        self.langs, self.text = langs, text
        self.__dict__ |= arrays

    @classmethod
    def from_sorted(cls, langs: list[str], words: np.ndarray, ones: tuple, pairs: tuple, threes: tuple, text: list[bytes] = ()) -> CountTransducer:
        """ones: lang, a, n; pairs: lang, a, b, n; threes: place of the pair, c, n; each sorted, words as numbers into `words`.
        `text` has the words of `ones`, or nothing."""
        lang, a, b, pair_n = pairs
        pair, c, c_n = threes
        with np.errstate(over="ignore"):
            print_ = _mixed(_minimal(pair, len(a), c, c_n) + pair_n.astype(np.uint64))
        _, kept, state = np.unique(print_, return_index=True, return_inverse=True)
        size = np.diff(np.searchsorted(pair, np.arange(len(a) + 1)))
        begin = np.searchsorted(pair, kept)
        arcs = np.repeat(begin - np.concatenate([[0], np.cumsum(size[kept])[:-1]]), size[kept]) + np.arange(size[kept].sum()) if len(kept) else kept
        many = len(words)
        root, first_of = np.unique(np.concatenate([ones[0].astype(np.int64) * many + ones[1], lang.astype(np.int64) * many + a]), return_inverse=True)
        a_n = np.zeros(len(root), np.int64)
        a_n[first_of[: len(ones[0])]] = ones[2]
        arrays = {
            "words": words, "lang": root // max(many, 1), "a": root % max(many, 1), "a_n": a_n, "a_end": np.cumsum(np.bincount(first_of[len(ones[0]) :], minlength=len(root))),
            "b": b, "state": state, "state_n": pair_n[kept], "state_end": np.cumsum(size[kept]), "c": c[arcs], "c_n": c_n[arcs],
        }
        return cls(langs, {k: v.astype(cls.KINDS[k]) for k, v in arrays.items()}, list(text))

    def to_bytes(self) -> bytes:
        parts = ["\n".join(self.langs).encode(), b"\n".join(self.text), *(_planes(getattr(self, k)) for k in self.KINDS)]
        return zstandard.ZstdCompressor(level=1).compress(np.asarray([len(p) for p in parts], "<u8").tobytes() + b"".join(parts))

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountTransducer:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        sizes = np.frombuffer(raw, "<u8", len(cls.KINDS) + 2)
        edges = 8 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        parts = [raw[b:e] for b, e in zip(edges, edges[1:], strict=False)]
        arrays = {k: np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() for (k, kind), p in zip(cls.KINDS.items(), parts[2:], strict=True)}
        return cls(parts[0].decode().split("\n"), arrays, parts[1].split(b"\n") if parts[1] else [])

    def grams(self) -> tuple[tuple, tuple, tuple]:
        """ones, pairs and threes as from_sorted takes them; of ones those with a count."""
        end = self.a_end.astype(np.int64)
        first = np.repeat(np.arange(len(end)), np.diff(np.concatenate([[0], end])))
        size = np.diff(np.concatenate([[0], self.state_end.astype(np.int64)]))
        many = size[self.state]
        pair = np.repeat(np.arange(len(self.b)), many)
        arcs = np.repeat(self.state_end.astype(np.int64)[self.state] - np.cumsum(many), many) + np.arange(many.sum())
        has = self.a_n > 0
        ones = (self.lang[has].astype(np.int64), self.a[has].astype(np.int64), self.a_n[has].astype(np.int64))
        pairs = (self.lang[first].astype(np.int64), self.a[first].astype(np.int64), self.b.astype(np.int64), self.state_n[self.state].astype(np.int64))
        return ones, pairs, (pair, self.c[arcs].astype(np.int64), self.c_n[arcs].astype(np.int64))

    @classmethod
    def union(cls, several: list[CountTransducer], least: int = 1) -> CountTransducer:
        """The sums of the weights of some transducers, without n-grams whose sum is under `least`."""
        langs = sorted({x for t in several for x in t.langs})
        words = np.unique(np.concatenate([t.words for t in several]))
        many, parts, text = len(words), [], {}
        for t in several:
            of_lang, of_word = np.asarray([langs.index(x) for x in t.langs], np.int64), np.searchsorted(words, t.words)
            ones, pairs, threes = t.grams()
            parts.append(((of_lang[ones[0]] * many + of_word[ones[1]], ones[2]), ((of_lang[pairs[0]] * many + of_word[pairs[1]]) * many + of_word[pairs[2]], pairs[3]), (threes[0], of_word[threes[1]], threes[2])))
            if t.text:
                text |= zip(of_word[ones[1]].tolist(), t.text, strict=True)
        one, one_n, _ = _summed(np.concatenate([p[0][0] for p in parts]), np.concatenate([p[0][1] for p in parts]))
        pair, pair_n, place = _summed(np.concatenate([p[1][0] for p in parts]), np.concatenate([p[1][1] for p in parts]))
        before = np.cumsum([0] + [len(p[1][0]) for p in parts])
        of_pair = np.concatenate([place[p[2][0] + b] for p, b in zip(parts, before, strict=False)])
        three, three_n, _ = _summed(of_pair * many + np.concatenate([p[2][1] for p in parts]), np.concatenate([p[2][2] for p in parts]))
        one, one_n, three, three_n = one[one_n >= least], one_n[one_n >= least], three[three_n >= least], three_n[three_n >= least]
        kept = pair_n >= least
        three_pair = (np.cumsum(kept) - 1)[three // many] if len(three) else three
        pair, pair_n = pair[kept], pair_n[kept]
        out_text = [text[x] for x in (one % many).tolist()] if text else []
        return cls.from_sorted(langs, words, (one // many, one % many, one_n), (pair // many // many, pair // many % many, pair % many, pair_n), (three_pair, three % many if len(three) else three, three_n), out_text)

    def lookup(self, lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts (0: not in it) of words and pairs of words, by places among `langs` and hashes (b 0: the word alone)."""
        out = np.zeros(len(a), np.int64)
        if not len(self.a):
            return out
        find = lambda table, x: (np.minimum(np.searchsorted(table, x), len(table) - 1), table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x)
        many = len(self.words)
        a_at, a_in = find(self.words, a)
        first, found = find(self.lang.astype(np.int64) * many + self.a, lang * many + a_at)
        alone = a_in & found & (b == 0)
        out[alone] = self.a_n[first[alone]]
        if len(self.b):
            owner = np.repeat(np.arange(len(self.a)), np.diff(np.concatenate([[0], self.a_end.astype(np.int64)])))
            b_at, b_in = find(self.words, b)
            arc, there = find(owner * many + self.b, first * many + b_at)
            both = a_in & found & b_in & there & (b != 0)
            out[both] = self.state_n[self.state[arc[both]]]
        return out


def _counted(langs: list[str], tokens: list[bytes], sequences: list[list[np.ndarray]], ranges: int) -> Iterator[tuple[int, bytes]]:
    """The transducers, by prefix range, of one block: for each language the number sequences of its texts, 0 between pieces."""
    hashes = np.asarray([0, *map(_hash, tokens[1:])], np.uint64)
    many, ones, pairs, threes, before = len(tokens), [], [], [], 0
    for number, texts in enumerate(sequences):
        ids = np.concatenate(texts)
        word = ids > 0
        count = np.bincount(ids[word], minlength=many)
        own = np.flatnonzero(count)
        ones.append((np.full(len(own), number), own, count[own]))
        two = word[:-1] & word[1:]
        key, n, place = _summed((ids[:-1] * many + ids[1:])[two])
        pairs.append((np.full(len(key), number), key // many, key % many, n))
        at = np.full(len(ids), -1)
        at[:-1][two] = place
        three = two[:-1] & word[2:]
        key3, n3, _ = _summed((at[: len(three)] * many + ids[2:])[three])
        threes.append((key3 // many + before, key3 % many, n3))
        before += len(key)
    ones, pairs, threes = ([np.concatenate(x) for x in zip(*y, strict=True)] for y in (ones, pairs, threes))
    by_lang = np.asarray([_hash(x.encode()) for x in langs], np.uint64)
    one_range = range_of(by_lang[ones[0]], hashes[ones[1]], np.zeros(1, np.uint64), ranges)
    pair_range = range_of(by_lang[pairs[0]], hashes[pairs[1]], hashes[pairs[2]], ranges)
    rank = np.argsort(np.argsort(hashes))  # words are sorted by hash
    order1, order2 = np.lexsort((rank[ones[1]], ones[0], one_range)), np.lexsort((rank[pairs[2]], rank[pairs[1]], pairs[0], pair_range))
    new_place = np.empty(len(order2), np.int64)
    new_place[order2] = np.arange(len(order2))
    order3 = np.lexsort((rank[threes[1]], new_place[threes[0]]))
    cut = lambda x, order: np.searchsorted(x[order], np.arange(ranges + 1))
    cut1, cut2 = cut(one_range, order1), cut(pair_range, order2)
    ones, pairs, threes = [x[order1] for x in ones], [x[order2] for x in pairs], [new_place[threes[0]][order3], threes[1][order3], threes[2][order3]]
    cut3 = np.searchsorted(threes[0], cut2)
    for r in range(ranges):
        one, pair, three = ([x[c[r] : c[r + 1]] for x in y] for y, c in ((ones, cut1), (pairs, cut2), (threes, cut3)))
        if len(one[0]) or len(pair[0]):
            own = np.unique(np.concatenate([hashes[one[1]], hashes[pair[1]], hashes[pair[2]], hashes[three[1]]]))
            local = lambda x, own=own: np.searchsorted(own, hashes[x])
            made = CountTransducer.from_sorted(langs, own, (one[0], local(one[1]), one[2]), (pair[0], local(pair[1]), local(pair[2]), pair[3]), (three[0] - cut2[r], local(three[1]), three[2]), [tokens[x] for x in one[1].tolist()])
            yield r, made.to_bytes()


def _count_blocks(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, texts, words = _Numbers({b".": 0}), {}, 0

        def rows() -> pa.RecordBatch:
            langs = sorted(texts)
            found = list(_counted(langs, list(numbers), [texts[x] for x in langs], ranges))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["range", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = (text or "").encode().lower().translate(_BREAKS).replace(b".", b" . ").split()
                own.append(b".")
                texts.setdefault("und" if lang is None else lang, []).append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
                words += len(own)
                if words >= BLOCK_WORDS:
                    yield rows()
                    numbers, texts, words = _Numbers({b".": 0}), {}, 0
                    give_back()
        if texts:
            yield rows()
        numbers = texts = None
        give_back()

    return run


def _merge(least: int, ranges: int):
    """Reads transducers sorted by range; adds up those of a range and gives what it counts."""
    names = [x.split()[0] for x in MERGED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.binary()]

    def batch(size: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in zip(names, kinds, strict=True)], names=names)

    def finished(number: int, held: list[CountTransducer]) -> Iterator[pa.RecordBatch]:
        whole = CountTransducer.union(held)
        seen = np.bincount(whole.lang, weights=whole.a_n, minlength=len(whole.langs)).astype(np.int64)
        yield batch(len(seen), kind=np.full(len(seen), WORDS_SEEN), lang=whole.langs, n=seen)
        kept = CountTransducer.union([whole], least)
        ones, pairs, threes = kept.grams()
        signed = lambda x: kept.words[x].view(np.int64)
        lang = lambda x: [kept.langs[i] for i in x.tolist()]
        zero = lambda x: np.zeros(len(x), np.int64)
        same = lambda x: np.full(len(x), FREQUENT)
        at = lambda x: np.full(len(x), number)
        yield batch(len(ones[0]), kind=same(ones[0]), range=at(ones[0]), lang=lang(ones[0]), a=signed(ones[1]), b=zero(ones[0]), c=zero(ones[0]), n=ones[2], word=[x.decode() for x in kept.text])
        yield batch(len(pairs[0]), kind=same(pairs[0]), range=at(pairs[0]), lang=lang(pairs[0]), a=signed(pairs[1]), b=signed(pairs[2]), c=zero(pairs[0]), n=pairs[3])
        p = threes[0]
        yield batch(len(p), kind=same(p), range=at(p), lang=lang(pairs[0][p]), a=signed(pairs[1][p]), b=signed(pairs[2][p]), c=signed(threes[1]), n=threes[2])
        yield batch(1, kind=[TRANSDUCER], range=[number], counts=[kept.to_bytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, grams = None, [], 0
        for rows in batches:
            for r, raw in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                if r != number and held:
                    yield from finished(number, held)
                    held, grams = [], 0
                    give_back()
                number = r
                held.append(CountTransducer.from_bytes(raw.as_py()))
                grams += len(held[-1].c) + len(held[-1].b)
                if grams >= MERGE_GRAMS and len(held) > 1:
                    held = [CountTransducer.union(held)]
                    grams = 0
        if held:
            yield from finished(number, held)
        held = None
        give_back()

    return run


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (range, counts, lang, a, b) sorted by range, each transducer before the parts asked of it; gives lang, a, b, n."""
    held: CountTransducer | None = None
    number = None
    for batch in batches:
        ranges, raw = np.asarray(batch.column(0)), batch.column(1)
        machines = np.flatnonzero(np.asarray(raw.is_valid()))
        edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, machines, machines + 1, [len(ranges)]])).astype(int)
        for b, e in zip(edges, edges[1:], strict=False):
            if ranges[b] != number:
                number, held = ranges[b], None
            if raw[int(b)].is_valid:
                held = CountTransducer.from_bytes(raw[int(b)].as_py())
                continue
            part = batch.slice(b, e - b)
            langs = part.column(2).to_pylist()
            known = {x: i for i, x in enumerate(held.langs)} if held else {}
            hashes = [np.asarray(part.column(i)).view(np.uint64) for i in (3, 4)]
            n = held.lookup(np.asarray([known.get(x, -1) for x in langs], np.int64), *hashes) if held else np.zeros(len(langs), np.int64)
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(n)], names=["lang", "a", "b", "n"])


def _asked(ranges: int):
    """Adds the range to rows (lang, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            known |= {x: _hash(x.encode()) for x in set(langs) - known.keys()}
            a, b = (np.asarray(batch.column(i)).view(np.uint64) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(range_of(np.asarray([known[x] for x in langs], np.uint64), a, b, ranges), pa.int32()), pa.nulls(batch.num_rows, pa.binary()), *batch.columns], names=["range", "counts", "lang", "a", "b"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest cut of each candidate; `cuts` has l and r of the cuts after one word and after two (null: no such cut)."""
    for batch in batches:
        out = []
        for n, l1, r1, l2, r2 in zip(*(batch.column(i).to_pylist() for i in range(5, 10)), strict=True):
            cuts = [(1_000_000 * n * n // (x * y), k, x, y) for k, (x, y) in enumerate(((l1, r1), (l2, r2))) if x is not None]
            out.append(min(cuts, key=lambda c: c[:2]))
        columns = [pa.array([c[i] for c in out], pa.int64()) for i in (2, 3, 0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], *columns], names=["id", "lang", "a", "b", "c", "n", "l", "r", "score"])


def _small(df: DataFrame, bytes_a_row: int) -> DataFrame:
    return F.broadcast(df) if bytes_a_row * df.count() <= BROADCAST_BYTES else df


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` candidates of each language (null: `und`).

    Null and empty texts have no words; a language without candidates has no rows, an empty table none at all.  Texts count as often as
    they occur; doc_id and other columns are not read.  Words are told apart by 64-bit hashes (a hash of 0 becomes 1).
    `least` is 1 at least.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // RANGE_BYTES))
    counted = texts.mapInArrow(_count_blocks(ranges), COUNTED)
    merged = stored(counted.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_merge(least, ranges), MERGED), "collocations-merged")
    frequent = merged.filter(F.col("kind") == FREQUENT)
    found = frequent.filter("b <> 0").select("lang", "a", "b", "c", "n")
    longer = found.filter("c <> 0").select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("x"), "n")
    longer = longer.groupBy("lang", "x.a", "x.b").agg(F.max("n").alias("longest"))
    inside = found.filter("c = 0").join(longer, ["lang", "a", "b"], "left").filter(F.col("longest").isNull() | (F.lit(100) * F.col("longest").cast("decimal(25,0)") < F.lit(absorbed) * F.col("n").cast("decimal(25,0)")))
    candidates = stored(inside.select("lang", "a", "b", "c", "n").union(found.filter("c <> 0")).select("*", F.monotonically_increasing_id().alias("id")), "collocations-candidates")

    side = lambda place, x, y: F.struct(F.lit(place).alias("place"), F.col(x).alias("a"), (F.col(y) if y else F.lit(0).cast("long")).alias("b"))
    two, three = F.array(side(0, "a", None), side(1, "b", None)), F.array(side(0, "a", None), side(1, "b", "c"), side(2, "a", "b"), side(3, "c", None))
    wants = candidates.select("id", "lang", F.explode(F.when(F.col("c") == 0, two).otherwise(three)).alias("x")).select("id", "lang", "x.*")
    asked = wants.select("lang", "a", "b").distinct().mapInArrow(_asked(ranges), "range int, counts binary, lang string, a long, b long")
    machines = merged.filter(F.col("kind") == TRANSDUCER).select("range", "counts", "lang", "a", "b")
    answers = machines.union(asked).repartition(ranges, "range").sortWithinPartitions("range", F.desc_nulls_last(F.col("counts").isNotNull())).mapInArrow(_compose, "lang string, a long, b long, n long")
    answers = stored(answers, "collocations-parts")
    sides = wants.join(_small(answers, 64), ["lang", "a", "b"]).groupBy("id").agg(*(F.max(F.when(F.col("place") == i, F.col("n"))).alias(name) for i, name in enumerate(("l1", "r1", "l2", "r2"))))
    scored = candidates.join(sides, "id").select("id", "lang", "a", "b", "c", "n", "l1", "r1", "l2", "r2").mapInArrow(_scored, "id long, lang string, a long, b long, c long, n long, l long, r long, score long")
    scored = stored(scored, "collocations-scored")

    # scores are at most a million: a coarse count of them says where the first `top` of a language end at the latest
    coarse = scored.groupBy("lang", F.floor(F.col("score") / 256).alias("step")).count()
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    steps = coarse.withColumn("above", above).filter(F.col("above").isNull() | (F.col("above") < top)).groupBy("lang").agg(F.min("step").alias("least"))
    first = scored.join(steps, "lang").filter(F.floor(F.col("score") / 256) >= F.col("least"))
    words = frequent.filter("b = 0").groupBy("a").agg(F.first("word").alias("word"))
    spelled = first.select("id", "lang", "n", "l", "r", "score", F.posexplode(F.array("a", "b", "c")).alias("place", "a")).filter("a <> 0")
    spelled = spelled.join(_small(words, 64), "a").groupBy("id", "lang", "n", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    line = spelled.select("lang", (-F.col("score")).alias("down"), (-F.col("n")).alias("down_n"), "phrase", "n", "l", "r", "score", F.lit(1).cast("long").alias("one"))
    placed, _ = with_running_total(line, ["lang", "down", "down_n", "phrase"], "one", "place", "collocations-order")
    starts = placed.groupBy("lang").agg(F.min("place").alias("start"))
    seen = merged.filter(F.col("kind") == WORDS_SEEN).groupBy("lang").agg(F.sum("n").alias("words"))
    ranked = placed.join(starts, "lang").withColumn("rank", F.col("place") - F.col("start") + 1).filter(F.col("rank") <= top).join(seen, "lang")
    return ranked.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("words").alias("n"), "score")
