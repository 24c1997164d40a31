"""Exact Jaccard join of documents on word shingles, size-aware: small sets enumerate subsets, large sets scan
inverted lists of their rarest shingles, and the boundary between them is where the two cost the same."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm.components import components
from gridwise.shared import BROADCAST_BYTES, stored

#: Hashes of words that a process keeps at hand.
TABLE_ENTRIES = 300_000
#: Shingles of one shard of the count, about, and of one block that a task sends out.
SHARD_KEYS, BLOCK_KEYS = 2_000_000, 2_000_000
#: Members of one block of a long inverted list.
LIST_BLOCK = 1024
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int, table: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; a text of fewer words has its whole
    sequence as its one shingle, and a text without words none."""
    table = _Hashes() if table is None else table
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, own), np.uint64, len(own))
    if len(own) < words:
        return np.asarray([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(own))], np.uint64)
    with np.errstate(over="ignore"):
        n = len(h) - words + 1
        out = np.full(n, _MIX[0])
        for i in range(words):
            out = _mixed(out * _MIX[2] + h[i : i + n] * _MIX[3])
    return np.unique(out)


def set_hash(keys: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63)


def least_common(n: int, percent: int) -> int:
    """Least overlap of a set of n with a set of at most n at that similarity."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Two similar sets share one of so many first elements of each, in any common order."""
    return n - least_common(n, percent) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """Overlaps that a set of n may have to reach with a set of at least its own size."""
    return sorted({c for a in range(n, 100 * n // percent + 1) if (c := least_common(a, percent)) <= n})


def enumerations(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


def choose_boundary(scanned: list[tuple[int, float]], percent: int) -> int:
    """Largest set size for which enumerating subsets costs less than scanning lists; scanned: (size, members of all lists
    that a set of that size is in, on average).  Enumeration grows much faster, so the cheaper side changes once."""
    best = 0
    for n, members in sorted(scanned):
        if enumerations(n, percent) > max(members, prefix_length(n, percent)):
            break
        best = n
    return best


def rarity_code(count: np.ndarray) -> np.ndarray:
    """One byte that rises with the number of sets that have a shingle; 0 for one set."""
    return np.where(count > 1, np.minimum(1 + 4 * np.log2(np.maximum(count, 2) / 2), 255), 0).astype(np.uint8)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31), kind)


def _low_bytes(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def _from_low_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


class _Block:
    """The sets of one block.  Each set is sorted by hash and a shard is a range of hashes, so a set is a row of runs: a shard and how many
    of its shingles lie there; shards without any take no room.  A shingle that several sets of the block have is held and sent
    once (`first`), its other places refer to it (`again`)."""

    def __init__(self, fps: np.ndarray, sizes: np.ndarray, shard: np.ndarray, first: np.ndarray, again: np.ndarray):
        self.fps, self.sizes = fps, sizes
        self.order = np.argsort(shard, kind="stable")  # by shard, then set, then hash
        self.held = np.empty(len(shard), np.int64)
        self.held[first] = np.arange(int(first.sum()))
        self.held[~first] = again
        self.shards, starts = np.unique(shard[self.order][first], return_index=True)
        self.edges = np.append(starts, int(first.sum()))

    @staticmethod
    def pack(block: list[tuple[int, np.ndarray]], shards: int) -> tuple:
        keys = np.concatenate([k for _, k in block])
        sizes = np.asarray([len(k) for _, k in block])
        shard = _shard(keys, shards)
        ends = np.zeros(len(keys), bool)
        ends[np.cumsum(sizes) - 1] = True
        ends[:-1] |= shard[1:] != shard[:-1]
        runs = np.flatnonzero(ends)
        steps = np.diff(shard[runs], prepend=0).astype("<i4")
        keys = keys[np.argsort(shard, kind="stable")]
        _, at, where = np.unique(keys, return_index=True, return_inverse=True)
        first = np.zeros(len(keys), bool)
        first[at] = True
        place = np.cumsum(first) - 1
        again = place[at][where][~first].astype("<u4")
        lengths = np.diff(runs, prepend=-1).astype("<u4")
        return _pack(np.asarray([f for f, _ in block], "<i8")), _pack(sizes.astype("<u4")), _pack(steps), _pack(lengths), _pack(np.packbits(first)), _pack(again), _low_bytes(keys[first])

    @classmethod
    def unpack(cls, row: dict) -> _Block:
        shard = np.repeat(np.cumsum(_unpack(row["steps"], "<i4"), dtype=np.int64), _unpack(row["lengths"], "<u4"))
        first = np.unpackbits(_unpack(row["first"], np.uint8))[: len(shard)].astype(bool)
        return cls(_unpack(row["fps"], "<i8"), _unpack(row["sizes"], "<u4").astype(np.int64), shard, first, _unpack(row["again"], "<u4"))

    def holders(self, dropped: list[int]) -> np.ndarray:
        """How many sets of this block have each held shingle, other than the dropped ones."""
        counts = np.repeat(~np.isin(self.fps, np.asarray(dropped, np.int64)), self.sizes)[self.order]
        return np.bincount(self.held[counts], minlength=self.edges[-1])

    def codes(self, held: np.ndarray) -> np.ndarray:
        """A code for every shingle of every set, in order of hash."""
        out = np.empty(len(self.order), np.uint8)
        out[self.order] = held[self.held]
        return out


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


SHINGLED = "doc_id long, n long, fp long, block long, fps binary, sizes binary, steps binary, lengths binary, first binary, again binary, keys binary"


def _shingled(docs: DataFrame, words: int, shards: int) -> DataFrame:
    """Two kinds of rows: for each document its doc_id, set size, set hash `fp` and the block that holds the set, if this task
    had not sent it before; and the blocks (`fps` is not null).  Of a shingle a block holds the low 24 bits: with its shard they
    stand for it in the count, where a clash can only make it look more common than it is."""
    names = [f.split()[0] for f in SHINGLED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, sent, block, held = _Hashes(), set(), [], 0
        number = TaskContext.get().partitionId() << 32

        def rows(columns: list) -> pa.RecordBatch:
            n = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = shingle_set(text, words, table)
                fp = set_hash(keys) if len(keys) else None
                new = fp is not None and fp not in sent
                for column, value in zip(out, (doc_id, len(keys), fp, number if new else None), strict=True):
                    column.append(value)
                if new:
                    sent.add(fp)
                    block.append((fp, keys))
                    held += len(keys)
                    if held > BLOCK_KEYS:
                        yield rows([None, None, None, [number], *([x] for x in _Block.pack(block, shards))])
                        block, held, number = [], 0, number + 1
            if out[0]:
                yield rows([*out, *[None] * 7])
        if block:
            yield rows([None, None, None, [number], *([x] for x in _Block.pack(block, shards))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SHINGLED)


def _asked(blocks: DataFrame) -> DataFrame:
    """block, shard, keys and holders: what each block asks each shard.  `dropped` lists sets that another block counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block.unpack(row)
                holders, keys = b.holders(row["dropped"] or []).astype("<u4"), row["keys"]
                parts = list(zip(b.shards.tolist(), b.edges[:-1].tolist(), b.edges[1:].tolist(), strict=True))
                columns = [[row["block"]] * len(parts), [s for s, *_ in parts], [keys[3 * x : 3 * y] for _, x, y in parts], [_pack(holders[x:y]) for _, x, y in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "shard", "keys", "holders"])

    return blocks.mapInArrow(run, "block long, shard int, keys binary, holders binary")


def _answers(table: pa.Table) -> pa.Table:
    """One shard: the rarity code of every shingle that a block asked for, in its order."""
    keys = [_from_low_bytes(x) for x in table.column("keys").to_pylist()]
    holders = np.concatenate([_unpack(x, "<u4") for x in table.column("holders").to_pylist()])
    edges = np.cumsum([0, *map(len, keys)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    codes = rarity_code(np.bincount(at, weights=holders, minlength=len(distinct)))[at]
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "codes": pa.array([_pack(codes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})


def _candidates(percent: int):
    """Of one block (its own row, and the answers of all shards): fp, common and codes of the sets that share so many of their
    shingles with others that they can have a link; a code a shingle, in order of hash."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        b = _Block.unpack(next(r for r in rows if r["fps"] is not None))
        held = np.concatenate([_unpack(r["codes"], np.uint8) for r in sorted((r for r in rows if r["fps"] is None), key=lambda r: r["shard"])])
        codes = b.codes(held)
        ends = np.cumsum(b.sizes)
        common = np.add.reduceat(codes > 0, ends - b.sizes, dtype=np.int64)
        wanted = np.flatnonzero(100 * common >= percent * b.sizes)
        parts = [codes[ends[i] - b.sizes[i] : ends[i]].tobytes() for i in wanted]
        return pa.table({"fp": pa.array(b.fps[wanted]), "common": pa.array(common[wanted]), "codes": pa.array(parts, pa.binary())})

    return run


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """fp, common, the shingles and their codes of the wanted sets (fp, doc_id, common, codes), read again from a document that has
    each.  Their ids are sent to all tasks if they are small enough; else both sides are dealt out by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashes()
        for batch in batches:
            out: list[list] = [[], []]
            for text, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = shingle_set(text, words, table)
                if len(keys) and set_hash(keys) == fp:
                    out[0].append(fp)
                    out[1].append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["fp", "keys"])

    own = wanted.select(F.col("doc_id").alias("_doc_id"), F.col("fp").alias("_fp"))
    own = F.broadcast(own) if 32 * own.count() <= BROADCAST_BYTES else own
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(own, F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    read = rows.select("text", "_fp").mapInArrow(run, "fp long, keys array<long>").dropDuplicates(["fp"])
    return read.join(wanted.select("fp", "common", "codes"), "fp")


def _lists(sets: DataFrame, percent: int, boundary: int | None = None) -> DataFrame:
    """signature, light, fp, n, left, common: inverted lists.  Without `boundary` every set enters the lists of its prefix, the
    rarest shingles first; `left` is how many of its shingles are not before this one, which is the most that it can share with a set
    that it meets there first.  Shingles that no other set has take up the prefix but make no list.  With `boundary`
    the sets up to it enter the lists of their subsets (`light`)."""
    names = ["signature", "light", "fp", "n", "left", "common"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature, left, own, sizes = [], [], [], []
            for i, (keys, codes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                n = len(keys)
                sizes.append(n)
                if boundary is None:
                    code = np.frombuffer(codes, np.uint8)
                    places = np.argsort(code, kind="stable")[: prefix_length(n, percent)]
                    mine = [(keys[p], n - k) for k, p in enumerate(places.tolist()) if code[p]]
                else:
                    mine = [(set_hash(np.asarray([c, *x], "<i8")), n) for c in subset_sizes(n, percent) for x in combinations(keys, c)]
                signature += [s for s, _ in mine]
                left += [m for _, m in mine]
                own += [i] * len(mine)
            at = np.asarray(own, np.int64)
            n = np.asarray(sizes, np.int64)
            columns = [signature, np.full(len(at), boundary is not None), batch.column(0).take(pa.array(at)), n[at] if len(at) else [], left, batch.column(3).take(pa.array(at))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    own = sets if boundary is None else sets.filter(F.size("keys") <= boundary)
    return own.select("fp", "keys", "codes", "common").mapInArrow(run, ", ".join(f"{n} {'boolean' if n == 'light' else 'long'}" for n in names))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: whole sets meet."""
    left = pairs.join(sets.select(F.col("fp").alias("b"), F.col("keys").alias("b_keys")), "b")
    both = left.join(sets.select(F.col("fp").alias("a"), F.col("keys").alias("a_keys")), "a")
    common = F.size(F.array_intersect("a_keys", "b_keys"))
    return both.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.size("a_keys") + F.size("b_keys") - F.col("common"))).select("a", "b")


def _fits(a: str, b: str, percent: int):
    """What two sets can share at most, if they meet first in this list (columns of a and of b end in n and left), leaves room for that
    similarity.  A similar pair passes in the first list that it has in common, so none is lost."""
    most = F.least(f"{a}left", f"{b}left")
    return 100 * most >= percent * (F.col(f"{a}n") + F.col(f"{b}n") - most)


def links_of_sets(sets: DataFrame, percent: int) -> DataFrame:
    """fp and component of the sets (fp, common, keys, codes) that are similar to another, directly or through others; exact.

    First each set is held against one set that shares a list with it: the one least changed, whose shingles others have
    too.  In a group of copies that is mostly the original, so most groups come together in as many checks as they have members.
    Lists whose members are all in one component by then are done.  In the others each member outside the component of
    the least changed one meets all members of other components, in blocks of a long list; what their places in the order
    of rarity leave room for is checked, so none is lost.
    """
    lists = stored(_lists(sets, percent), "lists-prefix")
    lengths = lists.groupBy("signature").agg(F.count("*").alias("members")).filter("members > 1")
    scanned = lists.join(lengths, "signature").groupBy("n").agg(F.sum("members").alias("scanned"))
    scanned = scanned.join(sets.groupBy(F.size("keys").cast("long").alias("n")).count(), "n")
    boundary = choose_boundary([(r.n, r.scanned / r["count"]) for r in scanned.collect()], percent)  # a row a set size
    lists = lists.unionByName(_lists(sets, percent, boundary)) if boundary else lists
    least_changed = F.max(F.struct((F.col("common") / F.col("n")).alias("share"), "fp", "n", "left")).alias("hub")
    shared = lists.groupBy("signature", "light").agg(F.count("*").alias("members"), least_changed).filter("members > 1")
    lists = stored(lists.join(shared, ["signature", "light"]), "lists")

    hubs = lists.filter(F.col("fp") != F.col("hub.fp")).filter(_fits("", "hub.", percent))
    near = hubs.groupBy("fp").agg(F.max("hub").alias("hub")).select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"))
    found = stored(_verified(near, sets, percent), "links-hub")
    labels = components(found)

    labelled = stored(lists.select("signature", "light", "fp", "n", "left", "members", F.col("hub.fp").alias("hub")).join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "lists-labelled")
    main = F.max(F.when(F.col("fp") == F.col("hub"), F.col("component"))).alias("main")
    mixed = labelled.groupBy("signature", "light").agg(F.min("component").alias("low"), F.max("component").alias("high"), main).filter("low <> high")
    rest = labelled.join(mixed.select("signature", "light", "main"), ["signature", "light"]).withColumn("blocks", F.ceil(F.col("members") / LIST_BLOCK).cast("int"))
    outside = rest.filter("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    one, two = outside.alias("x"), dealt.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("signature", "light", "block")]
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp"))
    # two small sets meet in their subsets only
    apart = F.col("x.light") | (F.greatest("x.n", "y.n") > boundary)
    pairs = one.join(two, [*same, F.col("x.component") != F.col("y.component"), once, apart, _fits("x.", "y.", percent)])
    pairs = stored(pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct(), "pairs-rest")
    more = stored(_verified(pairs, sets, percent), "links-rest")
    if more.isEmpty():
        return labels
    return components(found.union(more))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs`: documents link when their sets of word shingles have a
    Jaccard similarity of at least percent/100, and a component's id is its smallest doc_id.

    Null texts and texts without words have no shingles and stay alone; a text of fewer than `words` words is one shingle.
    Rows with equal sets link whatever their ids; a null doc_id never names a component with other ids (a component
    of null ids only has null).  Repeated doc_ids are rows of their own.  An empty table gives no rows; other columns are
    not read.

    Copies (equal sets) are one set from the start.  All shingles of the different sets are counted, spread over shards by
    hash; the blocks that asked get back how common each of their shingles is.  A set can only have a link if percent/100 of its
    shingles occur in other sets.  Only such sets are read again and joined, rarest shingles first.
    """
    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-text_bytes // (6 * SHARD_KEYS)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shingled = stored(_shingled(docs, words, shards), "shingles")
    rows = shingled.filter("fps IS NULL").select("doc_id", "n", "fp", "block")
    sized = rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("block").alias("first"), F.count("block").alias("blocks"))
    repeated = rows.filter("block IS NOT NULL").join(sized.filter("blocks > 1").select("fp", "first"), "fp").filter("block <> first")
    blocks = shingled.filter("fps IS NOT NULL").drop("doc_id", "n", "fp")
    asking = blocks.join(repeated.groupBy("block").agg(F.collect_list("fp").alias("dropped")), "block", "left")  # sets of one block
    answers = _asked(asking).groupBy("shard").applyInArrow(_answers, "block long, shard int, codes binary")
    met = blocks.drop("keys").unionByName(answers, allowMissingColumns=True)
    wanted = met.groupBy("block").applyInArrow(_candidates(percent), "fp long, common long, codes binary").dropDuplicates(["fp"])
    wanted = stored(wanted.join(sized.select("fp", "doc_id"), "fp"), "wanted")
    sets = stored(_sets(docs, wanted, words), "sets")
    labels = links_of_sets(sets, percent)

    named = sized.select("fp", "doc_id").join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(least, "component").select("fp", "component_id")
    return rows.join(by_set, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
