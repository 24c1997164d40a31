"""Substring dedup by seed and extend: words are removed that lie in a run of `window` words which also starts earlier.

Seeds are winnowed anchors: of the `seed`-word runs inside a window the one with the smallest hash, the last on ties, so equal windows
have equal anchors at equal places, and each anchor owns a run of neighbouring windows.  Two places of an anchor are extended to both
sides over all words of the windows they own: where that whole extent is equal, all windows of the later place repeat.  An anchor with
several extents is extended in each way that reaches the length, a window at a time.  Equal extents meet by hash and only the earliest
place of one is kept, so no pairs are made; runs of repeated windows are merged into maximal repeats when they are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm import rows
from gridwise.shared import stored, with_running_total

#: Words of a repeat at least, and of a seed.
WINDOW, SEED = 20, 8
#: Words of one block, in which places of equal extents are counted once, about; hashes of words that a process keeps at hand.
BLOCK_WORDS, TABLE_ENTRIES = 1_500_000, 300_000
#: What a row of the seed table is: windows that repeat inside their block, the only extent of an anchor in its block, the mark of an
#: anchor with several extents in its block, a window of such an anchor.
REPEATED, EXTENT, SEVERAL, SINGLE = range(4)
SEEDS = "kind int, anchor long, extent long, row long, start long, windows int"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Runs:
    """Hashes of runs of words anywhere in a sequence, from sums of hashes weighted by powers of an odd number."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(words), _ODD))
            self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), np.uint64(pow(int(_ODD), -1, 1 << 64))))])
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def owned_windows(words: np.ndarray, lengths: np.ndarray, window: int, seed: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a sequence of texts, and for each anchor: its hash, its first window, how many it owns, the hash of the extent."""
    runs, none = Runs(words), np.zeros(0, np.int64)
    if len(words) < window:
        return runs, none.astype(np.uint64), none, none, none.astype(np.uint64)
    at = np.arange(len(words) - seed + 1)
    seeds = runs(at, at + seed)
    inside = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)[:, ::-1]
    start = np.arange(len(words) - window + 1)
    chosen = start + (window - seed) - np.argmin(inside, axis=1)
    text = np.repeat(np.arange(len(lengths)), lengths)
    start = start[text[: len(start)] == text[window - 1 :]]  # within one text
    chosen, of = chosen[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])])) if len(start) else none
    first, many = start[new], np.diff(np.concatenate([new, [len(start)]]))
    anchor = chosen[new]
    with np.errstate(over="ignore"):
        extent = _mixed(runs(first, first + many - 1 + window) + np.uint64(64) * (anchor - first).astype(np.uint64) + many.astype(np.uint64))
    return runs, seeds[anchor], first, many, extent


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place whether it is the first with its keys (in the order given), and an order that brings equal keys together."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new |= np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else new
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    return first, order


def _unrolled(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Every window of runs of windows."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else first


def _batch(kind: int, anchor, extent, row, start, windows) -> pa.RecordBatch:
    n = len(row) if row is not None else len(anchor)
    signed = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
    columns = [pa.array(np.full(n, kind, np.int32)), signed(anchor), signed(extent), signed(row), signed(start), pa.array(np.array(np.broadcast_to(np.asarray(windows, np.int32), n)))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SEEDS.split(", ")])


def _runs_of(row: np.ndarray, start: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """Repeated windows, runs that touch each other in one row."""
    order = np.lexsort((start, row))
    row, start, many = row[order], start[order], many[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != (start + many)[:-1])])) if len(row) else np.zeros(0, np.int64)
    return _batch(REPEATED, None, None, row[new], start[new], np.add.reduceat(many, new) if len(new) else many)


def _blocks(batches: Iterator[pa.RecordBatch], further: int) -> Iterator[tuple]:
    """(rows, word hashes, lengths, lists from column `further` if there) of some texts, in the order of rows; columns row, text."""
    table, held, words = _Hashes(), [], 0
    for batch in batches:
        extra = batch.column(further).to_pylist() if further else [None] * batch.num_rows
        for row, text, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), extra, strict=True):
            own = (text or "").encode().split()
            held.append((row, np.fromiter(map(table.__getitem__, own), np.uint64, len(own)), more))
            words += len(own)
            if words >= BLOCK_WORDS:
                yield _joined(held)
                held, words = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    held.sort(key=lambda x: x[0])
    return np.asarray([r for r, _, _ in held], np.int64), np.concatenate([w for _, w, _ in held]), np.asarray([len(w) for _, w, _ in held], np.int64), [m for _, _, m in held]


def _seed_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, lengths, _ in _blocks(batches, 0):
            begin = np.cumsum(lengths) - lengths
            runs, anchor, first, many, extent = owned_windows(words, lengths, window, seed)
            text = np.searchsorted(begin, first, side="right") - 1
            earliest, order = _first_of(anchor, extent)
            later = ~earliest
            repeated = [(row[text[later]], first[later] - begin[text[later]], many[later])]
            order = order[earliest[order]]  # the earliest place of each extent, by anchor
            a = anchor[order]
            alone = np.concatenate([[True], a[1:] != a[:-1]]) & np.concatenate([a[1:] != a[:-1], [True]]) if len(a) else np.zeros(0, bool)
            one, several = order[alone], np.sort(order[~alone])
            yield _batch(EXTENT, anchor[one], extent[one], row[text[one]], first[one] - begin[text[one]], many[one])
            yield _batch(SEVERAL, np.unique(anchor[several]), None, None, None, 0)
            yield from _windows(runs, anchor[several], row[text[several]], begin[text[several]], first[several], many[several], window, repeated)

    return run


def _windows(runs: Runs, anchor, row, begin, first, many, window: int, repeated: list) -> Iterator[pa.RecordBatch]:
    """The windows of extents one by one, of equal ones the earliest; the others go with what repeats."""
    at = _unrolled(first, many)
    anchor, row, begin = np.repeat(anchor, many), np.repeat(row, many), np.repeat(begin, many)
    place = np.argsort(at, kind="stable")
    at, anchor, row, begin = at[place], anchor[place], row[place], begin[place]
    whole = runs(at, at + window)
    earliest, _ = _first_of(anchor, whole)
    yield _batch(SINGLE, anchor[earliest], whole[earliest], row[earliest], (at - begin)[earliest], 1)
    repeated.append((row[~earliest], (at - begin)[~earliest], np.ones(int((~earliest).sum()), np.int64)))
    yield _runs_of(*(np.concatenate(x) for x in zip(*repeated, strict=True)))


def _window_rows(window: int):
    """Windows of the texts (row, text, wanted: anchor, first window and number of windows of extents), one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, lengths, wanted in _blocks(batches, 2):
            begin = np.cumsum(lengths) - lengths
            flat = sorted((int(b) + x["start"], x["windows"], x["anchor"], int(r), int(b)) for r, b, own in zip(row, begin, wanted, strict=True) for x in own)
            first, many, anchor, own_row, own_begin = (np.asarray(x, np.int64) for x in zip(*flat, strict=True))
            yield from _windows(Runs(words), anchor, own_row, own_begin, first, many, window, [])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by anchor (marks first), extent, row and start.  Gives later places of an extent as REPEATED and the earliest
    places of the extents of an anchor that has several as SINGLE, still to be looked at; holds one row back, not a group."""
    last_anchor = last_extent = held = None  # held: the earliest place of the only extent so far
    several = False
    for batch in batches:
        anchor, extent, row, start, windows = (np.asarray(batch.column(i).fill_null(0)) for i in range(1, 6))
        n = len(anchor)
        if not n:
            continue
        mark = np.asarray(batch.column(0)) == SEVERAL
        new_anchor = np.concatenate([[last_anchor is None or anchor[0] != last_anchor], anchor[1:] != anchor[:-1]])
        new_extent = new_anchor | np.concatenate([[last_extent is None or extent[0] != last_extent or mark[0]], (extent[1:] != extent[:-1]) | mark[:-1]])
        first = new_extent & ~mark
        of = np.cumsum(new_anchor)  # 0: goes on from the batch before
        kinds = np.bincount(of, weights=first, minlength=of[-1] + 1) + 2 * np.bincount(of, weights=mark, minlength=of[-1] + 1)
        if of[0] == 0:
            kinds[0] += 2 if several else (held is not None)
        if held is not None and kinds[0] > 1 and of[0] == 0:
            yield _batch(SINGLE, *(np.asarray([x]) for x in held[:1]), None, *(np.asarray([x]) for x in held[1:3]), held[3])
            held = None
        ends_open = of == of[-1]
        take = first & (kinds[of] > 1)
        if take.any():
            yield _batch(SINGLE, anchor[take], None, row[take], start[take], windows[take])
        later = ~first & ~mark
        if later.any():
            yield _runs_of(row[later], start[later], windows[later].astype(np.int64))
        several = bool(kinds[-1] > 1)
        if of[-1] > 0:
            held = None
        alone = np.flatnonzero(first & ends_open & (kinds[of] == 1))
        if len(alone):
            held = (anchor[alone[0]], row[alone[0]], start[alone[0]], windows[alone[0]])
        last_anchor, last_extent = anchor[-1], None if mark[-1] else extent[-1]


def _later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, extent, row and start, all but the first of each anchor and extent."""
    last = None
    for batch in batches:
        anchor, extent, row, start = (np.asarray(batch.column(i)) for i in range(1, 5))
        if not len(anchor):
            continue
        later = np.concatenate([[(anchor[0], extent[0]) == last], (anchor[1:] == anchor[:-1]) & (extent[1:] == extent[:-1])])
        last = (anchor[-1], extent[-1])
        if later.any():
            yield _runs_of(row[later], start[later], np.ones(int(later.sum()), np.int64))


def _in_order(docs: DataFrame) -> DataFrame:
    """row, doc_id, text; rows rise with doc_id, null last, and are distinct."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if own.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return own.select(F.col("doc_id").alias("row"), "doc_id", "text")
    kept, number = rows.numbered(own, "repeats-rows")
    keys = kept.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", number, F.lit(1).cast("long").alias("one"))
    placed, _ = with_running_total(keys, ["no_id", "doc_id", number], "one", "row", "repeats-order")
    return stored(kept.join(placed.select(number, "row"), number).select("row", "doc_id", "text"), "repeats-docs")


def repeated_windows(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """row, start, windows: runs of windows of `texts` (row, text) that also start earlier; a run may be in several pieces."""
    sort = ["anchor", "extent", "row", "start"]
    seeds = stored(texts.select("row", "text").mapInArrow(_seed_rows(window, seed), SEEDS), "repeats-seeds")
    by_anchor = seeds.filter(F.col("kind").isin(EXTENT, SEVERAL)).withColumn("extent", F.when(F.col("kind") == EXTENT, F.col("extent")))
    settled = stored(by_anchor.repartition("anchor").sortWithinPartitions(F.asc("anchor"), F.desc("kind"), *map(F.asc, sort[1:])).mapInArrow(_settle, SEEDS), "repeats-settled")
    wanted = settled.filter(F.col("kind") == SINGLE).groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))
    asked = stored(texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(_window_rows(window), SEEDS), "repeats-windows")
    single = F.col("kind") == SINGLE
    later = seeds.filter(single).union(asked.filter(single)).repartition("anchor", "extent").sortWithinPartitions(*sort).mapInArrow(_later_places, SEEDS)
    return later.union(seeds.filter(F.col("kind") == REPEATED)).union(settled.filter(F.col("kind") == REPEATED)).union(asked.filter(F.col("kind") == REPEATED)).select("row", "start", "windows")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and spans (begin and end in words of each maximal repeat) of
    each row of `docs`.

    A run of `window` words repeats if it also starts earlier: in a row of smaller doc_id (null is the greatest; rows that repeat
    an id come in an order that is chosen once), or earlier in the same row.  Null and empty texts have no words.  An empty table gives no
    rows; other columns are not read.  Runs are told apart by two 64-bit hashes.
    """
    texts = _in_order(docs)
    found = repeated_windows(texts, window, seed).groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<begin:int,end:int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for x in own or ():
                    edges[x["start"]] += 1
                    edges[x["start"] + x["windows"] - 1 + window] -= 1
                gone = np.cumsum(edges)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left, at = [], 0
                for b, e in turns.reshape(-1, 2).tolist():
                    left += words[at:b]
                    at = e
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(left + words[at:]).decode())
                spans.append([{"begin": b, "end": e} for b, e in turns.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column(0), pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return texts.join(found, "row", "left").select("doc_id", "text", "found").mapInArrow(cut, schema)
