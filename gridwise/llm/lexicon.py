"""Byte-level BPE by a minimal acyclic transducer over frequent words, with exact merging of all others."""

from __future__ import annotations

import json
import mmap
import os
import struct
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.llm.encoder import byte_of_symbol, token_table, tokenizer_path
from gridwise.shared import stored

#: Words in the transducer at most (its compiled form then stays under a few MB, which is what is broadcast).
MAX_WORDS = 32_768
#: Longer words are not counted, they hardly repeat; and not merged side by side with others.
MAX_WORD_CHARS = 48
#: Words that a task counts before it sends their counts on.
TABLE_ENTRIES = 500_000
#: Where byte-level BPE cuts a text before merging.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUN = regex.compile(r"[\s\x1c-\x1f]{2}")
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def compile_transducer(entries: dict[str, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to ids.

    Words enter in byte order; a state that can grow no more is replaced by an equal one if there is one, so suffixes are
    shared.  A transition carries how many words sort before those behind it; their sum along a word's path is
    its number, by which its ids are found.
    """
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final, ((byte, target), ...)

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states: final, transitions so far; the last transition of each is open
    labels = b""
    for word, _ in words:
        common = len(os.path.commonprefix([labels, word]))
        while len(path) > common + 1:
            child = settle(path.pop())
            path[-1][1].append((labels[len(path) - 1], child))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        labels = word
    while len(path) > 1:
        child = settle(path.pop())
        path[-1][1].append((labels[len(path) - 1], child))
    root = settle(path[0])

    reach = [0] * len(states)  # words behind each state; targets are settled before their sources
    first, label, target, skip = [0], bytearray(), [], []
    for i, (final, moves) in enumerate(states):
        before = int(final)
        for b, t in moves:
            label.append(b)
            target.append(t)
            skip.append(before)
            before += reach[t]
        reach[i] = before
        first.append(len(label))
    ids = list(chain.from_iterable(x for _, x in words))
    starts = np.cumsum([0, *(len(x) for _, x in words)])
    parts = [np.asarray(x, "<u4").tobytes() for x in (first, target, skip, starts, ids)]
    parts += [bytes(label), bytes(final for final, _ in states)]
    return struct.pack("<9I", root, len(states), *map(len, parts)) + b"".join(parts)


class Transducer:
    """A compiled transducer, memory-mapped from a file of this process that is unlinked at once; it reads many words side by
    side, a byte of each a step."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, n, *sizes = struct.unpack_from("<9I", self.map)
        ends = 36 + np.cumsum(sizes)
        first, self.target, self.skip, self.starts, self.ids, labels, self.finals = (np.frombuffer(self.map, kind, count, end - size) for kind, count, end, size in zip(["<u4"] * 5 + ["u1"] * 2, [x // 4 for x in sizes[:5]] + sizes[5:], ends.tolist(), sizes, strict=True))
        # transitions in the order of (state, byte): a step is one search
        self.moves = np.repeat(np.arange(n, dtype=np.int64) << 8, np.diff(first.astype(np.int64))) | labels

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, -1 for words that are not in it."""
        if not len(self.moves):
            return np.where([bool(self.finals[self.root]) and not w for w in words], 0, -1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            key = state[live] << 8 | text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            known = self.moves[at] == key
            number[live[~known]] = -1
            live, at = live[known], at[known]
            state[live], step = self.target[at], step + 1
            number[live] += self.skip[at]
            live = live[lengths[live] > step]
        return np.where((number >= 0) & (self.finals[state] > 0), number, -1)

    def __call__(self, word: str) -> list[int] | None:
        """The ids of a word, or None if it is not in the lexicon."""
        number = int(self.numbers([word.encode()])[0])
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist() if number >= 0 else None


class Merges:
    """Exact byte-pair merging: of all neighbours in a word those of the lowest rank merge first, from the left, until none can.
    Short words merge side by side, a pair of each a round; a long one with a heap over its pairs."""

    def __init__(self, path: str | None = None):
        with open(path or tokenizer_path(), encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols, vocabulary = byte_of_symbol(), model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for symbol, b in symbols.items():
            self.byte_ids[b] = vocabulary[symbol]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.asarray([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pairs, self.rank = key[order], order
        self.merged = np.asarray([vocabulary[a + b] for a, b in pairs], np.int64)
        self.byte_ranks = self.ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.of_pair = {k: (r, m) for r, (k, m) in enumerate(zip(key.tolist(), (vocabulary[a + b] for a, b in pairs), strict=True))}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        never = len(self.pairs)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(lengths > MAX_WORD_CHARS)
        parts = [self.of_long(words[i]) for i in long.tolist()]
        done = [(long, np.fromiter(map(len, parts), np.int64, len(parts)), np.fromiter(chain.from_iterable(parts), np.int64))]
        own = np.flatnonzero((lengths > 0) & (lengths <= MAX_WORD_CHARS))
        sizes = lengths[own]
        raw = np.frombuffer(b"".join(w for w in words if len(w) <= MAX_WORD_CHARS), np.uint8)
        ids, rank = self.byte_ids[raw], np.full(len(raw), never)  # rank: of each id with the one after it in its word
        rank[:-1] = self.byte_ranks[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank[np.cumsum(sizes) - 1] = never
        while len(own):
            n, starts = len(ids), np.cumsum(sizes) - sizes
            best, at = np.divmod(np.minimum.reduceat(rank * n + np.arange(n), starts), n)
            whole = best == never
            live = ~whole
            kept = np.repeat(live, sizes)
            done.append((own[whole], sizes[whole], ids[~kept]))
            own, sizes, at = own[live], sizes[live] - 1, at[live]
            ids[at] = self.merged[best[live]]
            kept[at + 1] = False  # the right one of the pair is gone
            ids, rank = ids[kept], rank[kept]
            new = np.cumsum(sizes) - sizes
            at += new - starts[live]
            rank[at] = self.ranks(ids[at], ids[np.minimum(at + 1, len(ids) - 1)])
            rank[new + sizes - 1] = never
            left = at[at > new] - 1
            rank[left] = self.ranks(ids[left], ids[left + 1])
        took = np.zeros(len(words), np.int64)
        for word, size, _ in done:
            took[word] = size
        first, out = np.cumsum(took) - took, np.empty(int(took.sum()), np.int64)
        for word, size, found in done:
            out[np.repeat(first[word] - (np.cumsum(size) - size), size) + np.arange(len(found))] = found
        return out, took

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges for a pair that does not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], len(self.pairs))

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that the pattern may cut further."""
        pieces = [_pieces(w) for w in words]
        ids, lengths = self([p.encode() for p in chain.from_iterable(pieces)])
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])])

    def of_long(self, word: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair = lambda i: self.of_pair.get(ids[i] << 32 | ids[after[i]]) if after[i] < len(ids) else None
        heap = [(p[0], i, p[1]) for i in range(len(ids)) if (p := pair(i))]
        heapify(heap)
        while heap:
            _, i, new = heappop(heap)
            if ids[i] < 0 or (p := pair(i)) is None or p[1] != new:
                continue  # one of the two has merged with another since
            gone = after[i]
            ids[i], ids[gone], after[i] = new, -1, after[gone]
            if after[i] < len(ids):
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (p := pair(j)):
                    heappush(heap, (p[0], j, p[1]))
        return [x for x in ids if x >= 0]


class LexiconEncoder:
    """Ids of texts: each different word of a batch of texts is read by the transducer, and merged exactly if it is not in the
    lexicon."""

    def __init__(self, compiled: bytes):
        self.lexicon, self.merges = Transducer(compiled), Merges()
        with open(tokenizer_path(), encoding="utf-8") as f:
            self.added_ids = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.added = regex.compile("(" + "|".join(map(regex.escape, self.added_ids)) + ")")

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not any(a in text for a in self.added_ids):
            return words_of(text)
        parts = self.added.split(text)
        return list(chain.from_iterable([_Added(part)] if i % 2 else words_of(part) for i, part in enumerate(parts)))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        own = [self._words(t) for t in texts]
        number: defaultdict = defaultdict(count().__next__)
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(own)), np.int64, sum(map(len, own)))
        words = list(number)
        if not words:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        place = self.lexicon.numbers([b"\xff" if type(w) is _Added else w.encode() for w in words])  # no text holds byte FF
        starts = self.lexicon.starts[np.maximum(place, 0)].astype(np.int64)
        lengths = np.where(place >= 0, self.lexicon.starts[np.minimum(place + 1, len(self.lexicon.starts) - 1)] - starts, 0)
        unseen = np.flatnonzero(place < 0)
        added = {i: self.added_ids[str(words[i])] for i in unseen.tolist() if type(words[i]) is _Added}
        ids, merged = self.merges.of_words(["" if i in added else words[i] for i in unseen.tolist()])
        lengths[unseen] = merged
        starts[unseen] = len(self.lexicon.ids) + np.cumsum(merged) - merged
        ids = np.concatenate([self.lexicon.ids, ids, np.asarray(list(added.values()), np.int64)])
        starts[list(added)], lengths[list(added)] = len(ids) - len(added) + np.arange(len(added)), 1
        take = lengths[flat]
        ends = np.cumsum(take)
        out = ids[np.repeat(starts[flat] - (ends - take), take) + np.arange(ends[-1])]
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, own)])]
        return out, np.diff(edges)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()


class _Added(str):
    """The string of an added token; differs from the same characters as an ordinary word."""

    def __eq__(self, other: object) -> bool:
        return type(other) is _Added and str.__eq__(self, other)

    def __hash__(self) -> int:
        return hash((_Added, str.__hash__(self)))


def _pieces(word: str) -> list[str]:
    """What the pattern cuts a word into; letters, and letters before one stop, without a search."""
    own = word[1:] if word.startswith(" ") else word
    if own.isalpha():
        return [word]
    return [word[:-1], word[-1]] if own[:-1].isalpha() and own[-1] in ".,;:!?" else PATTERN.findall(word)


def _has_run(text: str) -> bool:
    """Whether white space follows white space; searched for only where other than spaces and newlines occur."""
    if any(c in text for c in _RARE_SPACE):
        return bool(_RUN.search(text))
    return "  " in text or " \n" in text or "\n " in text or "\n\n" in text


def words_of(text: str) -> list[str]:
    """Cuts a text where the pre-token pattern always cuts: before a single space and around a single newline between
    other characters; texts with runs of white space are cut by the pattern itself."""
    if _has_run(text):
        return PATTERN.findall(text)
    return [w for w in text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if w] if "\0" not in text else PATTERN.findall(text)


def frequent_words(docs: DataFrame, max_words: int = MAX_WORDS) -> list[str]:
    """The most frequent words of all texts, each counted at least twice: all words of a count, or none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            own = [(w, n) for w, n in seen.items() if len(w) <= MAX_WORD_CHARS]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text or ""))
                if len(seen) > TABLE_ENTRIES:
                    yield flush()
        yield flush()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter("n > 1"), "word-counts")
    # the count that a word needs, from how many words have each count; so no partition sends more than is taken
    least, held = 2, 0
    for n, words in sorted(counts.groupBy("n").count().collect(), reverse=True):
        held += words
        if held > max_words:
            least = n + 1
            break
    return [r.word for r in counts.filter(F.col("n") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, max_words: int = MAX_WORDS) -> bytes:
    words = frequent_words(docs, max_words)
    ids, lengths = Merges().of_words(words)
    return compile_transducer({w: x.tolist() for w, x in zip(words, np.split(ids, np.cumsum(lengths)[:-1]), strict=False)})


def encode_decode(docs: DataFrame, lexicon: bytes) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids stand for) of each row of `docs`.

    Ids equal those of the `tokenizers` library without special tokens; the string of an added token in a text is
    that one token.  Null and empty texts have no ids and decode to ''.  Long texts and words of any length are encoded
    whole; null or repeated doc_ids are kept row by row; an empty table gives no rows; other columns are not read.
    """
    compiled = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared_lexicon(compiled.value), Decoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, lengths = encoder.encode_all(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths.tolist()]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoder(ids, lengths), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


class Decoder:
    """Texts of many id sequences at once: the bytes of all ids are taken from one table."""

    def __init__(self):
        table = token_table()
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def __call__(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        take = self.lengths[ids]
        ends = np.cumsum(take)
        raw = self.bytes[np.repeat(self.starts[ids] - (ends - take), take) + np.arange(int(take.sum()))].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [raw[a:b].decode("utf-8", errors="replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def decode(ids: list[int], table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def shared_lexicon(compiled: bytes) -> LexiconEncoder:
    """One for each worker process, so that tasks share what it maps and builds."""
    return LexiconEncoder(compiled)
