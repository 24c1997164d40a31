"""Seed-and-extend dedup and collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from gridwise.llm import collocations, repeats


def _without_repeats(rows: list[tuple], window: int) -> list[tuple]:
    """rows: (doc_id, text) in order; (doc_id, n_words, n_removed, kept, spans)."""
    seen, out = set(), []
    for doc_id, text in rows:
        w = [x for x in re.split("[ \t-\r]+", text or "") if x]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        edge = [i for i in range(len(w) + 1) if (i > 0 and gone[i - 1]) != (i < len(w) and gone[i])]
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), list(zip(edge[::2], edge[1::2], strict=True))))
    return out


def _got(table, **sizes) -> list[tuple]:
    return [(r.doc_id, r.n_words, r.n_removed, r.kept, [tuple(s) for s in r.spans]) for r in repeats.remove_repeats(table, **sizes).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(repeats, "BLOCK_WORDS", 150)  # several blocks a task
    passages = [" ".join(r.choices("abcdefgh", k=r.randrange(4, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choices("abcdxyzuvw", k=r.randrange(0, 25))) for _ in range(r.randrange(0, 5))]
        rows.append((3 * i, None if i % 13 == 5 else r.choice([" ", "\n", "\t \x0b"]).join(parts)))
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, start string").repartition(5)
    assert sorted(_got(table, window=5, seed=2)) == sorted(_without_repeats(rows, 5))
    assert sorted(_got(table, window=5, seed=5)) == sorted(_without_repeats(rows, 5))


def test_repeats_default_length_and_long_texts(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijkl", k=5)) for _ in range(5000)]
    long = " ".join(r.choices(words, k=60_000))
    own = [" ".join(r.choices(words, k=300)) for _ in range(4)]
    cut = long.split()[1000:1019]
    same = "été x \x1c \x85"  # not separators: a no-break space, \x1c, \x85
    rows = [(1, own[0]), (2, long), (3, " ".join(cut)), (4, " ".join(long.split()[500:700])), (5, own[0]), (6, own[1] + " " + own[1]), (7, ""), (8, " \n"), (9, "lower Upper"), (10, " ".join(["w"] * 50)), (11, " ".join([same] * 30))]
    assert sorted(_got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == sorted(_without_repeats(rows, 20))


def test_repeats_hot_seed_with_many_surroundings(spark):
    r = random.Random(6)
    line = " ".join(f"line{i}" for i in range(12))
    rows = [(i, " ".join(f"v{r.randrange(9)}" for _ in range(10)) + " " + line + " " + " ".join(f"v{r.randrange(2)}" for _ in range(10))) for i in range(400)]
    assert sorted(_got(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))) == sorted(_without_repeats(rows, 20))


def test_repeats_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(30)))
    got = _got(spark.createDataFrame([(None, text), (5, text), (5, text), (2, "a b"), (None, None)], "doc_id long, text string"))
    assert sorted(g[1:3] for g in got if g[0] is None) == [(0, 0), (30, 30)]  # null ids come last
    assert sorted(g[1:3] for g in got if g[0] == 5) == [(30, 0), (30, 30)] and (2, 2, 0, "a b", []) in got
    assert _got(spark.createDataFrame([], "doc_id long, text string")) == []


def _collocations(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f: dict[str, Counter] = {}
    for lang, text in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n, found = sum(c for p, c in own.items() if len(p) == 1), []
        held = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        for p, a in held.items():
            if len(p) == 2 and any(100 * c >= 50 * a for q, c in held.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return out


def _mined(table, **sizes) -> list[tuple]:
    return [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(table, **sizes).collect()]


@pytest.mark.parametrize("seed", range(2))
def test_collocations_against_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 400)
    monkeypatch.setattr(collocations, "MERGE_GRAMS", 300)  # several rounds of adding up
    words = ["new", "New", "york", "times", "a", "of", "été", "Été", "z z", "'", "\U0001f600"]
    rows = [(r.choice(["en", "fr", None, ""]), None if i % 11 == 3 else "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    table = spark.createDataFrame([(x, t, 1, "q") for x, t in rows], "lang string, text string, rank int, n string").repartition(4)
    for least, top in ((2, 2000), (10, 2000), (3, 7)):
        assert sorted(_mined(table, least=least, top=top)) == sorted(_collocations(rows, least, top))


def test_collocations_odd_tables(spark):
    kind = "doc_id long, lang string, text string"
    assert _mined(spark.createDataFrame([], kind)) == []
    assert _mined(spark.createDataFrame([(1, None, None), (2, "en", ""), (3, "en", ".,; \n")], kind)) == []
    hot = [(i, "en", "very common pair " * 200) for i in range(40)] + [(None, "en", "x y " * 30_000)]
    rows = [(lang, t) for _, lang, t in hot]
    assert sorted(_mined(spark.createDataFrame(hot, kind))) == sorted(_collocations(rows, 10, 2000))


def test_count_transducers_add_up_and_answer():
    r = random.Random(2)
    total, machines = Counter(), []
    for _ in range(5):
        tokens = [b"."] + [f"w{i}".encode() for i in range(12)]
        texts = [np.asarray([r.randrange(0, 13) for _ in range(300)]) for _ in range(2)]
        for lang, ids in zip(("de", "en"), texts, strict=True):
            for k in (1, 2, 3):
                total.update((lang, *(tokens[x].decode() for x in ids[i : i + k])) for i in range(len(ids) - k + 1) if all(ids[i : i + k]))
        machines += [collocations.CountTransducer.from_bytes(raw) for _, raw in collocations._counted(["de", "en"], tokens, [[t] for t in texts], 1)]
    whole = collocations.CountTransducer.union([collocations.CountTransducer.union(machines[:2]), *machines[2:]])
    name = {collocations._hash(f"w{i}".encode()): f"w{i}" for i in range(12)}
    word = [name[int(x)] for x in whole.words]
    ones, pairs, threes = whole.grams()
    have = Counter({(whole.langs[x], word[a]): n for x, a, n in zip(*(v.tolist() for v in ones), strict=True)})
    have |= Counter({(whole.langs[x], word[a], word[b]): n for x, a, b, n in zip(*(v.tolist() for v in pairs), strict=True)})
    have |= Counter({(whole.langs[pairs[0][p]], word[pairs[1][p]], word[pairs[2][p]], word[c]): n for p, c, n in zip(*(v.tolist() for v in threes), strict=True)})
    assert have == total
    assert [x.decode() for x in whole.text] == [word[a] for a in ones[1]]
    asked = [(i, a, b) for i in (0, 1) for a in range(13) for b in range(-1, 13)]
    code = lambda x: 0 if x < 0 else collocations._hash(f"w{x}".encode())
    n = whole.lookup(np.asarray([i for i, _, _ in asked]), np.asarray([code(a) for _, a, _ in asked], np.uint64), np.asarray([code(b) for _, _, b in asked], np.uint64))
    assert n.tolist() == [total[(whole.langs[i], f"w{a}", *([f"w{b}"] if b >= 0 else []))] for i, a, b in asked]


def test_equal_states_are_held_once():
    pairs = tuple(np.asarray(x) for x in ([0] * 4, [0, 1, 2, 3], [4, 4, 4, 4], [1, 1, 1, 2]))
    threes = tuple(np.asarray(x) for x in ([0, 1, 2, 3], [5, 5, 5, 5], [1, 1, 1, 2]))
    machine = collocations.CountTransducer.from_sorted(["en"], np.arange(1, 7).astype(np.uint64), tuple(np.zeros(0, np.int64) for _ in range(3)), pairs, threes)
    assert len(machine.state_n) == 2 and len(machine.c) == 2 and len(machine.b) == 4
    again = collocations.CountTransducer.from_bytes(machine.to_bytes())
    assert [x.tolist() for x in again.grams()[1]] == [x.tolist() for x in pairs] and [x.tolist() for x in again.grams()[2]] == [x.tolist() for x in threes]
