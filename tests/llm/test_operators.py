"""The document operators against brute force, on small tables with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.llm import encoder, lexicon, ngram_trie, order_minhash, packing, quality, sharding, shingle_join, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, size int, ids string"
WORDS = "the of onthe anre ed that with is ererth heand tion and eaor by it was".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = prose(r, 90)
    changed = base.split()
    changed[40] = "zzz"
    texts = [base, base, " ".join(changed), None, "", "   \n ", "one two", "One TWO", prose(r, 4), prose(r, 3000), "é" * 50 + " ñ\n\nü  x\t", "<|endoftext|> a <|endoftext|>", *(prose(r, r.randrange(5, 200)) for _ in range(20)), "x" * 5000]
    out = [(i, t, "en", 1, "own") for i, t in enumerate(texts)]
    return [*out, (3, base, "en", 1, "own"), (None, "no id here", None, None, None), (None, None, None, None, None), out[6]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return t or ""


def test_empty_tables(spark, empty):
    training = F.lit(True)
    assert packing.pack_along_curve(empty).count() == 0
    assert packing.pack_best_fit(empty).count() == 0
    assert sharding.feistel_shards(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert shingle_join.near_duplicates(empty).count() == 0
    assert ngram_trie.score(empty, training).count() == 0
    assert lexicon.encode_decode(empty, lexicon.build_lexicon(empty)).count() == 0
    assert token_counts.attribute_lines(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.ToxicityModel.fit(toxicity.training_rows(empty, labels))).count() == 0
    assert order_minhash.with_next(order_minhash.fingerprints(empty)).count() == 0


def test_encoders_equal_the_library():
    e = encoder.shared_encoder()
    r = random.Random(1)
    alphabet = [*" \n\t'abcXYZ019.,!?-é߀中\x1c\x85²½\U0001f600ñ`\0", "<|endoftext|>", "  ", "'s", "'ll"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(25))) for _ in range(4000)] + ["ab" * 3000, prose(r, 500)]
    words = Counter(w for t in texts for w in lexicon.words_of(t))
    own = lexicon.LexiconEncoder(lexicon.compile_transducer({w: e.ordinary(w) for w, n in words.items() if n > 2}))
    for t in texts:
        expected = e.library.encode(t, add_special_tokens=False).ids
        assert e.encode(t).tolist() == expected
        assert own.encode(t) == expected
        assert lexicon.decode(expected, encoder.token_table()) == e.library.decode(expected, skip_special_tokens=False)


def test_transducer_is_minimal_and_exact():
    words = {w: [i, i + 1] for i, w in enumerate(["aing", "bing", "cing", "aings", "bings", "cings", "", "é", "éa"])}
    compiled = lexicon.compile_transducer(words)
    t = lexicon.Transducer(compiled)
    assert all(t(w) == ids for w, ids in words.items())
    assert t("ing") is None and t("cingsx") is None and t("ê") is None
    # a, b and c share one suffix: states of ing(s) once
    alone = lexicon.compile_transducer({w: [1] for w in ["aing", "aings"]})
    shared = lexicon.compile_transducer({w: [1] for w in ["aing", "aings", "bing", "bings", "cing", "cings"]})
    states = lambda c: int.from_bytes(c[4:8], "little")
    assert states(alone) == states(shared)


def test_round_trip(docs, rows):
    got = lexicon.encode_decode(docs, lexicon.build_lexicon(docs)).collect()
    library = encoder.shared_encoder().library
    expected = Counter((i, tuple(library.encode(text_of(t), add_special_tokens=False).ids), text_of(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == expected


def ids_of(t):
    return [*encoder.shared_encoder().library.encode(text_of(t), add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("pack", [packing.pack_along_curve, packing.pack_best_fit])
def test_packing_is_lossless_and_tight(docs, rows, pack):
    length = 64
    pieces = pack(docs, length=length).collect()
    expected = Counter((i, tuple(ids_of(t))) for i, t, *_ in rows)
    seen = Counter()
    whole = {(i, n): ids for (i, ids), n in ((k, len(k[1])) for k in expected)}
    for p in pieces:
        ids = np.asarray(whole[p.doc_id, p.doc_tokens], "<u4")
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        seen[p.doc_id, p.doc_tokens] += p.length
    sizes = Counter()
    for (i, ids), n in expected.items():
        sizes[i, len(ids)] += n * len(ids)
    assert seen == sizes
    at = defaultdict(list)
    for p in pieces:
        at[p.sequence_id].append((p.offset, p.length))
    total = sum(n * len(ids) for (_, ids), n in expected.items())
    for spans in at.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= length
        if pack is packing.pack_along_curve:
            assert end == length or end & (end - 1) == 0
    if pack is packing.pack_along_curve:
        assert sorted(at) == list(range(len(at)))
    else:
        assert len(at) * length < 1.2 * total + length


def test_best_fit_matrix(docs):
    rows = packing.pack_best_fit(docs, length=64, matrix=True).collect()
    for r in rows:
        assert len(r.ids) == len(r.positions) == 4 * 64
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        positions = np.frombuffer(r.positions, "<u4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))


def test_best_fit_decreasing_equals_a_plain_search():
    r = random.Random(2)
    sizes = [r.randrange(1, 51) for _ in range(300)]
    room, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [x for x in room if x >= sizes[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - sizes[i])
        else:
            room.append(50 - sizes[i])
    got = packing.best_fit_decreasing(sizes, 50)
    used = Counter()
    for (b, _), n in zip(got, sizes, strict=True):
        used[b] += n
    assert sorted(50 - v for v in used.values()) == sorted(room)


def test_hilbert_curve_visits_neighbours():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    order = cells[np.argsort(packing.hilbert_key(cells, 3))]
    assert len(set(packing.hilbert_key(cells, 3).tolist())) == side**3
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.permuted(np.arange(n), n, seed=7)
    assert sorted(p.tolist()) == list(range(n))


def test_shards(docs, rows):
    got = sharding.feistel_shards(docs, shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(text_of(t).encode()) + 8, zlib.crc32(text_of(t).encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_token_attribution(docs, rows):
    got = defaultdict(int)
    for r in token_counts.attribute_lines(docs).collect():
        got[r.doc_id] += r.n_tokens
    expected = defaultdict(int)
    for i, t, *_ in rows:
        expected[i] += len(ids_of(t)) - 1
    assert {k: v for k, v in got.items()} == {k: v for k, v in expected.items()}
    best, crossing = token_counts.allocate(np.array([0, 3, 6]), np.array([3, 6, 8]), np.array([0, 4, 5, 8]))
    assert best.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, False]


def test_spans_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "é é")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 3), (1, 8, 13), (2, 1, 3), (2, 3, 3)], "doc_id long, start long, end long")
    got = {(r.doc_id, r.section): (r.n_tokens, r.doc_tokens) for r in token_counts.attribute_spans(docs, spans).collect()}
    assert got[1, 0] == (1, 3) and got[1, 1] == (1, 3) and got[2, 1][0] == 0


def brute_counts(t):
    t = text_of(t)
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


def test_quality(docs, rows):
    got = quality.quality(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_counts(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_learn_without_labels():
    r = np.random.default_rng(0)
    good = r.random(4000) < 0.85
    votes = np.where(good[:, None], np.where(r.random((4000, 6)) < 0.01, -1, 0), np.where(r.random((4000, 6)) < 0.3, -1, 0))
    votes[:, 0] = np.where(r.random(4000) < np.where(good, 0.95, 0.4), 1, 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.RuleModel.fit(patterns, counts.astype(float))
    kept = model.posterior(votes) >= 0.5
    assert (kept == good).mean() > 0.93
    assert model.accuracy().shape == (6, 2)


def test_no_vote_is_a_veto(spark):
    """A text that one rough rule objects to is kept, one that no rule objects to and none speaks for is not."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 8))) for _ in range(4000)]

    def text(n, end=12, symbols=0.0, plain=1.0):
        own = [r.choice(words) for _ in range(n)]
        own = [w + ("." if i % end == end - 1 else "") + ("#" if r.random() < symbols else "") + ("1" if r.random() > plain else "") for i, w in enumerate(own)]
        return " ".join(own)

    texts = [text(r.randrange(100, 300)) for _ in range(400)]
    texts += [text(r.randrange(60, 300), symbols=r.uniform(0.5, 1)) for _ in range(80)]
    weak = [text(200, end=100) for _ in range(5)]  # few sentence ends, otherwise clean
    grey = [" ".join(x for w in text(64, end=29, symbols=0.05, plain=0.62).split() for x in ((w, w) if r.random() < 0.05 else (w,))) + " X! Y! AB! CD!! x" for _ in range(5)]  # a little of everything
    docs = spark.createDataFrame(list(enumerate(texts + weak + grey)), "doc_id long, text string")
    got = {x.doc_id: x.asDict() for x in quality.quality(docs).collect()}
    bad = lambda x: [k for k, v in x.items() if k.startswith("vote_") and v == -1]
    assert all(bad(got[i]) and got[i]["kept"] for i in range(480, 485))
    assert any(not bad(got[i]) and not got[i]["kept"] and not got[i]["base_failed"] for i in range(485, 490))
    assert sum(got[i]["kept"] for i in range(400)) > 390 and sum(got[i]["kept"] for i in range(400, 480)) < 5
    # the verdict is the posterior of a plain sum over all rules
    names = [k for k in got[0] if k.startswith("vote_")]
    votes = np.array([[x[k] for k in names] for x in got.values()])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.RuleModel.fit(patterns, counts.astype(float))
    for x, v in zip(got.values(), votes, strict=True):
        good, ill = math.log(model.share), math.log(1 - model.share)
        for k, vote in enumerate(v):
            good, ill = good + math.log(model.chances[1, k, vote + 1]), ill + math.log(model.chances[0, k, vote + 1])
        assert math.isclose(x["posterior"], 1 / (1 + math.exp(ill - good)), rel_tol=1e-6, abs_tol=1e-12)
        assert x["kept"] == (not x["base_failed"] and x["posterior"] >= 0.5)


def test_toxicity_learns_its_words(spark):
    r = random.Random(3)
    bad = ["idiot", "stupid", "réeuxpa", "réeuxon", "réeuxle"]
    rows = []
    for i in range(400):
        words = prose(r, 40).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.ToxicityModel.fit(toxicity.training_rows(docs, labels))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert len(got) == 402
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    assert 0 <= got[1000].score < 0.5 and got[None].score == got[1000].score


def test_clauses_weigh_what_stands_around():
    words = toxicity.WordTransducer([("réeux*", 2.0)])
    total = lambda t: toxicity.document_features(t, words)[0]
    assert total("you are an idiot") > total("an idiot") > total("not an idiot") > 0
    assert total("an idiot") > total("it said an idiot")
    assert total("they kill you") > 0 == total("the kill was made")
    assert total("réeuxpa") > 0 == total("réeux") == total("ré")


def test_grammar_equals_a_plain_reading():
    r = random.Random(6)
    for _ in range(2000):
        symbols = [r.choice(".....IIHTTNR") for _ in range(r.randrange(1, 14))]
        weights = [r.choice([0.5, 1.0, 2.0]) if s in "IH" else 0.0 for s in symbols]
        expected: dict = defaultdict(float)
        for i, s in enumerate(symbols):
            if s not in "IH":
                continue
            target = "T" in symbols
            if "N" in symbols[max(0, i - toxicity.REACH) : i]:
                kind = "negated"
            elif "R" in symbols[:i]:
                kind = "reported"
            else:
                kind = ("threat" if s == "H" else "directed") if target else "bare"
            if s == "I" or target:
                expected[kind] += weights[i]
        score, got = toxicity.clause_patterns([(i, s, w) for i, (s, w) in enumerate(zip(symbols, weights, strict=True)) if s != "."])
        assert got == dict(expected)
        assert math.isclose(score, sum(toxicity.PATTERNS[k] * w for k, w in expected.items()), abs_tol=1e-12)


def test_labels_that_clash(spark):
    docs = spark.createDataFrame([(i, "a text") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, k) for i in range(50) for k in (0, 1)] + [(None, 1, 1), (3, 1, 7), (4, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50)) and all(x.toxic == 1 for x in rows)


def test_language_model(spark, rows, docs, monkeypatch):
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    got = ngram_trie.score(docs, training).collect()
    assert len(got) == len(rows)
    in_training = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    tokens = [(i, [*text_of(t).encode().lower().split(), b"\0"]) for i, t, *_ in rows]
    c = Counter(w for i, own in tokens if in_training(i) for w in own)
    n, v = sum(c.values()), len(c)
    expected = Counter((i, not in_training(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)) for i, own in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    # one discount for all, so that a plain model can follow; its probabilities are not quantised
    trained = [[b"<", *own] for i, own in tokens if in_training(i)]
    pairs, triples = Counter(), Counter()
    for own in trained:
        pairs.update(zip(own, own[1:]))
        triples.update(zip([b"-", *own], own, own[1:]))

    def plain(own):
        total, line = 0.0, [b"-", b"<", *own]
        for u, v, w in zip(line, line[1:], line[2:]):
            p = (c[w] + 0.1) / (n + 0.1 * (v_all + 1))
            for table, context, key in ((pairs, (v,), (v, w)), (triples, (u, v), (u, v, w))):
                same = followers[context]
                if same:
                    p = max(table[key] - 0.7, 0) / sum(same.values()) + 0.7 * len(same) / sum(same.values()) * p
            total += math.log10(p)
        return total

    v_all, followers = v, defaultdict(Counter)
    for (a, b), k in pairs.items():
        followers[a,][b] = k
    for (a, b, w), k in triples.items():
        followers[a, b][w] = k
    for heavy in (0.25, 1e-3):  # none or nearly all words dealt out over the shards
        monkeypatch.setattr(ngram_trie, "HEAVY", heavy)
        got = ngram_trie.score(docs, training, discount=0.7).collect()
        expected = sorted(((("" if i is None else str(i)), len(own), plain(own)) for i, own in tokens), key=str)
        mine = sorted(((("" if r.doc_id is None else str(r.doc_id)), r.n_tokens, r.score) for r in got), key=str)
        for (i, k, a), (j, m, b) in zip(sorted(expected), sorted(mine), strict=True):
            assert (i, k) == (j, m) and math.isclose(a, b, abs_tol=1e-3 * k, rel_tol=1e-3)


def test_chances_of_a_context_sum_to_one():
    r = np.random.default_rng(1)
    n = 3000
    line = np.column_stack([r.integers(0, 30, n), r.integers(0, 12, n), r.integers(0, 500, n)])
    rows, counts = np.unique(line[np.lexsort(line.T[::-1])], axis=0, return_counts=True)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], rows[:, 1]))]  # by the middle word, the word before, the follower
    key, counts = np.unique(rows[:, [1, 0, 2]], axis=0, return_counts=True)
    counts = r.integers(1, 6, len(key))
    roots, n_before, before, n_triples, followers, n_followers, follower = [], [], [], [], [], [], []
    for root in np.unique(key[:, 0]):
        own = key[key[:, 0] == root]
        mine = np.unique(own[:, 2])
        roots.append(root)
        n_followers.append(len(mine))
        followers += mine.tolist()
        b, k = np.unique(own[:, 1], return_counts=True)
        n_before.append(len(b))
        before += b.tolist()
        n_triples += k.tolist()
        follower += np.searchsorted(mine, own[:, 2]).tolist()
    u, i = (lambda x: np.asarray(x, np.uint64)), (lambda x: np.asarray(x, np.int64))
    tree = ngram_trie._Nested(u(roots), i(n_followers), u(followers), i(n_before), u(before), i(n_triples), i(follower), counts)
    raw, hot, mass, *_ = ngram_trie.build_trie(iter([tree]), {})
    trie = ngram_trie.Trie.mapped(raw)
    chance2, back2, chance3, back3 = map(ngram_trie.probability, trie.query(tree))
    for c in range(len(before)):
        at = np.flatnonzero(tree.of_triple == c)
        assert abs(chance3[at].sum() + back3[at[0]] - 1) < 2e-3
    for k in range(len(roots)):
        at = np.flatnonzero(tree.of_before[tree.of_triple] == k)
        own = {f: p for f, p in zip(tree.follower[at].tolist(), chance2[at].tolist(), strict=True)}
        assert abs(sum(own.values()) + back2[at[0]] - 1) < 2e-3
    missing = ngram_trie._Nested(u([*roots, 99]), i([1] * (len(roots) + 1)), u([7777] * (len(roots) + 1)), i([1] * (len(roots) + 1)), u([5] * (len(roots) + 1)), i([1] * (len(roots) + 1)), i([0] * (len(roots) + 1)), counts[: len(roots) + 1])
    a, b, c, d = trie.query(missing)
    assert (a == 0).all() and (c == 0).all() and b[-1] == d[-1] == 1
    assert hot == [] and mass == []


@pytest.mark.parametrize(("bits", "n"), [(3, 3000), (20, 3000), (40, 3000), (63, 3000), (63, 3), (63, 9), (62, 40)])
def test_elias_fano_finds_what_it_holds(bits, n):
    r = np.random.default_rng(bits)
    v = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64))
    e = ngram_trie.EliasFano(ngram_trie.EliasFano.encode(v))
    asked = np.unique(np.concatenate([v, v + np.uint64(1), r.integers(0, 1 << bits, 2000, dtype=np.uint64)]))
    where = {x: i for i, x in enumerate(v.tolist())}
    assert e.find(asked).tolist() == [where.get(x, -1) for x in asked.tolist()]
    assert e.at(np.arange(len(v))).tolist() == v.astype(np.int64).tolist()
    assert e.find(asked, np.zeros(len(asked), bool)).max() == -1


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 2**63], list(range(0, 10**6, 7)), [2**64 - 1]])
def test_elias_fano(values):
    v = np.asarray(values, np.uint64)
    e = ngram_trie.EliasFano(ngram_trie.EliasFano.encode(v))
    assert e.values().tolist() == v.tolist()


def shingles(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", text_of(t).translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (1, 60)])
def test_near_duplicates(spark, words, percent):
    r = random.Random(9)
    texts = [None, "", "a b", "A B", *(prose(r, r.randrange(1, 12)) for _ in range(60))]
    for _ in range(4):
        base = prose(r, 80).split()
        for _ in range(25):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = f"w{r.randrange(9)}"
            texts.append(" ".join(own))
    sets = [shingles(t, words) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in shingle_join.near_duplicates(docs, words, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates_of_odd_rows(docs, rows):
    got = shingle_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t, 4))) for i, t, *_ in rows)


def test_blocks_of_short_texts_take_no_room_for_empty_shards():
    r = np.random.default_rng(4)
    shards, pool = 50_000, r.integers(0, 1 << 63, 40_000, np.uint64)
    block = [(i, np.unique(r.choice(pool, 8))) for i in range(20_000)]
    names = ["fps", "sizes", "steps", "lengths", "first", "again", "keys"]
    packed = dict(zip(names, shingle_join._Block.pack(block, shards), strict=True))
    assert sum(map(len, packed.values())) < 16 * sum(len(k) for _, k in block)
    b = shingle_join._Block.unpack(packed)
    assert (b.fps == np.arange(len(block))).all() and (b.sizes == [len(k) for _, k in block]).all()
    low = shingle_join._from_low_bytes(packed["keys"])
    every = np.concatenate([k for _, k in block])
    held = np.empty(len(every), np.int64)
    held[b.order] = b.held
    assert (low[held] == (every & np.uint64(0xFFFFFF)).astype(np.int64)).all()
    sent = np.repeat(b.shards, np.diff(b.edges))
    assert (sent[held] == shingle_join._shard(every, shards)).all()
    assert b.edges[-1] == len(np.unique(every))
    count = Counter(every.tolist())
    assert b.holders([])[held].tolist() == [count[k] for k in every.tolist()]


def test_fingerprints(docs, rows):
    prints = order_minhash.with_next(order_minhash.fingerprints(docs)).collect()
    assert len(prints) == len(rows)
    by_text = defaultdict(set)
    for p, t in ((p, next(t for i, t, *_ in rows if i == p.doc_id and len(text_of(t)) == p.n_chars)) for p in prints):
        by_text[text_of(t)].add(tuple(p.signature))
        assert 0 <= p.near_edited <= 1 and 0 <= p.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    ids = sorted({i for i, *_ in rows if i is not None})
    plain = {i: t for i, t, *_ in rows if i is not None and i not in (3,)}
    for p in prints:
        if p.doc_id in plain and p.doc_id + 1 in plain and p.doc_id != max(ids):
            t, n = text_of(plain[p.doc_id]), text_of(plain[p.doc_id + 1])
            q = len(t) // 4
            assert hashlib.sha256(p.edited.encode()).hexdigest() == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()


def test_order_matters_to_fingerprints(spark):
    r = random.Random(4)
    a = prose(r, 400).split()
    half = " ".join(a[200:] + a[:200])
    rows = spark.createDataFrame([(" ".join(a), half, " ".join(a[:350] + ["q"] * 50))], "a string, swapped string, edited string")
    s = lambda c: order_minhash.signatures(F.col(c))
    x = rows.select(order_minhash.likeness(s("a"), s("swapped")).alias("swapped"), order_minhash.likeness(s("a"), s("edited")).alias("edited"), order_minhash.likeness(s("a"), s("a")).alias("same")).first()
    assert x.same == 1 and x.swapped < 0.8 and x.edited > 0.4
