"""Pairs that merging asks for, and the cuts made without the pattern."""

from __future__ import annotations

import numpy as np

from gridwise.llm import lexicon


def test_merging_asks_only_for_pairs_that_are_new(monkeypatch):
    words = ["thennden", "ofthtionouhe", "einzubeenchgeß", "aaaaaaaaaaaaaaaa", "x", "日本語"] * 50
    merges, search, asked = lexicon.Merges(), np.searchsorted, []
    monkeypatch.setattr(lexicon.np, "searchsorted", lambda a, v, *more, **named: asked.append(np.size(v)) or search(a, v, *more, **named))
    ids, lengths = merges([w.encode() for w in words])
    monkeypatch.undo()
    assert ids.tolist() == [i for w in words for i in merges.of_long(w.encode())] and lengths.sum() == len(ids)
    assert sum(asked) <= 2 * (sum(len(w.encode()) for w in words) - len(ids))  # two for each merge; pairs of bytes come from a table


def test_white_space_and_pieces_equal_the_pattern():
    space = lexicon.regex.compile(r"[\s\x1c-\x1f]")
    assert {c for c in map(chr, range(0x110000)) if space.match(c)} == {" ", "\n", *lexicon._RARE_SPACE}
    for a in (" ", "\n", *lexicon._RARE_SPACE):
        for b in (" ", "\n", "x", *lexicon._RARE_SPACE):
            assert lexicon._has_run(f"é{a}{b}x") == bool(lexicon._RUN.search(f"é{a}{b}x"))
    for w in ("", " ", "a", " a", "ab.", " ab,", "éß!", "a1.", "a..", ".", " .", "it's", "a'", "a.b", "ab\t", " ab\x1c", "x²", "x²."):
        assert lexicon._pieces(w) == lexicon.PATTERN.findall(w)
