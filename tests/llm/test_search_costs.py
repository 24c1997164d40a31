"""Low bits that a search of an Elias-Fano sequence reads."""

from __future__ import annotations

import numpy as np

from gridwise.llm import ngram_trie


def test_a_value_alone_with_its_high_bits_is_read_once(monkeypatch):
    values = np.arange(1000, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(7)
    held, low, read = ngram_trie.EliasFano(ngram_trie.EliasFano.encode(values)), ngram_trie.EliasFano._low, []
    monkeypatch.setattr(ngram_trie.EliasFano, "_low", lambda self, at: read.append(len(at)) or low(self, at))
    assert held.find(values).tolist() == list(range(1000))
    assert sum(read) == 1000
    assert held.find(np.asarray([0, 8, (1 << 63) + 5], np.uint64)).tolist() == [-1, -1, -1]
