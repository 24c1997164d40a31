"""Scores do not hang on settings; blocks take any number of different words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridwise.llm import ngram_trie

SF = "/root/testdata/sf0.001"


def test_scores_do_not_depend_on_the_number_of_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 32):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.doc_id: r for r in ngram_trie.score(docs, F.col("doc_id") % 10 != 0).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, r in got[0].items():
        assert abs(r.score - got[1][i].score) <= 0.002 * r.n_tokens and abs(r.base_score - got[1][i].base_score) < 1e-6 * r.n_tokens
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lm_blocks")]


def test_a_text_of_millions_of_different_words():
    n = 2_200_000
    words = np.random.default_rng(0).permutation(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = {"lengths": ngram_trie._pack(np.asarray([n], "<i8")), "training": ngram_trie._pack(np.asarray([1], np.uint8)), "words": ngram_trie._pack(words.astype("<u8")), "tokens": ngram_trie._pack(np.arange(n, dtype="<u4"))}
    r = ngram_trie._Requests(row, 4, words[:1])
    at = r.by_two
    assert np.array_equal(r.succ[at], np.arange(n)) and np.array_equal(r.root[at] % r.m, np.concatenate([[n], np.arange(n - 1)]))
    assert np.array_equal(r.pred[at], np.concatenate([[n + 1, n], np.arange(n - 2)])) and r.counts.sum() == n + 1  # the heavy word's pair is asked twice
