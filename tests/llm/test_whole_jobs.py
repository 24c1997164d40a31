"""Registered document queries do the whole job on the given tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from gridwise.llm import packing, quality, queries

SF = "/root/testdata/sf0.001"


def test_best_fit_query_writes_matrices(spark):
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    pieces = packing.pack_best_fit(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    seen = Counter()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False)):
            assert positions[a:b].tolist() == list(range(b - a)) and zlib.crc32(ids[a:b].tobytes()) == r.ids_crc32[k]
            seen[r.doc_id[k], r.start[k], b - a, r.ids_crc32[k], r.doc_tokens[k], a] += 1
    assert seen == Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens, p.offset) for p in pieces)


def test_quality_does_not_fall_with_length(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) + r.choice(["", "", "", "."]) for _ in range(n))) for i, n in enumerate((900, 5000, 60_000, 300_000))]
    rows.append((4, " ".join(r.choice(words[:100]) for _ in range(60_000))))  # few words indeed
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        assert (got[i].vote_prose, got[i].vote_variety, got[i].kept) == (1, 0, True)
    assert (got[4].vote_prose, got[4].vote_variety, got[4].kept) == (0, -1, False)
