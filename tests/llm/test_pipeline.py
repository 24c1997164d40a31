"""The pipeline's stages against brute force, over odd rows and clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridwise.llm import quality, queries, toxicity
from tests.llm.test_operators import ids_of, prose

SF = "/root/testdata/sf0.001"
#: Names that the stages use themselves.
CLASHES = "score predicted total rate features row_number _kept _again _text n_words kept posterior ids own_id component_id fp n count first block".split()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(12)
    base = prose(r, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, " ".join(near), base, None, "", " \n ", "two words", prose(r, 200), "you stupid idiot loser trash " * 3 + prose(r, 90), *(prose(r, r.randrange(60, 150)) for _ in range(12))]
    ids = [5, 4, None, 6, 7, 8, 9, 5, 11, *range(20, 32)]
    rows = [*zip(ids, texts, strict=True), (5, texts[7]), (None, texts[7]), (None, None)]
    out = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in CLASHES:
        out = out.withColumn(c, F.lit(f"own {c}"))
    return out.select("doc_id", *CLASHES[:7], "text", *CLASHES[7:])


def as_rows(df):
    return Counter(map(tuple, df.collect()))


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_and_takes_an_empty_table(spark, docs, stage):
    got = stage(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert not as_rows(got) - as_rows(docs)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_toxicity_stage(spark, docs):
    model = toxicity.ToxicityModel.fit(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    words = toxicity.WordTransducer(model.entries)
    expected = Counter()
    for row in docs.collect():
        z = np.dot(toxicity.document_features(row.text, words), model.weights[:-1]) + model.weights[-1]
        expected[tuple(row)] += z < 0
    assert as_rows(corpus_pipeline.drop_toxic(spark, docs, SF)) == +expected
    assert sum(expected.values()) == docs.count() - 1


def test_quality_stage(spark, docs):
    rows = docs.collect()
    by_place = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    kept = {x.doc_id for x in quality.quality(by_place).filter("kept").collect()}
    assert as_rows(corpus_pipeline.drop_low_quality(spark, docs, SF)) == Counter(tuple(r) for i, r in enumerate(rows) if i in kept)
    assert 10 < len(kept) < len(rows)


def test_near_duplicate_stage(spark, docs):
    rows = docs.collect()
    sets = [shingles(r.text, 5) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(rows[i])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert len(got) == len(members)
    first = Counter(min((r.doc_id is None, r.doc_id or 0, r.text or "") for r in m)[:2] for m in members.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == first


def test_packing_stage(spark, docs):
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    assert sum(sizes.values()) == sum(len(ids_of(r.text)) for r in docs.collect())
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def test_run_applies_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = {r.doc_id: ids_of(r.text) for r in docs.collect()}
    seen = Counter()
    for p in corpus_pipeline.run(spark, SF).collect():
        assert zlib.crc32(np.asarray(kept[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        seen[p.doc_id] += p.length
    assert seen == {i: len(x) for i, x in kept.items()}


def test_sql_of_the_join(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.execute(queries.oracle_sql()["op10_shingle_join"]).fetchall()
    got = queries.op10_shingle_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
