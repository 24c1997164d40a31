"""Corpus pipeline: toxic documents go, low-quality documents go, near duplicates go, the rest is packed.

Every stage judges rows, not ids, so null and repeated doc_ids, empty texts, repeated rows and further columns of any name pass through
it; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwise.llm import packing, quality, rows, shingle_join, toxicity
from gridwise.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under a half, by a model learned from the labelled ones.  Empty and null texts stay."""
    model = toxicity.ToxicityModel.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Empty and null texts go, as they have fewer than 50 words."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): the one with the smallest doc_id,
    a null one last; of several such rows, one.  Texts without words are in no group and stay."""
    numbered, row = rows.numbered(docs, "numbered")
    groups = shingle_join.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80)
    several = groups.join(groups.groupBy("component_id").count().filter("count > 1").select("component_id"), "component_id").select(F.col("doc_id").alias(row), "component_id")
    ids = several.join(numbered.select(row, F.col("doc_id").alias("own_id")), row)
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull(), "own_id", row)).alias("first"))
    dropped = stored(ids.join(first, "component_id").filter(F.col(row) != F.col(f"first.{row}")).select(row), "dropped")
    return rows.without(numbered, row, dropped).select(*rows.own_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, along the curve of similar documents; every row's text is packed, an empty one as its end id alone."""
    return packing.pack_along_curve(docs)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("ngram_jaccard_join", drop_near_duplicates), ("packing", pack)]

#: Not expressible in SQL: a learned grammar and an encoding decide; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each to the stored result of the one before.  Returns the pieces of the packed documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
