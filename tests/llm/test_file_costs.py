"""Files that fingerprints write on the way."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from gridwise.llm import order_minhash
from gridwise.shared import shared_folder


def test_ids_by_range_are_a_file_a_core(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id").cast("string"), F.lit("two three four")).alias("text"))
    folder, before = Path(shared_folder(spark).removeprefix("file:")), spark.conf.get("spark.sql.shuffle.partitions")
    there = set(folder.glob("*"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = order_minhash.fingerprints(docs).select("doc_id", "next_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(tuple(r) for r in rows) == [(i, (i + 1) % 5000) for i in range(5000)]
    new = set(folder.glob("*")) - there
    assert len(new) == 1
    assert len([*new.pop().glob("part-*")]) <= spark.sparkContext.defaultParallelism
