"""Reproducible shuffle into shards by a keyed permutation of row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwise.shared import stored, with_running_total


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A round function: 64-bit multiply-and-shift mixing of a half with a round key."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(rows: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the smallest even number of bits that holds
    n values; a value that leaves the range walks on through the network until it is back inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, rounds).tolist()
    out = rows.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        x = out[walking]
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[walking] = (left << shift) | right
        walking = out >= n
    return out.astype(np.int64)


def feistel_shards(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, row (global number), shard and slot of each document.

    Rows are numbered in the order of doc_id (nulls first; ties by checksum and size); the permuted number p gives
    shard p mod shards and slot p // shards, so shard sizes in rows differ by at most one and slots have no gap,
    whatever copies or long texts there are.  Null and empty texts count 8 bytes.  Rows with the same
    doc_id keep separate slots.  An empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    numbered, n = with_running_total(stored(narrow, "shard-sizes"), ["doc_id", "text_crc32", "size"], "one", "row", "shard-rows")
    numbered = numbered.drop("one")
    schema = T.StructType([*numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permuted(batch.column(batch.schema.get_field_index("row")).to_numpy(), n, seed)
            columns = [*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "shard", "slot"])

    return numbered.mapInArrow(deal, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 7) -> None:
    """Writes whole rows of `docs` (doc_id unique) as one folder for each shard, its rows in order of slot inside each file."""
    places = feistel_shards(docs, shards, seed).select(F.col("doc_id").alias("_id"), "shard", "slot")
    rows = docs.join(places, docs.doc_id.eqNullSafe(F.col("_id"))).drop("_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
