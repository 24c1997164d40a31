"""Tables that cut lineage, in the folder that the whole cluster shares, and numbering without a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is sent whole to every task only if it is at most so large; beyond that it is joined.
BROADCAST_BYTES = 64 << 20
#: Removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a folder of this machine only where that is unset and
    Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="gridwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder: later reads need no executor that made them.  The shuffle files of the
    write go with its end, since nothing reads them again, so steps do not add up on the disks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def beside_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with the columns of `groups`, one row a group of `keys` (null keys meet), without bringing a group's rows together: groups go to
    every task while they are few, and are joined beyond that."""
    groups = stored(groups, "groups")  # read for its size, then for its rows
    if not keys:
        return rows.crossJoin(F.broadcast(groups))
    own = groups.select(*(F.col(k).alias(f"_own_{k}") for k in keys), *(c for c in groups.columns if c not in keys))
    few = groups.count() * len(groups.columns) * 64 <= BROADCAST_BYTES
    on = [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys]
    return rows.join(F.broadcast(own) if few else own, on, "inner").drop(*(f"_own_{k}" for k in keys))


def with_running_total(df: DataFrame, order: list[str], weight: str, out: str, label: str) -> tuple[DataFrame, int]:
    """Adds `out`: the sum of the long column `weight` over all earlier rows in `order`; also returns the sum over all rows.

    Rows are dealt out by range (ties on the first columns split by the later ones), summed inside each partition and
    shifted by the sums of the earlier partitions; the driver sees one number for each partition.  Rows that tie on
    all of `order` get distinct places in an unspecified order; the result is stored, so the places stay as they are.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            w = batch.column(batch.schema.get_field_index(weight)).to_numpy(zero_copy_only=False)
            ends = before + w.cumsum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - w, pa.int64())], names=[*batch.schema.names, "_before"])
            before = int(ends[-1]) if len(w) else before

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    numbered = stored(dealt.mapInArrow(sums, schema), label)
    total, starts = 0, []
    for part, own in sorted(numbered.groupBy("_part").agg(F.sum(weight)).collect()):
        starts.append((part, total))
        total += own
    parts = spark.createDataFrame(starts, "_part int, _start long")  # a row for each partition
    placed = numbered.join(F.broadcast(parts), "_part").withColumn(out, F.col("_start") + F.col("_before"))
    return placed.drop("_part", "_before", "_start"), total
