"""Columns computed from the text of each row, beside whatever other columns a table has."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwise.shared import BROADCAST_BYTES, stored


def give_back() -> None:
    """Hands freed memory back to the machine, where the C library can; a worker is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def with_features(docs: DataFrame, features: dict[str, str], reader: Callable[[], Callable[[str | None], tuple]]) -> tuple[DataFrame, str]:
    """`docs` with one more column, a struct of `features` (name -> type), and that column's name.  reader() is called once a task and
    gives the function that makes the features of a text."""
    name, at = free_name(docs, "features"), docs.columns.index("text")
    kinds = [pa.float64() if kind == "double" else pa.int64() for kind in features.values()]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in features.items())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            rows = [read(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names=list(features))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema), name


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`docs` stored with a number for each row, which every later read sees alike, and that column's name."""
    name = free_name(docs, "row_number")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), label), name


def without(docs: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """The rows of `docs` whose number is not in `dropped` (one column, `name`), sent to all tasks if it is small enough."""
    dropped = F.broadcast(dropped) if 16 * dropped.count() <= BROADCAST_BYTES else dropped
    return docs.join(dropped, name, "left_anti")
