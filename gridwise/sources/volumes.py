"""Four-dimensional image files as rows of voxels."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numeric types by code, as the file format numbers them.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode_volume(raw: bytes) -> tuple[np.ndarray, tuple[int, ...]]:
    """Values as (x*y*z, t) doubles, scaled as the header says, and the four dimensions."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    dims = struct.unpack_from(f"{order}8h", raw, 40)
    shape = tuple(max(1, d) for d in dims[1:5])
    code = struct.unpack_from(f"{order}h", raw, 70)[0]
    offset, slope, inter = struct.unpack_from(f"{order}3f", raw, 108)
    if code not in TYPES:
        raise ValueError(f"numeric type {code} is not read")
    n = int(np.prod(shape))
    y = np.frombuffer(raw, order + TYPES[code], n, int(offset)).astype(float)
    return (y * slope + inter if slope else y).reshape(shape[3], -1).T, shape


def encode_volume(values: np.ndarray, shape: tuple[int, int, int]) -> bytes:
    """The bytes of a file of 64-bit floats from (x*y*z, t) values."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, *shape, values.shape[1], 1, 1, 1)
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(values.T).astype("<f8").tobytes()


def volume_scan(spark: SparkSession, path: str) -> DataFrame:
    """path, unit, x, y_, z and y (values over time) of every voxel; files are read whole, one task each."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"))


def decoded(files: DataFrame) -> DataFrame:
    """The voxels of files given as (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y, (nx, ny, _, _) = decode_volume(raw)
                for at in range(0, len(y), 8192):
                    unit = np.arange(at, min(len(y), at + 8192))
                    part = y[unit]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * y.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(unit)), pa.array(unit), pa.array(unit % nx), pa.array(unit // nx % ny), pa.array(unit // (nx * ny)), lists], names=["path", "unit", "x", "y_", "z", "y"])

    return files.select("path", "content").mapInArrow(run, "path string, unit long, x long, y_ long, z long, y array<double>")


def volume_frames(spark: SparkSession, path: str) -> DataFrame:
    """path and number of frames, from the headers."""
    return frames(spark.read.format("binaryFile").load(path))


def frames(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_volume(x)[1][3] for x in batch.column(1).to_pylist()], pa.int64())], names=["path", "frames"])

    return files.select("path", "content").mapInArrow(run, "path string, frames long")


def write_results(table: DataFrame, path: str, *partitions: str) -> None:
    """Maps, metrics and series as Parquet, one folder a subject (or other keys)."""
    table.write.mode("append").partitionBy(*partitions).parquet(path)


def write_maps(maps: DataFrame, grid: DataFrame, path: str, shape: tuple[int, int, int], item: str, value: str) -> None:
    """Each item's map as the bytes of a volume (item, content), zeros off the mask."""
    full = grid.select("unit").crossJoin(F.broadcast(maps.select(item).distinct())).join(maps, [item, "unit"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    n = int(np.prod(shape))

    def run(frame):
        import pandas as pd

        y = np.zeros((n, 1))
        y[frame["unit"].to_numpy(), 0] = frame[value].to_numpy()
        return pd.DataFrame({item: [str(frame[item].iloc[0])], "content": [encode_volume(y, shape)]})

    full.groupBy(item).applyInPandas(run, f"{item} string, content binary").write.parquet(path)
