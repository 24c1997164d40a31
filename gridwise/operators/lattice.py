"""Maps on a three-dimensional grid: rows of keys, x, y_, z and a value."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwise.shared import beside_groups, stored

AXES = ("x", "y_", "z")


def lattice_gradient(grid: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Central differences along each axis (one-sided at the ends): fx, fy_, fz."""
    out = grid
    for axis in AXES:
        w = Window.partitionBy(*keys, *(a for a in AXES if a != axis)).orderBy(axis)
        a, b, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        d = F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - here).when(b.isNull(), here - a).otherwise((b - a) / 2)
        out = out.withColumn(f"f{axis}", d)
    return out


def lattice_dilate(seed: DataFrame, keys: Sequence[str], size: tuple[int, int]) -> DataFrame:
    """In each slice, the seed's cells and their four neighbours inside the grid."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))).alias("s")
    moved = seed.select(*keys, "x", "y_", "z", steps).select(*keys, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y_") + F.col("s.dy")).alias("y_"), "z")
    return moved.filter(F.col("x").between(0, size[0] - 1) & F.col("y_").between(0, size[1] - 1)).distinct()


def lattice_crop(grid: DataFrame, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """Cells with low <= axis <= high, counted from low."""
    for axis in low:
        grid = grid.filter(F.col(axis).between(low[axis], high[axis])).withColumn(axis, F.col(axis) - low[axis])
    return grid


def lattice_pad(grid: DataFrame, value: str, keys: Sequence[str], axis: str, before: int, after: int) -> DataFrame:
    """Adds layers of zeros before and after along an axis."""
    others = [a for a in AXES if a != axis]
    ends = grid.groupBy(*keys).agg((F.max(axis) + before).alias("_end"))
    moved = beside_groups(grid, ends, keys).withColumn(axis, F.col(axis) + before)
    lines = moved.select(*keys, *others, "_end").distinct()
    layers = F.concat(F.sequence(F.lit(0), F.lit(before - 1)) if before else F.array(), F.transform(F.sequence(F.lit(1), F.lit(after)), lambda i: i + F.col("_end").cast("int")) if after else F.array())
    zeros = lines.select(*keys, *others, F.explode(layers.cast("array<bigint>")).alias(axis)).withColumn(value, F.lit(0.0))
    return moved.select(*keys, *AXES, value).unionByName(zeros.select(*keys, *AXES, value))


def lattice_flip(grid: DataFrame, keys: Sequence[str], axis: str = "x") -> DataFrame:
    """Mirrors an axis between its least and greatest value in each group."""
    ends = grid.groupBy(*keys).agg((F.min(axis) + F.max(axis)).alias("_m"))
    return beside_groups(grid, ends, keys).withColumn(axis, F.col("_m") - F.col(axis)).drop("_m")


def symmetric_template(maps: DataFrame, value: str, subject: str, jacobian: DataFrame | None = None) -> DataFrame:
    """Mean over subjects averaged with its mirror along x; times a map of volume changes (x, y_, z, jacobian) if given."""
    mean = stored(maps.groupBy(*AXES).agg(F.avg(value).alias(value)), "template")  # read twice
    mirror = lattice_flip(mean, ()).withColumnRenamed(value, "_mirror")
    out = mean.join(mirror, list(AXES)).select(*AXES, ((F.col(value) + F.col("_mirror")) / 2).alias(value))
    return out if jacobian is None else out.join(jacobian, list(AXES)).withColumn(value, F.col(value) * F.col("jacobian")).drop("jacobian")


def lattice_smooth(grid: DataFrame, value: str, keys: Sequence[str], fwhm: float, cell: float = 1.0) -> DataFrame:
    """Gaussian smoothing, one axis after the other; weights are renormalised at the edges of the grid."""
    sigma = fwhm / cell / math.sqrt(8 * math.log(2))
    reach = max(1, math.ceil(3 * sigma))
    kernel = {o: math.exp(-o * o / (2 * sigma * sigma)) for o in range(-reach, reach + 1)}
    for axis in AXES:
        w = Window.partitionBy(*keys, *(a for a in AXES if a != axis)).orderBy(axis)
        shifted = {o: F.col(value) if o == 0 else (F.lag(value, -o) if o < 0 else F.lead(value, o)).over(w) for o in kernel}
        total = sum((F.coalesce(s * kernel[o], F.lit(0.0)) for o, s in shifted.items()), F.lit(0.0))
        weight = sum((F.when(s.isNotNull(), kernel[o]).otherwise(0.0) for o, s in shifted.items()), F.lit(0.0))
        grid = grid.withColumn(value, total / weight)
    return grid


def slice_time_shift(series: DataFrame, keys: Sequence[str], shift) -> DataFrame:
    """Moves each unit to a common time origin by linear interpolation at t + shift (a column between -1 and 1); ends repeat."""
    w = Window.partitionBy(*keys).orderBy("t")
    after, before = F.coalesce(F.lead("y").over(w), F.col("y")), F.coalesce(F.lag("y").over(w), F.col("y"))
    out = series.withColumn("_s", shift).withColumn("_a", after).withColumn("_b", before)
    return out.withColumn("y", F.when(F.col("_s") >= 0, F.col("y") + F.col("_s") * (F.col("_a") - F.col("y"))).otherwise(F.col("y") - F.col("_s") * (F.col("_b") - F.col("y")))).drop("_s", "_a", "_b")
