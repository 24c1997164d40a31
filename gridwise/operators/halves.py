"""Components over subjects that random halves of the subjects reproduce.

Units enter through the Gram matrix of subjects.  A resample is a row of its own and gives weights over subjects, not maps; the mean map of all
resamples is that of the mean weights, so units are projected once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwise.operators import gram as G
from gridwise.operators.canonical import _upper_tail
from gridwise.operators.stats import fdr
from gridwise.shared import stored


def halved(g: np.ndarray, sums: np.ndarray, n: int, k: int, order: np.ndarray) -> list[tuple]:
    """(component, R, share of variance, weights of the reproducible map) for one order of the subjects, cut in half: components of each half by
    falling variance, signs as in the components of all."""
    cut = len(g) // 2
    if not cut:
        return []
    _, reference = G.eigen(g)
    found = []
    for part in (order[:cut], order[cut:]):
        values, vectors = G.eigen(g[np.ix_(part, part)])
        full = np.zeros((len(g), len(values)))
        full[part] = vectors
        found.append((full, values / values.sum() if len(values) else values))
    rows = []
    for i in range(min(k, cut, reference.shape[1], *(f.shape[1] for f, _ in found))):
        maps = [f[:, i] * (-1 if G._map_correlation(g, sums, n, f[:, i], reference[:, i]) < 0 else 1) for f, _ in found]
        r = G._map_correlation(g, sums, n, *maps)
        spread = [np.sqrt(max(m @ g @ m - (m @ sums) ** 2 / n, 1e-300) / max(n - 1, 1)) for m in maps]
        w = (maps[0] / spread[0] + maps[1] / spread[1]) / np.sqrt(2 * max(1 - r, 1e-12))
        rows.append((i + 1, r, float(found[0][1][i] + found[1][1][i]) / 2, w))
    return rows


def split_half_pca(packed: DataFrame, keys: Sequence[str], k: int, resamples: int = 50, level: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables.  (keys, component, R, positive, variance): medians over resamples of reproducibility and share of variance, and the share of positive R.
    (keys, unit, component, z): the mean reproducible map.  (keys, component, place, weight): weights of the subjects, of length 1.

    `packed`: keys, unit, y, with a value a subject in y.  With a `level`, units that do not pass false-discovery control have 0 in the map, and components
    of which at most a thousandth pass are left out of all tables.  At most as many components as the smaller half has subjects; fewer than two
    subjects, or an empty table, give no rows."""
    names = list(keys)
    grams = stored(G.gram(packed, names), "subjects-gram")
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema.fields if f.name in names)
    draws = packed.sparkSession.range(resamples).withColumnRenamed("id", "resample")
    each = grams.crossJoin(F.broadcast(draws)).repartition(resamples, "resample")  # a row a group and resample

    def run(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                n = len(row["sums"])
                order = np.random.default_rng((seed, row["resample"])).permutation(n)
                rows += [(*(row[c] for c in names), *r) for r in halved(np.asarray(row["gram"], float).reshape(n, n), np.asarray(row["sums"], float), int(row["n"]), k, order)]
            yield pd.DataFrame(rows, columns=[*names, "component", "r", "share", "w"])

    parts = stored(each.mapInPandas(run, f"{spec}, component int, r double, share double, w array<double>"), "halves")
    mean = parts.select(*names, "component", F.posexplode("w").alias("place", "v")).groupBy(*names, "component", "place").agg(F.avg("v").alias("v"))
    weights = stored(mean.groupBy(*names, "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda p: p["v"]).alias("w")), "halves-weights")
    summary = parts.groupBy(*names, "component").agg(F.median("r").alias("R"), F.avg((F.col("r") > 0).cast("double")).alias("positive"), F.median("share").alias("variance"))
    maps = G.back_project(packed, weights, names).withColumnRenamed("value", "z")

    def subjects(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                w = np.asarray(row["w"], float)
                v = np.asarray(row["gram"], float).reshape(len(w), len(w)) @ w
                rows += [(*(row[c] for c in names), row["component"], i, x) for i, x in enumerate(v / max(np.linalg.norm(v), 1e-300))]
            yield pd.DataFrame(rows, columns=[*names, "component", "place", "weight"])

    loads = weights.join(grams.select(*names, "gram"), names).mapInPandas(subjects, f"{spec}, component int, place int, weight double")
    if level is None:
        return summary, maps, loads
    group = [*names, "component"]
    marked = stored(fdr(maps.withColumn("p", _upper_tail("z")), "p", group, level).select(*group, "unit", "z", "passed"), "halves-map")
    kept = marked.groupBy(*group).agg(F.sum("passed").alias("_p"), F.count(F.lit(1)).alias("_n")).filter("_p > 0.001 * _n").select(*group)
    return summary.join(kept, group), marked.join(kept, group).select(*names, "unit", "component", (F.col("z") * F.col("passed")).alias("z")), loads.join(kept, group)
