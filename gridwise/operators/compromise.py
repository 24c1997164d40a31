"""Compromise of the similarity matrices of many subjects: their weights, scores of the items, and resampled confidence regions.

A pair of items is a row that holds one value a subject, so subjects meet in one Gram matrix that tasks add up from their own pairs, and a
resample of subjects is a row of weights: no matrix is made again for it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwise.operators import gram as G
from gridwise.shared import BROADCAST_BYTES, stored


def feature_similarity(features: DataFrame, item: str, subject: str, values: Sequence[str]) -> DataFrame:
    """subject, i, j, value: sums over columns of products of two items' values, each column standardised inside its subject (0 where it is
    constant or null).  A matrix a subject is what a compromise starts from, so all pairs of a subject's items are meant."""
    w = Window.partitionBy(subject)
    z = features.select(subject, item, *(((F.col(v) - F.avg(v).over(w)) / F.nullif(F.stddev_samp(v).over(w), F.lit(0.0))).alias(v) for v in values)).fillna(0.0, list(values))
    a, b = z.toDF("subject", "i", *(f"a_{v}" for v in values)), z.toDF("subject", "j", *(f"b_{v}" for v in values))
    return a.join(b, "subject").select("subject", "i", "j", sum((F.col(f"a_{v}") * F.col(f"b_{v}") for v in values), F.lit(0.0)).alias("value"))


def pair_rows(similarity: DataFrame, distances: bool = False) -> DataFrame:
    """i, j, y: for each pair of items that all subjects have, the subjects' values in order of subject; each matrix centred on both sides
    and divided by its largest singular value (left as it is where that is 0).  Null values count as 0."""
    items = similarity.groupBy("i").agg(F.count_distinct("subject").alias("_n"))
    whole = items.join(F.broadcast(similarity.agg(F.count_distinct("subject").alias("_n"))), "_n").select("i")  # the right side is one row
    own = similarity.join(whole, "i").join(whole.withColumnRenamed("i", "j"), "j")
    kind = next(f.dataType.simpleString() for f in similarity.schema.fields if f.name == "i")
    subject = next(f.dataType.simpleString() for f in similarity.schema.fields if f.name == "subject")

    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        m = frame.pivot_table(index="i", columns="j", values="value", aggfunc="first", fill_value=0.0).sort_index().sort_index(axis=1)
        c = np.eye(len(m)) - 1 / len(m)
        s = (-0.5 if distances else 0.5) * c @ m.to_numpy(float) @ c
        top = np.linalg.svd(s, compute_uv=False)[0]
        s = s / top if top > 0 else s
        i, j = np.meshgrid(m.index, m.columns, indexing="ij")
        return pd.DataFrame({"subject": frame["subject"].iloc[0], "i": i.ravel(), "j": j.ravel(), "value": s.ravel()})

    scaled = own.select("subject", "i", "j", F.coalesce("value", F.lit(0.0)).alias("value")).groupBy("subject").applyInPandas(centre, f"subject {subject}, i {kind}, j {kind}, value double")
    return scaled.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("subject", "value"))), lambda p: p["value"]).alias("y"))


def subject_weights(g: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each subject (sum 1) in the compromise of a drawn list of them, and the first component's share: the first eigenvector of the RV
    coefficients, from the products `g` of all subjects' matrices.  A subject drawn twice has the sum of two weights."""
    size = np.sqrt(np.diag(g))
    scale = np.where(size > 0, size, 1.0)
    rv = g / np.outer(scale, scale)
    np.fill_diagonal(rv, 1.0)
    values, vectors = np.linalg.eigh(rv[np.ix_(drawn, drawn)])
    first = vectors[:, -1] / vectors[:, -1].sum()
    return np.bincount(drawn, first, minlength=len(g)), float(values[-1] / values.sum())


def resampled_weights(grams: DataFrame, resamples: int, seed: int = 42) -> DataFrame:
    """resample (-1: all subjects once), place (of the subject), weight, explained: for lists of as many subjects, drawn with replacement.

    The matrix of subjects goes to every task if it is small, else it is joined to resamples of a partition each."""
    spark = grams.sparkSession
    rows = grams.agg(F.max(F.size("gram")).alias("n")).first()
    ids = spark.range(-1, resamples).withColumnRenamed("id", "resample")
    small = 8 * (rows.n or 0) <= BROADCAST_BYTES
    if small:
        row = grams.select("gram").first()
        held = spark.sparkContext.broadcast(np.asarray(row.gram, float) if row else np.zeros(0))
    else:
        held, ids = None, ids.repartition(resamples + 1, "resample").crossJoin(grams.select("gram"))  # one row

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                flat = held.value if held is not None else np.asarray(r["gram"], float)
                n = round(len(flat) ** 0.5)
                if n:
                    drawn = np.arange(n) if r["resample"] < 0 else np.random.default_rng((seed, r["resample"])).integers(n, size=n)
                    weight, share = subject_weights(flat.reshape(n, n), drawn)
                    out += [(r["resample"], i, w, share) for i, w in enumerate(weight)]
            yield pd.DataFrame(out, columns=["resample", "place", "weight", "explained"])

    return ids.mapInPandas(run, "resample long, place int, weight double, explained double")


def distatis(similarity: DataFrame, resamples: int = 500, distances: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two tables.  (subject, weight, explained): weights in the compromise.  (item, f1, f2, share1, share2, x, y, major, minor, angle): the item's scores on
    the two first components of the compromise with their shares, the mean of its scores in the resamples, and the half-axes and angle (of the longer
    one, in radians) of the ellipse that holds 95% of them.

    `similarity`: subject, i, j, value, all pairs both ways.  Items that a subject lacks are left out.  An empty table gives empty ones; with fewer
    than two resamples the ellipses are null.
    """
    spark = similarity.sparkSession
    pairs = stored(pair_rows(similarity, distances), "pairs")
    grams = stored(G.gram(pairs.withColumn("_all", F.lit(1)), ["_all"]), "subjects-gram")
    weights = stored(resampled_weights(grams, resamples, seed), "resample-weights")
    places = similarity.agg(F.sort_array(F.collect_set("subject")).alias("_s")).select(F.posexplode("_s").alias("place", "subject"))
    own = weights.filter("resample = -1")
    subjects = own.join(places, "place").select("subject", "weight", "explained")

    item = next(f.dataType.simpleString() for f in pairs.schema.fields if f.name == "i")
    one = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "weight"))), lambda p: p["weight"]).alias("_w"))  # one row, a weight a subject
    dot = F.aggregate(F.zip_with("y", "_w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def axes(frame: pd.DataFrame) -> pd.DataFrame:
        m = frame.pivot(index="i", columns="j", values="s").sort_index().sort_index(axis=1)
        values, vectors = np.linalg.eigh((m.to_numpy() + m.to_numpy().T) / 2)
        order = np.argsort(-np.abs(values))[:2]
        v, size, total = vectors[:, order], np.abs(values[order]), np.abs(values).sum()
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        v, size = (np.hstack([v, np.zeros((len(m), 1))]), np.append(size, 0.0)) if len(size) < 2 else (v, size)
        root = np.sqrt(size)
        back = np.divide(v, root, out=np.zeros_like(v), where=size > 1e-12 * max(total, 1e-300))
        return pd.DataFrame({"item": m.index, "f1": v[:, 0] * root[0], "f2": v[:, 1] * root[1], "share1": size[0] / total if total else 0.0, "share2": size[1] / total if total else 0.0, "r1": back[:, 0], "r2": back[:, 1]})

    compromise = pairs.crossJoin(F.broadcast(one)).select("i", "j", dot.alias("s"), F.lit(1).alias("_all"))
    scores = stored(compromise.groupBy("_all").applyInPandas(axes, f"item {item}, f1 double, f2 double, share1 double, share2 double, r1 double, r2 double"), "compromise")  # items squared
    back = scores.select(F.col("item").alias("j"), "r1", "r2")
    projected = pairs.join(back, "j").select("i", F.posexplode("y").alias("place", "v"), "r1", "r2").groupBy("i", "place").agg(F.sum(F.col("v") * F.col("r1")).alias("p1"), F.sum(F.col("v") * F.col("r2")).alias("p2"))
    drawn = weights.filter("resample >= 0 AND weight <> 0").select("resample", "place", "weight")
    points = projected.join(drawn, "place").groupBy(F.col("i").alias("item"), "resample").agg(F.sum(F.col("p1") * F.col("weight")).alias("x"), F.sum(F.col("p2") * F.col("weight")).alias("y"))
    regions = points.groupBy("item").applyInPandas(lambda f: pd.DataFrame([(f["item"].iloc[0], *ellipse(f[["x", "y"]].to_numpy()))], columns=["item", "x", "y", "major", "minor", "angle"]), f"item {item}, x double, y double, major double, minor double, angle double")
    return subjects, scores.drop("r1", "r2").join(regions, "item", "left")


def ellipse(points: np.ndarray, share: float = 0.95) -> tuple[float, float, float | None, float | None, float | None]:
    """Mean of points and the half-axes and angle of the ellipse along their principal axes, in proportion to their spread, through the point
    that is in place round(share * n) by Mahalanobis distance.  Points on a line have a minor axis of 0; those that all agree, two."""
    middle = points.mean(axis=0)
    if len(points) < 2:
        return float(middle[0]), float(middle[1]), None, None, None
    u, size, v = np.linalg.svd(points - middle, full_matrices=False)
    q = u * size
    spread = q.var(axis=0, ddof=1)
    live = spread > 1e-24 * max(1.0, float((middle**2).sum()))
    if not live.any():
        return float(middle[0]), float(middle[1]), 0.0, 0.0, 0.0
    far = (q[:, live] ** 2 / spread[live]).sum(axis=1)
    edge = q[np.argsort(far, kind="stable")[max(1, int(share * len(points) + 0.5)) - 1]]
    ratio = size[1] / size[0] if live.all() else 0.0
    major = float(np.sqrt(edge[0] ** 2 + (edge[1] / ratio) ** 2)) if ratio else float(abs(edge[0]))
    return float(middle[0]), float(middle[1]), major, major * float(ratio), float(np.arctan2(v[0, 1], v[0, 0]) if v[0, 0] > 0 else np.arctan2(-v[0, 1], -v[0, 0]))
