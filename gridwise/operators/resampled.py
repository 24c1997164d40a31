"""Models over contrasts, resamples and groups, all from Gram matrices or additive sums; and small checks of designs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwise.operators import gram as G
from gridwise.shared import stored


def independent_columns(designs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The regressors (keys, k, y) that are independent of the others in their group."""
    names = list(keys)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in designs.schema.fields if f.name in (*names, "k"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k").reset_index(drop=True)
        kept = G.independent_columns(np.stack(frame["y"].to_numpy(), axis=1))
        return frame.loc[kept, [*names, "k"]]

    return designs.groupBy(*names).applyInPandas(run, out)


def design_condition(designs: DataFrame, keys: Sequence[str], order: int) -> DataFrame:
    """For each half: condition number, columns and rank of drift and regressors, all columns of length 1."""
    names = list(keys)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in designs.schema.fields if f.name in names)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame.sort_values("k")["y"].to_numpy(), axis=1).astype(float)
        cut, rows = -(-len(x) // 2), []
        for half, part in ((1, x[:cut]), (2, x[cut:])):
            d = np.hstack([G.legendre(len(part), order), part])
            norms = np.linalg.norm(d, axis=0)
            s = np.linalg.svd(d[:, norms > 0] / norms[norms > 0], compute_uv=False)
            rank = int((s > s[0] * len(d) * np.finfo(float).eps).sum())
            rows.append((*frame.iloc[0][names].tolist(), half, float(s[0] / max(s[-1], 1e-300)), d.shape[1], rank))
        return pd.DataFrame(rows, columns=[*names, "half", "condition", "columns", "rank"])

    return designs.groupBy(*names).applyInPandas(run, f"{spec}, half int, condition double, columns int, rank int")


def multi_contrast(grams: DataFrame, keys: Sequence[str], contrasts: dict[str, Callable[[int], np.ndarray]], half: Callable[[int], np.ndarray]) -> DataFrame:
    """The discriminant model of each contrast, with the contrast as a key."""
    out = None
    for name, classes in contrasts.items():
        one = G.model_lda(grams, keys, classes, half).withColumn("contrast", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def model_multi_lda(grams: DataFrame, keys: Sequence[str], contrasts: dict[str, Callable[[int], np.ndarray]], half: Callable[[int], np.ndarray]) -> DataFrame:
    """Means of R and P over pairs of classes, and the distance of those means to perfect."""
    m = multi_contrast(grams, keys, contrasts, half).groupBy(*keys).agg(F.avg("R").alias("R"), F.avg("P").alias("P"), F.count(F.lit(1)).alias("pairs"))
    return m.withColumn("dPR_avg", -F.sqrt(F.pow(1 - F.col("R"), 2) + F.pow(1 - F.col("P"), 2)))


def concatenated(series: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row a unit with the centred series of all subjects laid end to end (in the given order), for models across subjects."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("subject"))
    x = series.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("subject", "unit"))).withColumn("_p", place)
    rows = x.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "t", "y"))), lambda p: p["y"]).alias("y"))
    return rows.withColumn("all", F.lit(1))


def model_lda_group(grams: DataFrame, subjects: int, scans: int, classes: Callable[[int], np.ndarray], splits: Sequence[Sequence[int]], share: float = 0.3) -> DataFrame:
    """Medians of R, P and accuracy over splits of subjects (`splits`: 1 or 2 for each subject), of the best number of components."""

    def use(g, s, n):
        found = []
        for split in splits:
            half = np.repeat(np.asarray(split), scans)
            rows = G.split_half_lda(g, s, n, np.tile(classes(scans), subjects), half, share)
            found.append(min(rows, key=lambda x: (round(x[4], 12), x[0])))
        m = np.median(np.asarray(found, float), axis=0)
        return [(float(m[1]), float(m[2]), float(m[3]), -float(np.hypot(1 - m[1], 1 - m[2])))]

    return G.per_group(grams, ["all"], "R double, P double, Acc double, dPR double", use)


def _svm(kernel: np.ndarray, classes: np.ndarray, cost: float, sweeps: int = 200) -> np.ndarray:
    """Dual weights of a linear support-vector machine with its bias in the kernel, by coordinate descent."""
    k = kernel + kernel.diagonal().mean()
    alpha, f = np.zeros(len(k)), np.zeros(len(k))
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(k)):
            new = min(cost, max(0.0, alpha[i] + (1 - classes[i] * f[i]) / max(k[i, i], 1e-12)))
            step = new - alpha[i]
            if step:
                f += step * classes[i] * k[:, i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-6 * cost:
            break
    return alpha * classes


def model_svm(grams: DataFrame, keys: Sequence[str], classes: Callable[[int], np.ndarray], half: Callable[[int], np.ndarray], costs: Sequence[float] = (0.01, 1.0, 100.0)) -> DataFrame:
    """Linear support-vector machines of both halves in kernel space: the cost nearest to perfect."""

    def use(g, s, n):
        c, h = classes(len(g)), half(len(g))
        scale, best = np.trace(g) / len(g), None
        for cost in costs:
            maps, acc = [], []
            for i in (1, 2):
                own, other = np.flatnonzero((h == i) & (c != 0)), np.flatnonzero((h != i) & (c != 0))
                w = np.zeros(len(g))
                w[own] = _svm(g[np.ix_(own, own)] / scale, c[own].astype(float), cost)
                bias = (g[np.ix_(own, own)] / scale).diagonal().mean() * w.sum()
                acc.append(float((np.sign(g[other] @ w / scale + bias) == c[other]).mean()))
                maps.append(w)
            r, p = G._map_correlation(g, s, n, *maps), float(np.mean(acc))
            d = float(np.hypot(1 - r, 1 - p))
            if best is None or d < best[3] - 1e-12:
                best = (cost, r, p, d)
        return [(best[0], best[1], best[2], -best[3])]

    return G.per_group(grams, keys, "cost double, R double, Acc double, dPR double", use)


def component_match(grams: DataFrame, keys: Sequence[str], k: int, half: Callable[[int], np.ndarray]) -> DataFrame:
    """Components of the second half matched one to one to those of the first, greatest correlation first, with the sign that agrees."""

    def use(g, s, n):
        h, maps = half(len(g)), []
        for i in (1, 2):
            m = np.diag((h == i).astype(float))
            values, vectors = G.eigen(m @ g @ m)
            maps.append(vectors[:, :k])
        r = np.array([[G._map_correlation(g, s, n, a, b) for b in maps[1].T] for a in maps[0].T])
        left, rows = np.abs(r), []
        for _ in range(min(r.shape)):
            i, j = np.unravel_index(left.argmax(), left.shape)
            rows.append((int(i) + 1, int(j) + 1, int(np.sign(r[i, j]) or 1), float(abs(r[i, j]))))
            left[i], left[:, j] = -1, -1
        return rows

    return G.per_group(grams, keys, "component int, matched int, sign int, r double", use)


def gaussian_gen_error(grams: DataFrame, keys: Sequence[str], k: int, half: Callable[[int], np.ndarray]) -> DataFrame:
    """Mean negative log likelihood of each half's scans under the other half's k-dimensional Gaussian subspace with isotropic rest."""

    def use(g, _s, n):
        h, out = half(len(g)), []
        for i in (1, 2):
            own, other = h == i, h != i
            values, vectors = G.eigen(g[np.ix_(own, own)] / own.sum())
            q = min(k, len(values) - 1)
            rest = max(values[q:].sum() / max(1, n - q), 1e-12)
            scores = (g[np.ix_(other, own)] @ vectors[:, :q]) / np.sqrt(values[:q] * own.sum())
            inside = (scores**2 / values[:q]).sum(axis=1)
            outside = (g[np.ix_(other, other)].diagonal() - (scores**2).sum(axis=1)) / rest
            out.append(0.5 * (np.log(values[:q]).sum() + (n - q) * np.log(rest) + (inside + outside).mean()))
        return [(float(np.mean(out)),)]

    return G.per_group(grams, keys, "error double", use)


def pipeline_operators(needed: DataFrame, regressors: DataFrame, keys: Sequence[str], tr: float) -> DataFrame:
    """The operator `m` of each group and pipeline in `needed` (keys, pipeline_id, times, drift, remove, keep, lowpass).

    A pipeline fits drift (polynomials up to the order `drift`) and the group's regressors (keys, kind, k, w) of the kinds in `remove` and `keep`
    together, takes all but those kept out, and low-passes what is left if `lowpass` is 1.
    """
    names = [*keys, "pipeline_id"]
    kinds = F.array_contains(F.concat("remove", "keep"), F.col("kind"))
    own = needed.join(regressors, list(keys)).filter(kinds).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("kind", "k", "w"))).alias("_w"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema.fields if f.name in names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters: dict[int, np.ndarray] = {}
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                t, taken, kept = row["times"], [G.legendre(row["times"], row["drift"])], []
                for x in row["_w"] if row["_w"] is not None else []:
                    (kept if x["kind"] in set(row["keep"]) else taken).append(np.asarray(x["w"], float)[:, None])
                noise = np.hstack(taken)
                fitted = np.linalg.pinv(np.hstack([noise, *kept])).T[:, : noise.shape[1]]
                m = np.eye(t) - fitted @ noise.T
                if row["lowpass"] == 1:
                    if t not in filters:
                        n, cut = G.lowpass_order(tr)
                        filters[t] = G.zero_phase_operator(t, *G.butterworth(n, cut))
                    m = m @ filters[t]
                rows.append((*(row[k] for k in names), m.ravel()))
            yield pd.DataFrame(rows, columns=[*names, "m"])

    return needed.join(own, names, "left").mapInPandas(run, f"{spec}, m array<double>")


def apply_optimum(packed: DataFrame, choices: DataFrame, pipelines: DataFrame, regressors: DataFrame, keys: Sequence[str], tr: float, scheme: str = "ALL", weights: DataFrame | None = None, keep_mean: bool = False) -> DataFrame:
    """keys, scheme, pipeline_id, unit, y: each group's units under the pipelines chosen for it.

    `choices` (keys, scheme, pipeline_id) are taken for one scheme, or with ALL for CON, FIX and IND; `pipelines` (pipeline_id, drift, remove, keep,
    lowpass) says what each does.  A pipeline that several schemes chose for a group is run once.  Afterwards a unit is multiplied by its weight
    (keys, unit, weight; none: 1) and, if wanted, gets its own mean back.
    """
    names = [*keys, "pipeline_id"]
    wanted = choices.filter(F.col("scheme").isin("CON", "FIX", "IND") if scheme.upper() == "ALL" else F.col("scheme") == scheme.upper()).select(*keys, "scheme", "pipeline_id").distinct()
    times = packed.groupBy(*keys).agg(F.first(F.size("y")).alias("times"))
    needed = stored(wanted.select(*names).distinct().join(pipelines, "pipeline_id").join(times, list(keys)), "optimum-needed")
    operators = pipeline_operators(needed, regressors, keys, tr)
    mean = F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / F.size("y")
    units = packed.select(*keys, "unit", "y", mean.alias("_mean")).join(needed.select(*names), list(keys))
    clean = G.apply_operators(units, operators, names)
    if weights is not None:
        clean = clean.join(weights.select(*keys, "unit", "weight"), [*keys, "unit"])
    weight, back = F.col("weight") if weights is not None else F.lit(1.0), F.col("_mean") if keep_mean else F.lit(0.0)
    return clean.join(wanted, names).select(*keys, "scheme", "pipeline_id", "unit", F.transform("y", lambda v: v * weight + back).alias("y"))


def block_resamples(blocks: int, resamples: int = 30, seed: int = 42) -> list[list[int]]:
    """Halves (1 or 2) of 4 or more blocks, the first the larger: up to six blocks every split, of an even number of blocks those that put the
    first block in the first half (the others are the same halves); beyond six, seeded ones."""
    from itertools import combinations

    if blocks <= 6:
        firsts = [c for c in combinations(range(blocks), -(-blocks // 2)) if blocks % 2 or c[0] == 0]
        return [[1 if b in c else 2 for b in range(blocks)] for c in firsts]
    random = np.random.default_rng(seed)
    out = []
    for _ in range(resamples):
        first = set(random.permutation(blocks)[: -(-blocks // 2)].tolist())
        out.append([1 if b in first else 2 for b in range(blocks)])
    return out


def block_resample_table(counts: DataFrame, blocks: str) -> DataFrame:
    """`counts` with resample (from 0), block (from 1) and half of `block_resamples` for the number of blocks (4 or more) of each row."""
    columns = counts.columns

    def run(frames):
        for frame in frames:
            rows = [(*r, i, b + 1, h) for r in frame.itertuples(index=False, name=None) for i, split in enumerate(block_resamples(int(r[columns.index(blocks)]))) for b, h in enumerate(split)]
            yield pd.DataFrame(rows, columns=[*columns, "resample", "block", "half"]).drop(columns=blocks)

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields if f.name != blocks)
    return counts.mapInPandas(run, f"{spec}, resample long, block long, half long")


def model_param_check(params: DataFrame, rules: dict[str, tuple[bool, str | None]]) -> DataFrame:
    """`params`: subject and a map of texts.  (subject, param, value, violation): defaults filled in, required ones that are missing marked."""
    table = F.array(*(F.struct(F.lit(n).alias("param"), F.lit(r).alias("required"), F.lit(d).cast("string").alias("default")) for n, (r, d) in rules.items()))
    x = params.select("subject", "params", F.explode(table).alias("r"))
    value = F.coalesce(F.try_element_at("params", F.col("r.param")), F.col("r.default"))
    return x.select("subject", F.col("r.param").alias("param"), value.alias("value"), (F.col("r.required") & value.isNull()).cast("bigint").alias("violation"))


def model_gconn_partial(packed: DataFrame, grams: DataFrame, keys: Sequence[str], share: float = 0.95) -> DataFrame:
    """Mean partial correlation of each unit with all others, from the inverse spectrum of the components that pass a share of the variance: with
    u the units' coordinates, the inverse covariance is sum of u u' / lambda, and its row sums need one vector of sums over units."""

    def use(g, _s, _n):
        values, vectors = G.eigen(G.centred(g))
        return [(i + 1, float(values[i]), vectors[:, i] / np.sqrt(values[i])) for i in range(G.components_for(values, share) if len(values) else 0)]

    parts = G.per_group(grams, keys, "component int, lam double, w array<double>", use)
    u = G.back_project(packed, parts, keys).join(parts.select(*keys, "component", "lam"), [*keys, "component"])
    own = u.groupBy(*keys, "unit").agg(F.sqrt(F.sum(F.col("value") * F.col("value") / F.col("lam"))).alias("_d"))
    u = u.join(own, [*keys, "unit"]).filter("_d > 0")
    sums = u.groupBy(*keys, "component").agg(F.sum(F.col("value") / F.col("_d")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    out = u.join(sums, [*keys, "component"]).groupBy(*keys, "unit").agg(F.sum(F.col("value") * F.col("_m") / F.col("lam")).alias("_t"), F.max("_d").alias("_d"), F.max("_n").alias("_n"))
    return out.select(*keys, "unit", (-(F.col("_t") / F.col("_d") - 1) / (F.col("_n") - 1)).alias("gconn"))


def event_regressor(events: DataFrame, keys: Sequence[str], scans: int, tr: float) -> DataFrame:
    """Response (keys, t, x) to impulses at distinct rounded onsets; times without response are 0."""
    from gridwise.operators.design import design_event, hrf_convolve

    on = design_event(events, keys, scans).select(*keys, (F.col("scan") - 1).alias("sample"))
    v = hrf_convolve(on, keys, scans, tr).select(*keys, F.col("sample").alias("t"), F.col("v").alias("x"))
    every = events.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(scans - 1).cast("bigint"))).alias("t"))
    return every.join(v, [*keys, "t"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
