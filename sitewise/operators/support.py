"""Nearest-neighbour support, and covariate-shift weights from a ridge logistic domain classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.operators.prefix import average_ranks, join_value, quantiles
from sitewise.shared import ship

#: Rows of a block, of the reference and of the rows compared with it; and numbers held at once while they are compared.
BLOCK, AT_ONCE = 1_000, 2_000_000


COMPLETE = "x is not null and not exists(x, v -> v is null)"


def standardised(rows: DataFrame, dims: int, reference: DataFrame, unscaled: tuple[int, ...] = ()) -> DataFrame:
    """rows(id, group, x), x scaled by mean and deviation of the complete reference rows.

    ddof is 0; a constant feature is only centred, `unscaled` ones are left as they are.
    """
    fit = lambda name, f, i, plain: (F.lit(plain) if i in unscaled else f(F.col("x")[i])).alias(f"{name}{i}")
    m = reference.where(COMPLETE).agg(F.count(F.lit(1)).alias("n"), *(fit("m", F.avg, i, 0.0) for i in range(dims)), *(fit("s", F.stddev_pop, i, 1.0) for i in range(dims)))
    scale = lambda i: F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0)
    return rows.crossJoin(F.broadcast(m)).select("id", "group", F.array(*((F.col("x")[i] - F.col(f"m{i}")) / scale(i) for i in range(dims))).alias("x"))


def support_threshold(distances: DataFrame, reference: DataFrame, level: float) -> DataFrame:
    """One row, tau_d: the linear quantile of the complete reference rows' own distances, which leave their group out."""
    own = distances.join(reference.where(COMPLETE).select("id"), "id", "left_semi")
    few = F.raise_error(F.lit("fewer than k reference rows outside some group")).cast("double")
    checked = own.select(F.coalesce("distance", few).alias("distance"))
    return quantiles(checked, [], "distance", [level]).select(F.col("q")[0].alias("tau_d"))


def _nearest(k: int):  # noqa: ANN202
    """applyInArrow function over one block of rows and one of the reference: each row's k nearest of other groups."""

    def run(rows: pa.Table, reference: pa.Table) -> pa.Table:
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids, out = rows.column("id").to_pylist(), ([], [], [])
        if rows.num_rows and reference.num_rows:
            reference = reference.sort_by("rid")  # so a stable sort settles ties
            x, y, rid = matrix(rows, "x"), matrix(reference, "rx"), reference.column("rid").to_pylist()
            g, h = np.array(rows.column("group").to_pylist(), object), np.array(reference.column("rg").to_pylist(), object)
            step = max(1, AT_ONCE // y.size)
            for i in range(0, len(x), step):
                d = np.sqrt(((x[i : i + step, None] - y[None]) ** 2).sum(2))
                d[g[i : i + step, None] == h[None]] = np.inf
                for r, best in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]):
                    for j in best[np.isfinite(d[r, best])]:
                        for column, value in zip(out, (ids[i + r], float(d[r, j]), rid[j]), strict=True):
                            column.append(value)
        return pa.table([pa.array(out[0], rows.schema.field("id").type), pa.array(out[1], pa.float64()), pa.array(out[2], reference.schema.field("rid").type)], names=["id", "d", "rid"])

    return run


def support_distances(rows: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(id, distance): mean distance to the k nearest complete reference rows of other groups; null features give null.

    Rows and reference are cut into blocks of about BLOCK rows, every block of the one meets every block of the other,
    and the k nearest of each meeting are merged: exact for a reference of any size, with bounded memory.
    """
    ship(rows.sparkSession)
    whole = f"group is not null and {COMPLETE}"
    left, ref = rows.where(whole), reference.where(whole).select(F.col("id").alias("rid"), F.col("group").alias("rg"), F.col("x").alias("rx"))
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    n_left, n_ref = blocks(left), blocks(ref)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = left.select("id", "group", "x", part("id", n_left).alias("i"), every(n_ref).alias("j"))
    b = ref.select("rid", "rg", "rx", part("rid", n_ref).alias("rj"), every(n_left).alias("ri"))
    kind = dict(rows.dtypes)["id"]
    near = a.groupBy("i", "j").cogroup(b.groupBy("ri", "rj")).applyInArrow(_nearest(k), f"id {kind}, d double, rid {dict(ref.dtypes)['rid']}")
    ranked = near.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("d", "rid"))).where(F.col("p") <= k)
    mean = ranked.groupBy("id").agg(F.avg("d").alias("distance"), F.count(F.lit(1)).alias("n"))
    return rows.select("id").join(mean, "id", "left").select("id", F.when(F.col("n") == k, F.col("distance")).alias("distance"))


def gated(distances: DataFrame, threshold: Column | float) -> DataFrame:
    reason = F.when(F.col("distance").isNull(), "missing_feature").when(F.col("distance") > threshold, "outside_support")
    return distances.withColumn("supported", reason.isNull()).withColumn("reason", reason)


def _sums(beta: np.ndarray, mean: np.ndarray, sd: np.ndarray):  # noqa: ANN202
    """mapInArrow function: the gradient and the Hessian's upper triangle over a partition, as (place, value) rows."""
    d = len(beta)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + len(upper[0]))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
            z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
            total[:d] += z.T @ (b.column("t").to_numpy() - p)
            total[d:] += ((z * (p * (1 - p))[:, None]).T @ z)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["place", "value"])

    return run


def fit_domain(rows: DataFrame, dims: int, ridge: float = 1.0, rounds: int = 100, tol: float = 1e-10) -> dict:
    """Ridge logistic regression of side 'q' against 'p' by reweighted least squares; the intercept isn't penalised.

    Each round adds up the gradient and the Hessian in Arrow batches, one set of sums for each partition; the system of
    dims + 1 unknowns is solved on the driver. Features are z-scored over both sides; rows with a null feature are
    left out. Raises if a side is empty or the rounds don't converge.
    """
    ship(rows.sparkSession)
    rows = rows.where((F.size("x") == dims) & ~F.exists("x", lambda v: v.isNull()))
    count = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).where("side in ('p', 'q')").collect()}
    if not count.get("p") or not count.get("q"):
        raise ValueError("both sides need rows")
    m = rows.agg(*(F.avg(F.col("x")[i]) for i in range(dims)), *(F.stddev_pop(F.col("x")[i]) for i in range(dims))).first()
    mean, sd = np.array(m[:dims], float), np.array([v if v else 1.0 for v in m[dims:]], float)
    data = rows.where("side in ('p', 'q')").select("x", (F.col("side") == "q").cast("double").alias("t"))
    width = dims + 1
    pairs = np.triu_indices(width)
    ridges = np.concatenate([[0.0], np.full(dims, ridge)])
    weights = np.zeros(width)
    for _ in range(rounds):
        sums = dict(data.mapInArrow(_sums(weights, mean, sd), "place int, value double").groupBy("place").agg(F.sum("value")).collect())  # width + width (width + 1) / 2 rows
        slope = np.array([sums[i] for i in range(width)]) - ridges * weights
        curve = np.zeros((width, width))
        curve[pairs] = curve.T[pairs] = [sums[width + i] for i in range(len(pairs[0]))]
        change = np.linalg.solve(curve + np.diag(ridges), slope)
        weights += change
        if np.max(np.abs(change)) < tol:
            break
    else:
        raise RuntimeError(f"the weights still move after {rounds} rounds")
    return {"beta": weights.tolist(), "mean": mean.tolist(), "sd": sd.tolist(), "n_p": count["p"], "n_q": count["q"]}


def q_probability(x: Column, model: dict) -> Column:
    eta = F.lit(model["beta"][0])
    for i, b in enumerate(model["beta"][1:]):
        eta = eta + (x[i] - F.lit(model["mean"][i])) / F.lit(model["sd"][i]) * F.lit(b)
    return 1 / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-35.0)), F.lit(35.0))))


def shift_weight(x: Column, model: dict, clip: float | None = None) -> Column:
    """n_p / n_q times the odds of q, clipped if asked for."""
    p = q_probability(x, model)
    w = F.lit(model["n_p"] / model["n_q"]) * p / (1 - p)
    return w if clip is None else F.least(w, F.lit(clip))


def auc(scored: DataFrame, score: str) -> DataFrame:
    """One row: the chance that a row of side q scores higher than one of side p, ties counting half."""
    ranks = average_ranks(scored, [], score)
    r = join_value(scored, ranks, [], score, ["rank"])
    q, p = F.count_if(F.col("side") == "q"), F.count_if(F.col("side") == "p")
    return r.agg(((F.sum(F.when(F.col("side") == "q", F.col("rank"))) - q * (q + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"))


def weight_diagnostics(weighted: DataFrame, weight: str) -> DataFrame:
    """One row: effective sample size, largest weight, quantiles."""
    w = F.col(weight)
    q = quantiles(weighted.select(w.alias("w")), [], "w", [0.05, 0.5, 0.95])
    one = weighted.agg((F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_size"), F.max(w).alias("most"))
    return one.crossJoin(F.broadcast(q.select(*(F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q50", "q95"))))))
