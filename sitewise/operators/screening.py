"""Conformal p-values, step-up selection, weighted selection, and their outcomes.

Calibration and test units are rows with a side; all counting runs over prefix sums of distinct scores. Null or NaN
scores are an error of the input and raise when evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.operators.prefix import join_value, prefix_by_value


def finite(c: str) -> Column:
    """The column, raising on null, NaN and infinities."""
    ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must be finite")).cast("double"))


def conformal_pvalues(units: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Test units with p = (1 + calibration units with y >= threshold and score <= theirs) / (calibration units + 1).

    units: group, unit_id, side ('calibration' or 'test'), yhat, y (null for test).
    """
    null = F.when((F.col("side") == "calibration") & (F.col("y") >= threshold), 1).otherwise(0)
    p = prefix_by_value(units.withColumn("yhat", finite("yhat")), group, "yhat", {"nulls": null})
    n = units.groupBy(*group).agg(F.count_if(F.col("side") == "calibration").alias("n_cal"))
    test = join_value(units.where("side = 'test'"), p, group, "yhat", ["nulls_upto"])
    test = test.join(n, group) if group else test.crossJoin(F.broadcast(n))
    return test.select(*group, "unit_id", "yhat", ((F.col("nulls_upto") + 1) / (F.col("n_cal") + 1)).alias("p"))


def step_up(pvalues: DataFrame, group: list[str], alpha: float, *, dependent: bool = False) -> DataFrame:
    """pvalues (group, unit_id, p) with `selected`: Benjamini-Hochberg, or Benjamini-Yekutieli if dependent.

    k is the largest rank with p_(k) <= a k / m; all units with p <= a k / m are selected. For dependent tests a is
    alpha over the m-th harmonic number.
    """
    per = prefix_by_value(pvalues, group, "p", {"n": F.lit(1)})
    m = pvalues.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    m = m.withColumn("level", F.lit(alpha) / harmonic if dependent else F.lit(alpha))
    per = per.join(m, group) if group else per.crossJoin(F.broadcast(m))
    passing = per.where(F.col("p") <= F.col("level") * F.col("n_upto") / F.col("m")).groupBy(*group).agg(F.max("n_upto").alias("k"))
    cut = m.join(passing, group, "left") if group else m.crossJoin(F.broadcast(passing))
    cut = cut.select(*group, (F.col("level") * F.coalesce("k", F.lit(0)) / F.col("m")).alias("cut"), F.coalesce("k", F.lit(0)).alias("k"))
    out = pvalues.join(cut, group) if group else pvalues.crossJoin(F.broadcast(cut))
    return out.select(*group, "unit_id", "p", ((F.col("k") > 0) & (F.col("p") <= F.col("cut"))).alias("selected"))


def selection_outcome(selected: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Per group from (selected, y): n_selected, n_false (y >= threshold), fdp, power (null if nothing lies below)."""
    hit = F.col("selected")
    size, wrong, fast = F.count_if(hit), F.count_if(hit & (F.col("y") >= threshold)), F.count_if(F.col("y") < threshold)
    return selected.groupBy(*group).agg(size.alias("n_selected"), wrong.alias("n_false"), (wrong / F.greatest(size, F.lit(1))).alias("fdp"), ((size - wrong) / F.nullif(fast, F.lit(0))).alias("power"))


def realized_fdr(outcomes: DataFrame, partition: str, alpha: float) -> DataFrame:
    """One row: the mean over partitions of their mean fdp, its standard error, whether it is at most alpha + 2 errors."""
    per = outcomes.groupBy(partition).agg(F.avg("fdp").alias("fdp"))
    one = per.agg(F.count(F.lit(1)).alias("n_partitions"), F.avg("fdp").alias("fdr"), (F.stddev_samp("fdp") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return one.withColumn("controlled", F.col("fdr") <= F.lit(alpha) + 2 * F.col("se"))


def tie_free_ranks(units: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """units with `rank`: the place, from 0, by score and then tie; a tie key that occurs twice at a score raises."""
    both = F.struct(F.col(score).alias("s"), F.col(tie).alias("t"))
    keyed = units.withColumn("_both", both)
    per = prefix_by_value(keyed, group, "_both", {"n": F.lit(1)})
    per = per.withColumn("rank", F.when(F.col("n") == 1, F.col("n_upto") - 1).otherwise(F.raise_error(F.lit("tie keys must be distinct")).cast("long")))
    return join_value(keyed, per, group, "_both", ["rank"]).drop("_both")


def weighted_pvalues(units: DataFrame, group: list[str]) -> DataFrame:
    """Test units with p = (calibration weight at scores <= theirs + own weight) / (calibration weight + own weight)."""
    cal = F.when(F.col("side") == "calibration", F.col("weight")).otherwise(F.lit(0.0))
    p = prefix_by_value(units.withColumn("score", finite("score")).withColumn("weight", finite("weight")), group, "score", {"w": cal})
    total = units.groupBy(*group).agg(F.sum(cal).alias("w_cal"))
    test = join_value(units.where("side = 'test'"), p, group, "score", ["w_upto"])
    test = test.join(total, group) if group else test.crossJoin(F.broadcast(total))
    return test.select(*group, "unit_id", "score", "weight", ((F.col("w_upto") + F.col("weight")) / (F.col("w_cal") + F.col("weight"))).alias("p"))


def weighted_selection(units: DataFrame, group: list[str], q: float) -> DataFrame:
    """Weighted conformalised selection with deterministic pruning: test units with p, size and selected.

    For every test unit j the others' auxiliary p-values compare scores strictly and use j's weight; size is the
    largest k with 1 + #{auxiliary p <= q k / m} >= k. A unit passes first if p <= q size / m; r is the largest number
    with at least r passing units of size <= r, and those are selected.

    Auxiliary p-values rise with the other's score, so their rank is that of the score and only the last unit of each
    score can settle a size: no pairs are made. What is made is one row for each distinct score and distinct weight of
    a group's test units.
    """
    test = weighted_pvalues(units, group)
    cal, one = F.when(F.col("side") == "calibration", F.col("weight")).otherwise(F.lit(0.0)), F.when(F.col("side") == "test", 1).otherwise(0)
    per = prefix_by_value(units, group, "score", {"w": cal, "n": one}).where("n > 0").select(*group, "score", (F.col("w_upto") - F.col("w")).alias("w_below"), "n_upto")
    total, weights = units.groupBy(*group).agg(F.sum(cal).alias("w_cal"), F.sum(one).alias("m")), test.select(*group, "weight").distinct()
    grid = per.join(total, group).join(weights, group) if group else per.crossJoin(F.broadcast(total)).crossJoin(weights)
    most = lambda aux, k: F.when(aux / (F.col("w_cal") + F.col("weight")) <= F.lit(q) * k / F.col("m"), k)
    w, n = Window.partitionBy(*group, "weight"), F.col("n_upto")
    lower = F.max(most(F.col("w_below"), n + 1)).over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    higher = F.max(most(F.col("w_below") + F.col("weight"), n)).over(w)  # rises with the score, so it counts if above n
    grid = grid.select(*group, "weight", "score", "m", F.greatest(F.lit(1).cast("long"), lower, most(F.col("w_below"), n), F.when(higher > n, higher)).alias("size"))
    first = test.join(grid, [*group, "weight", "score"]).withColumn("passes", F.col("p") <= F.lit(q) * F.col("size") / F.col("m"))
    placed = first.where("passes").withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy("size", "unit_id")))
    r = placed.groupBy(*group).agg(F.max(F.when(F.col("size") <= F.col("i"), F.col("i"))).alias("r"))
    out = first.join(r, group, "left") if group else first.join(r, F.lit(True), "left")
    return out.select(*group, "unit_id", "p", F.col("size").cast("long").alias("size"), (F.col("passes") & (F.col("size") <= F.coalesce("r", F.lit(0)))).alias("selected"))


def weighted_selection_tie_free(units: DataFrame, group: list[str], q: float, tie: str) -> DataFrame:
    """weighted_selection() with the places of tie_free_ranks() as scores: no two units of a group are equal, so strict
    and weak comparisons agree."""
    ranked = tie_free_ranks(units.withColumn("score", finite("score")), group, "score", tie)
    return weighted_selection(ranked.drop("score").withColumn("score", F.col("rank").cast("double")), group, q)


def risk_curve(units: DataFrame, group: list[str], score: str, error: str, order: str) -> DataFrame:
    """Risk at every coverage k of n, units taken by score ascending, nulls last; ties count their mean error each.

    `order` places the units of a tie; it doesn't change the curve.
    """
    keyed = units.select(*group, F.col(score).alias("_s"), F.col(error).alias("_err"), F.col(order).alias("_o"))
    per = prefix_by_value(keyed, group, "_s", {"_n": F.lit(1), "_e": F.col("_err")})
    rows = join_value(keyed, per, group, "_s", ["_n", "_e", "_n_upto", "_e_upto"])
    rows = rows.withColumn("_j", F.row_number().over(Window.partitionBy(*group, "_s").orderBy("_o")))
    k = F.col("_n_upto") - F.col("_n") + F.col("_j")
    total = units.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    rows = rows.join(total, group) if group else rows.crossJoin(F.broadcast(total))
    risk = (F.col("_e_upto") - F.col("_e") + F.col("_j") * (F.col("_e") / F.col("_n"))) / k
    return rows.select(*group, k.alias("k"), (k / F.col("_all")).alias("coverage"), risk.alias("risk"))


def risk_summary(units: DataFrame, group: list[str], score: str, error: str, order: str, target: float = 0.8) -> DataFrame:
    """Area under the risk curve, that of random and of perfect order, their differences, risk at the target coverage."""
    own = risk_curve(units, group, score, error, order)
    best = risk_curve(units, group, error, error, order).groupBy(*group).agg(F.avg("risk").alias("aurc_oracle"))
    a = own.groupBy(*group).agg(F.avg("risk").alias("aurc"), F.min_by("risk", F.when(F.col("coverage") >= target - 1e-12, F.col("k"))).alias("risk_at_target"), F.count(F.lit(1)).alias("n_units"))
    b = units.groupBy(*group).agg(F.avg(error).alias("aurc_random"), F.count_if(F.col(score).isNull()).alias("n_undefined"))
    out = (a.join(best, group).join(b, group)) if group else a.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(b))
    span = F.col("aurc_random") - F.col("aurc_oracle")
    return out.select("*", (F.col("aurc") - F.col("aurc_oracle")).alias("e_aurc"), F.when(span > 0, (F.col("aurc_random") - F.col("aurc")) / span).alias("normalized_gain"))


def correct_or_raw(units: DataFrame, group: list[str], score: str, corrected: str, raw: str, order: str) -> DataFrame:
    """Risk over all n when the first k correctable units are corrected, from k = 0; nothing is imputed."""
    total = units.groupBy(*group).agg(F.count(F.lit(1)).alias("n_all"), F.sum(raw).alias("raw_all"))
    able = units.where(F.col(corrected).isNotNull()).withColumn("_gain", F.col(raw) - F.col(corrected))
    curve = risk_curve(able, group, score, "_gain", order).select(*group, "k", (F.col("risk") * F.col("k")).alias("gain"))
    zero = total.select(*group, F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("gain"))
    rows = curve.withColumn("k", F.col("k").cast("long")).unionByName(zero)
    rows = rows.join(total, group) if group else rows.crossJoin(F.broadcast(total))
    return rows.select(*group, "k", (F.col("k") / F.col("n_all")).alias("coverage"), ((F.col("raw_all") - F.col("gain")) / F.col("n_all")).alias("risk"))


def percentile_ranks(units: DataFrame, group: list[str], value: str, into: str) -> DataFrame:
    """units with `into`: average rank over the number of defined values; null stays null."""
    per = prefix_by_value(units.where(F.col(value).isNotNull()), group, value, {"_n": F.lit(1)})
    n = units.groupBy(*group).agg(F.count(value).alias("_defined"))
    per = per.join(n, group) if group else per.crossJoin(F.broadcast(n))
    per = per.select(*group, value, ((F.col("_n_upto") - (F.col("_n") - 1) / 2) / F.col("_defined")).alias(into))
    return join_value(units, per, group, value, [into])


def spearman(units: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Per group the correlation of average ranks over rows with both; null below 3 rows or without variance."""
    both = units.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).alias("_x"), F.col(y).alias("_y"))
    r = percentile_ranks(percentile_ranks(both, group, "_x", "rx"), group, "_y", "ry")
    a = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return a.select(*group, "n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c")).alias("rho"))
