"""Sums over all smaller values, without putting a group into one task.

Rows are first added up by distinct value, so ties of any number are one row. The distinct values are range-partitioned
by (group, value) and written; sums per partition are added up by a window over at most one row for each partition and
group, then rows within their partition. The result has one row for each group and distinct value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.shared import written


def prefix_by_value(df: DataFrame, group: list[str], value: str, sums: dict[str, Column], *, descending: bool = False) -> DataFrame:
    """group, value, and for each name in sums: name (of the value), name_upto (of it and all before it).

    Nulls come last in either direction and are one value. Sums must be of exact types or tolerate another order.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    per = df.groupBy(*group, value).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    ranged = written(per.repartitionByRange(*(F.col(g) for g in group), order).withColumn("_part", F.spark_partition_id()))
    key = [*group, "_part"]
    whole = ranged.groupBy(*key).agg(*(F.sum(n).alias(f"_s_{n}") for n in sums))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # partitions follow the order of (group, value), so lower numbers hold what comes before
    before = whole.select(*(F.col(k).alias(f"_k_{k}") for k in key), *(F.coalesce(F.sum(f"_s_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inner = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select("*", *(F.sum(n).over(inner).alias(f"_i_{n}") for n in sums))
    on = None
    for k in key:
        eq = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = eq if on is None else on & eq
    out = rows.join(before, on)
    return out.select(*group, value, *sums, *((F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(f"{n}_upto") for n in sums))


def quantiles(df: DataFrame, group: list[str], value: str, probs: list[float], into: str = "q") -> DataFrame:
    """group, `into` (ARRAY of the linear quantiles) and n (defined values); NaN and null values are left out, and a
    group without any has no row. From prefix sums over distinct values: no group meets in one task.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    p = prefix_by_value(rows, group, value, {"_n": F.lit(1)})
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    on = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], F.lit(True))
    total = n.select(*(F.col(g).alias(f"_g_{g}") for g in group), "n")
    both = p.join(total, on) if group else p.crossJoin(F.broadcast(total))
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in probs]  # places from 0
    holds = lambda k: (F.col("_n_upto") - F.col("_n") <= k) & (k < F.col("_n_upto"))
    pick = lambda k, i, s: F.max(F.when(holds(k), F.col(value).cast("double"))).alias(f"_{s}{i}")
    found = both.groupBy(*group).agg(F.max("n").alias("n"), *(x for i, a in enumerate(at) for x in (pick(F.floor(a), i, "lo"), pick(F.ceil(a), i, "hi"))))
    part = lambda i, q: (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
    return found.select(*group, F.array(*(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(i, q) for i, q in enumerate(probs))).alias(into), "n")


def following(df: DataFrame, group: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """df with `into`, the value of the row before in the group's order, and `<into>_first`, whether there is none.

    Rows are range-partitioned by (group, order); only the last row of each partition and group is carried over.
    """
    ranged = written(df.repartitionByRange(*(F.col(g) for g in group), *(F.col(o) for o in order)).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    key = [*group, "_part"]
    ends = ranged.groupBy(*key).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    before = ends.select(*(F.col(k).alias(f"_k_{k}") for k in key), F.lag("_end").over(Window.partitionBy(*group).orderBy("_part")).alias("_carried"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    rows = ranged.withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(inside)).join(before, on)
    last = F.coalesce("_lag", "_carried")
    return rows.withColumn(into, last["v"]).withColumn(f"{into}_first", last.isNull()).drop("_part", "_lag", "_carried", *(f"_k_{k}" for k in key))


def average_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n (rows with it), rank (the mean of their ranks, from 1); null values have no rank and are left out."""
    p = prefix_by_value(df.where(F.col(value).isNotNull()), group, value, {"n": F.lit(1)})
    return p.select(*group, value, "n", (F.col("n_upto") - (F.col("n") - 1) / 2).alias("rank"))


def join_value(df: DataFrame, per: DataFrame, group: list[str], value: str, keep: list[str]) -> DataFrame:
    """df with the columns `keep` of per, by group and value (null equals null)."""
    right = per.select(*(F.col(c).alias(f"_v_{c}") for c in [*group, value]), *keep)
    on = None
    for c in [*group, value]:
        eq = F.col(c).eqNullSafe(F.col(f"_v_{c}"))
        on = eq if on is None else on & eq
    return df.join(right, on, "left").drop(*(f"_v_{c}" for c in [*group, value]))
