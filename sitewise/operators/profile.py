"""Audits of tables: columns, identifiers over splits, duplicates, contiguity, overlaps between sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.operators.prefix import following
from sitewise.operators.sampling import smallest


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, n_null, n_numeric, n_distinct) of text columns; blank counts as null."""
    text = lambda c: F.nullif(F.btrim(F.col(c).cast("string")), F.lit(""))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), text(c).alias("v")) for c in columns))).alias("x")).select("x.*")
    v = F.col("v").try_cast("double")
    return long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"), F.count_if(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).alias("n_numeric"), F.countDistinct("v").alias("n_distinct"))


def spans(df: DataFrame, value: str, over: str) -> DataFrame:
    """(value, n_values): values seen with more than one value of `over`; nulls on either side count for nothing."""
    return df.where(F.col(value).isNotNull() & F.col(over).isNotNull()).groupBy(value).agg(F.countDistinct(over).alias("n_values")).where("n_values > 1")


def split_summary(df: DataFrame, split: str, system: str, unit: str) -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(system).alias("n_systems"), F.countDistinct(unit).alias("n_units"))


def set_comparison(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: distinct values in both, only in a, only in b, and the smallest of each."""
    tag = lambda df, s: df.where(F.col(value).isNotNull()).select(value, F.lit(s).alias("side"))
    per = tag(a, "a").unionByName(tag(b, "b")).groupBy(value).agg(F.max(F.col("side") == "a").alias("ina"), F.max(F.col("side") == "b").alias("inb"))
    kinds = {"both": F.col("ina") & F.col("inb"), "only_a": F.col("ina") & ~F.col("inb"), "only_b": ~F.col("ina") & F.col("inb")}
    return per.agg(*(F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()), *(F.min(F.when(c, F.col(value))).alias(f"first_{k}") for k, c in kinds.items()))


def pairwise_overlap(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """(left_table, right_table, n_common) of distinct values, for each pair of tables, from one aggregation."""
    names = sorted(tables)
    tagged = reduce(DataFrame.unionByName, [tables[n].where(F.col(value).isNotNull()).select(value).distinct().withColumn("t", F.lit(n)) for n in names])
    per = tagged.groupBy(value).agg(F.collect_set("t").alias("ts"))  # as many as there are tables
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = per.agg(*(F.count_if(F.array_contains("ts", a) & F.array_contains("ts", b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left_table"), F.lit(b).alias("right_table"), F.col(f"p{i}").alias("n_common")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def contiguity(df: DataFrame, group: list[str], step: str) -> DataFrame:
    """Per group: number of steps, the last, and whether they are 0, 1, 2 ... without gap."""
    return df.where(F.col(step).isNotNull()).groupBy(*group).agg(F.countDistinct(step).alias("n_steps"), F.max(step).alias("last_step"), ((F.min(step) == 0) & (F.max(step) == F.countDistinct(step) - 1)).alias("contiguous"))


def runs(df: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Per partition: runs of equal values in order, distinct values, and whether each value stands in one run."""
    rows = following(df, [partition], [order], value, "_before")
    starts = F.when(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before_first"), 1).otherwise(0)
    r = rows.withColumn("_start", starts).groupBy(partition).agg(F.sum("_start").alias("n_runs"), (F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n_values"))
    return r.withColumn("contiguous", F.col("n_runs") == F.col("n_values"))


def repeated(df: DataFrame, key: list[Column], names: list[str], order: str) -> DataFrame:
    """Per key that occurs more than once: rows, the first and the last of them by order."""
    return df.select(*(k.alias(n) for k, n in zip(key, names, strict=True)), order).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_row"), F.max(order).alias("last_row")).where("n > 1")


def bounded_examples(df: DataFrame, group: str, value: str, order: str, n: int) -> DataFrame:
    """Per group the exact count and the first n values in order; at most n rows a group are collected."""
    counts = df.groupBy(group).agg(F.count(value).alias("n_values"))
    few = smallest(df.where(F.col(value).isNotNull()).select(group, value, order), [group], [F.col(order)], n)
    first = few.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    shown = first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(value).cast("string").alias("v")))), lambda s: s["v"]), ";").alias("examples"))
    return counts.join(shown, group, "left")
