"""Checks and summaries of array columns, and status roll-ups, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.operators.prefix import following, quantiles

INF = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def array_status(a: Column, low: float, high: float) -> Column:
    """'missing' for null, 'empty', 'invalid' if a value isn't finite or lies outside (low, high], else 'recoverable'."""
    ok = F.forall(a, lambda v: F.coalesce(finite(v) & (v > low) & (v <= high), F.lit(False)))
    return F.when(a.isNull(), "missing").when(F.size(a) == 0, "empty").when(ok, "recoverable").otherwise("invalid")


def rolled_up(rows: DataFrame, keys: list[str], status: str, precedence: list[str]) -> DataFrame:
    """Per key the first status of the precedence that occurs, and how many rows have each."""
    first = F.coalesce(*(F.when(F.bool_or(F.col(status) == s), F.lit(s)) for s in precedence))
    return rows.groupBy(*keys).agg(first.alias("status"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in precedence))


def median_of_defined(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the median of the defined values, how many there are and how many are undefined."""
    n = rows.groupBy(*keys).agg(F.count(value).alias("n_defined"), F.count_if(F.col(value).isNull()).alias("n_undefined"))
    return n.join(quantiles(rows, keys, value, [0.5]).drop("n"), keys, "left").select(*keys, F.col("q")[0].alias("median"), "n_defined", "n_undefined")


def order_violations(rows: DataFrame, partition: str, order: str, step: str) -> DataFrame:
    """Per partition: rows with a step, and those whose step is smaller than that of the known row before."""
    known = following(rows.where(F.col(step).isNotNull()), [partition], [order], step, "_before")
    return known.groupBy(partition).agg(F.count(F.lit(1)).alias("n_known"), F.count_if(F.col(step) < F.col("_before")).alias("n_violations"))


def scale_uncertainty(draws: DataFrame, keys: list[str], estimate: str, value: str) -> DataFrame:
    """Per key: half-width of the central 95 % of draws over the estimate, and their deviation.

    Null with a reason if a draw is undefined, there are fewer than two, or the estimate isn't positive.
    """
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    a = draws.groupBy(*keys).agg(F.max(estimate).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("bad"), q.alias("q"), F.stddev_samp(value).alias("sd"))
    reason = F.when(F.col("bad") > 0, "undefined_draw").when(F.col("n") < 2, "too_few_draws").when(F.col("s").isNull() | (F.col("s") <= 0), "nonpositive_estimate")
    ok = reason.isNull()
    return a.select(*keys, F.when(ok, (F.col("q")[1] - F.col("q")[0]) / (2 * F.col("s"))).alias("relative_half_width"), F.when(ok, F.col("sd")).alias("sd"), reason.alias("reason"))


def link_counts(links: DataFrame) -> DataFrame:
    """(source_type, target_type, n_direct, n_through): links of one step and paths of two, by the types of their ends.

    links: source, source_type, target, target_type. Paths of two are counted from the degrees of the node between, by
    type, so no pair of ends is ever listed.
    """
    one = links.groupBy("source_type", "target_type").agg(F.count(F.lit(1)).alias("n_direct"))
    into = links.groupBy(F.col("target").alias("via"), "source_type").agg(F.count(F.lit(1)).alias("a"))
    out = links.groupBy(F.col("source").alias("via"), "target_type").agg(F.count(F.lit(1)).alias("b"))
    two = into.join(out, "via").groupBy("source_type", "target_type").agg(F.sum(F.col("a") * F.col("b")).alias("n_through"))
    both = one.join(two, ["source_type", "target_type"], "full")
    return both.select("source_type", "target_type", F.coalesce("n_direct", F.lit(0)).alias("n_direct"), F.coalesce("n_through", F.lit(0)).alias("n_through"))


def json_leaves(text: Column) -> Column:
    """The keys and raw values of a JSON object's first two levels, as entries 'a' or 'a.b'."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    value = lambda k: F.from_json(text, "map<string,string>")[k]
    nested = lambda k: F.coalesce(F.json_object_keys(value(k)), F.array().cast("array<string>"))
    return F.flatten(F.transform(keys, lambda k: F.when(F.size(nested(k)) > 0, F.transform(nested(k), lambda j: F.concat(k, F.lit("."), j))).otherwise(F.array(k))))
