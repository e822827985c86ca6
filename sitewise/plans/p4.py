"""Problem 4: quantities recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators.units import normalise
from sitewise.plans.unit_sql import VALUES
from sitewise.sources.tables import table


def _all(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    return normalise(t("inference_record"), t("descriptor_value"), t("descriptor_fallback_manifest"), t("unit_conversion"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _all(spark, folder).where("source_unit is not null and source_unit <> common_unit").select("record_table", "row_id", "field_name", "source_unit")


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value in the common unit."""
    return _all(spark, folder)


def p4_units(spark: SparkSession, folder: str) -> DataFrame:
    """How often each unit stands for each field, unknown ones included."""
    return _all(spark, folder).groupBy("record_table", "field_name", "source_unit", "common_unit").agg(F.count(F.lit(1)).alias("n_values"))


def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per field: values, those converted, and the sums of what they came to."""
    exact = lambda c: F.when(~F.isnan(c), c).cast("decimal(28,8)")
    parts = F.aggregate(F.transform(F.flatten("values"), exact), F.lit(0).cast("decimal(38,8)"), lambda s, x: (s + F.coalesce(x, F.lit(0).cast("decimal(28,8)"))).cast("decimal(38,8)"))
    v = _all(spark, folder).groupBy("record_table", "field_name")
    return v.agg(F.count(F.lit(1)).alias("n_values"), F.count(F.coalesce("value", F.when(F.col("values").isNotNull(), 0.0))).alias("n_converted"), F.round(F.sum(exact(F.col("value"))).cast("double"), 3).alias("total"), F.round(F.sum(parts).cast("double"), 3).alias("total_components"))


QUERIES = {f.__name__: f for f in (p4_found, p4_values, p4_units, p4_totals)}

SQL = {
    "p4_found": f"with {VALUES} select record_table, row_id, field_name, source_unit from f where source_unit <> coalesce(common, common_unit)",
    "p4_units": f"with {VALUES} select record_table, field_name, source_unit, coalesce(common, common_unit) as common_unit, count(*) as n_values from f group by all",
    "p4_totals": f"""with {VALUES} select record_table, field_name, count(*) as n_values, count(factor) as n_converted, round(sum(case when not isnan(given) then (given * factor)::decimal(28,8) end)::double, 3) as total,
  round(sum(list_sum(list_transform(list_filter(flatten(given_values), lambda x: not isnan(x)), lambda x: (x * factor)::decimal(28,8))))::double, 3) as total_components from f group by 1, 2""",
}
