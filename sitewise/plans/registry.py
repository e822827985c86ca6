"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewise.plans import audit, estimation, further, p2, p4, p7, records, scalars, selection, storage

QUERIES = {**p2.QUERIES, **p4.QUERIES, **p7.QUERIES, **scalars.QUERIES, **estimation.QUERIES, **selection.QUERIES, **audit.QUERIES, **storage.QUERIES, **further.QUERIES, **records.QUERIES}
SQL = {**p2.SQL, **p4.SQL, **p7.SQL, **scalars.SQL, **estimation.SQL, **selection.SQL, **audit.SQL, **storage.SQL, **further.SQL, **records.SQL}


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query: slopes of predicted on reference forces by material, with their support."""
    return estimation.agg_estimates_by_material(spark, folder)
