"""Mergeable statistics kept up to date from a stream: partial sums for each batch, added up when read.

Sums over any division of the rows add up to the sums over all, so a batch is aggregated by itself and written under
its number; a batch that is run again after a failure overwrites what it had written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_sums(stream: DataFrame, path: str, keys: list[str], sums: dict[str, Column], checkpoint: str) -> StreamingQuery:
    """Start the query that writes the partial sums of every batch under path/batch=N, for all that is available now."""

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items())).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sums(partial: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return partial.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sums))
