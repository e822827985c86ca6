"""Top N items within every group by secondary sort.

Rows are hash-partitioned by (group, salt), sorted within the partitions by group, score and identifier, and streamed
as Arrow batches; the first N rows of each run are passed on and the rest skipped, so no group is ever held in memory.
What is left (at most N rows for a group and salt) goes through the same once more by group alone. The salt spreads a
group of any size over `salts` tasks.

Defined cases: rows with a null or NaN score are left out; a null group is a group of its own; equal scores are settled
by the identifier, ascending, nulls first, and rows equal in both count each. Empty input gives an empty result. The
result has the columns of the input; helper columns can't clash as their names are derived from the input's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.shared import ship


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def first_rows(keys: list[str], n: int):  # noqa: ANN201
    """mapInArrow function: of batches sorted by keys, the first n rows of every run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, bool)
            for k in keys:
                c = batch.column(k)
                here, there = c.slice(1), c.slice(0, rows - 1)
                differs = pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False)
                new[1:] |= differs | (pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(there).to_numpy(zero_copy_only=False))
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first != last or last is None
            at = np.arange(rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            rank = np.where(start >= 0, at - start, at + seen)
            last, seen = tuple(batch.column(k)[rows - 1].as_py() for k in keys), int(rank[-1]) + 1
            keep = rank < n
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int, salts: int | None = None) -> DataFrame:
    """The n rows of each group with the highest score, ties by `tie` ascending; salts is as many as shuffle partitions, 32 at least."""
    salts = max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if salts is None else salts
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be at least 1")
    ship(df.sparkSession)
    salt = free_name(df, "salt")
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score))).withColumn(salt, F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int"))
    order = [F.col(g).asc_nulls_first() for g in group]
    best = [F.col(score).desc(), F.col(tie).asc_nulls_first()]
    part = rows.repartition(*group, salt).sortWithinPartitions(*order, salt, *best).mapInArrow(first_rows([*group, salt], n), rows.schema)
    whole = part.drop(salt).repartition(*group).sortWithinPartitions(*order, *best)
    return whole.mapInArrow(first_rows(group, n), whole.schema)


def latest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Of every key the row that is last by `order`; aggregated before the shuffle."""
    picked = free_name(df, "picked")
    return df.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias(picked)).select(key, f"{picked}.*")
