"""Splits that keep related records together.

Records that share a material or a chemical system are connected, also through others; the groups are components of
the graph of the two kinds of names. Which groups make up a side is settled on the histogram of group sizes alone
(distinct sizes number at most the square root of twice the rows): a subset-sum bitset over size multiplicities finds
the total closest to the side's target. Which groups of a size go to the side is settled by their hash rank.

Defined cases: a row without material and system is a group of its own; equal distances to a target take the smaller
total; an empty table gives an empty result; shares are scaled to add up to 1, and sides without a share get nothing.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.ids import plain_chemsys, plain_id, plain_split
from sitewise.llm.components import components, running_total
from sitewise.shared import written

MAX_BITS = 1 << 24
MAX_SIDES, MAX_SPANS = 10_000, 100_000


def closest_subset(sizes: dict[int, int], target: int, max_bits: int = MAX_BITS) -> dict[int, int]:
    """How many groups of each size to take so that their total is closest to target (a multiset of sizes).

    reach is the bitset of totals; for every total only the step that first reached it is kept, which is enough to find
    the way back. Beyond max_bits, groups are first taken from the largest size down until the rest of the target fits
    the bitset; the rest is closest among what is left.
    """
    left, taken, rest = Counter({s: m for s, m in sizes.items() if s > 0 and m > 0}), Counter(), target
    for s in sorted(left, reverse=True):
        if rest <= max_bits:
            break
        n = min(left[s], max(0, (rest - max_bits // 2) // s))
        taken[s] += n
        left[s] -= n
        rest -= n * s
    if rest <= 0:
        return {s: n for s, n in taken.items() if n}
    # totals beyond the target by a whole group, or by more than itself, are never the closest
    limit = rest + min(rest, max((s for s, m in left.items() if m), default=0))
    full = (1 << (limit + 1)) - 1
    reach, steps, first = 1, [], np.zeros(limit + 1, np.int32)
    for s in sorted(left, reverse=True):
        m, step = min(left[s], limit // s), 1
        while m > 0:  # multiplicities as powers of two and a rest
            n = min(step, m)
            steps.append((s, n))
            new = (reach << (s * n)) & full & ~reach
            if new:
                bits = np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8)
                at = np.nonzero(bits)[0]
                first[(at[:, None] * 8 + np.arange(8))[np.unpackbits(bits[at][:, None], axis=1, bitorder="little").astype(bool)]] = len(steps)
                reach |= new
            m, step = m - n, step * 2
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    best = below
    if above:
        higher = rest + 1 + ((above & -above).bit_length() - 1)
        best = higher if higher - rest < rest - below else below
    while best:
        s, n = steps[first[best] - 1]
        taken[s] += n
        best -= s * n
    return {s: n for s, n in taken.items() if n}


def groups(df: DataFrame, row_id: str = "row_id", material: str = "material_id", system: str = "chemsys", split: str = "_split") -> DataFrame:
    """(row_id, split, group_key, group_id): group_key is the smallest system of the group, else its smallest material.

    A row with neither has its own group, with a null group_key and group_id 'row:<row_id>'.
    """
    rows = df.select(F.col(row_id).alias("row_id"), plain_id(F.col(material)).alias("m"), plain_chemsys(F.col(system)).alias("c"), plain_split(F.col(split)).alias("split"))
    # one node for each name; systems sort before materials, so the smallest node of a component is the key asked for
    rows = written(rows.withColumn("nm", F.concat(F.lit("1"), "m")).withColumn("nc", F.concat(F.lit("0"), "c")))
    edges = rows.select(F.coalesce("nm", "nc").alias("a"), F.coalesce("nc", "nm").alias("b")).where("a is not null").distinct()
    found = written(components(edges))
    out = rows.withColumn("node", F.coalesce("nc", "nm")).join(found, "node", "left")
    key = F.substring("component", 2, 1 << 30)
    return out.select("row_id", "split", key.alias("group_key"), F.coalesce("component", F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("group_id"))


def broken(df: DataFrame, **names: str) -> DataFrame:
    """(group_key, row_id): all rows of each group whose non-null splits are more than one."""
    g = groups(df, **names)
    bad = g.groupBy("group_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("group_id")
    return g.join(bad, "group_id", "left_semi").select("group_key", "row_id")


def assign(df: DataFrame, targets: DataFrame, seed: int = 0, **names: str) -> DataFrame:
    """(row_id, group_key, side): every row with a side, whole groups together, totals near the shares of targets."""
    few = targets.where("split_name is not null and target_share is not null and target_share <> 0").limit(MAX_SIDES + 1).collect()
    if len(few) > MAX_SIDES:
        raise ValueError(f"more than {MAX_SIDES} sides")
    shares = {r["split_name"]: float(r["target_share"]) for r in few}
    if not shares or min(shares.values()) < 0:
        raise ValueError("targets need at least one positive share")
    g = written(groups(df, **names))
    sized = written(g.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most sqrt(2 rows) sizes
    n, left, rows, main = sum(s * m for s, m in histogram.items()), Counter(histogram), [], max(shares, key=lambda s: (shares[s], s))
    start = Counter()
    for side in sorted((s for s in shares if s != main), key=lambda s: (-shares[s], s)):
        for size, k in closest_subset(left, round(n * shares[side] / sum(shares.values()))).items():
            rows.append((size, start[size] + 1, start[size] + k, side))
            start[size] += k
            left[size] -= k
    ranked = running_total(sized.withColumn("_h", F.xxhash64(F.lit(seed), "group_id")).withColumn("_one", F.lit(1)), ["size"], "_h", "_one", "rank")
    spans = df.sparkSession.createDataFrame(rows, "s long, lo long, hi long, side string")
    if len(rows) <= MAX_SPANS:  # else the spans are joined by size, and large sizes are split as skewed partitions
        spans = F.broadcast(spans)
    sides = ranked.join(spans, (F.col("size") == F.col("s")) & F.col("rank").between(F.col("lo"), F.col("hi")), "left").select("group_id", F.coalesce("side", F.lit(main)).alias("side"))
    return g.join(sides, "group_id").select("row_id", "group_key", "side")
