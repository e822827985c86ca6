"""Per-key results where a few keys hold most rows: fragment-replicate by estimated load.

Loads per key are counted with partial aggregation. Keys heavier than a fraction of a task's fair share (there can't be
more of those than tasks times that fraction's inverse) are split into shards in proportion to their load; all other
keys go by hash into a fixed number of buckets. Shards and buckets are bin-packed to tasks on the driver, largest first
onto the least loaded task; that plan has a bounded number of rows whatever the data. Rows are sent to the task of
their bucket or shard, and the rows of a matching side only to the tasks of their key's shards. What a task has of a
key is reduced there; the partial results of a key's shards, one row each, are then added up.

A row goes to a wanted task by a token: a small number whose hash partition is that task. So placement is an ordinary
hash repartition, and aggregations by (token, key) need no further exchange.

All rows of one frame or member of a key go to one shard, as of rows for the same thing only the last counts.

Defined cases: a null key is no key, its rows count only in totals. Repeated rows count once in what is counted by
identity, each in n_rows. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.ids import plain_id
from sitewise.shared import forget, written

BUCKETS = 1024
#: A key is split where it alone holds more than this part of a task's fair share.
FRACTION = 0.5


@dataclass
class Plan:
    """Where rows go: heavy(key, shard, token, shards) and light(bucket, token), both bounded; tasks and total rows."""

    heavy: DataFrame
    light: DataFrame
    tasks: int
    total: int
    loads: list[int]


def _tokens(df: DataFrame, tasks: int) -> list[int]:
    """For every task a number that hash partitioning sends there."""
    spark = df.sparkSession
    rows = spark.range(tasks * 40 + 400).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).groupBy("task").agg(F.min("id").alias("id")).collect()
    found = {r["task"]: r["id"] for r in rows}
    return [found.get(t, 0) for t in range(tasks)]


def plan(df: DataFrame, key: str, tasks: int | None = None) -> Plan:
    """Count loads, split the heavy keys and pack everything to tasks. df[key] must be normalised already."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    loads = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("load")))  # one scan; what follows reads a row for each key
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    by_bucket = loads.groupBy(bucket.alias("bucket")).agg(F.sum("load").alias("load"), F.sum(F.when(F.col(key).isNull(), F.col("load")).otherwise(0)).alias("nulls")).collect()  # BUCKETS rows at most
    total = sum(r["load"] for r in by_bucket)
    limit = max(1, int(FRACTION * total / tasks))
    heavy = {r[key]: r["load"] for r in loads.where(F.col(key).isNotNull() & (F.col("load") > limit)).collect()}  # fewer than tasks / FRACTION rows
    forget(loads)
    of_bucket = {r["bucket"]: r["load"] - r["nulls"] for r in by_bucket}
    hb = {}
    if heavy:
        hb = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in heavy], df.select(key).schema).select(key, bucket).collect()}
    for k, n in heavy.items():
        of_bucket[hb[k]] -= n
    items = [(-n, 0, b, 0) for b, n in of_bucket.items() if n > 0]
    shards = {k: -(-n // limit) for k, n in heavy.items()}
    for k, n in heavy.items():
        items += [(-(n // shards[k]), 1, k, s) for s in range(shards[k])]
    free = [(0, t) for t in range(tasks)]
    heapq.heapify(free)
    tokens, light, spread = _tokens(df, tasks), [], []
    for n, is_heavy, what, s in sorted(items, key=lambda x: (x[0], x[1], str(x[2]), x[3])):
        load, t = heapq.heappop(free)
        heapq.heappush(free, (load - n, t))
        (spread.append((what, s, tokens[t], shards[what])) if is_heavy else light.append((what, tokens[t])))
    kind = df.schema[key].dataType.simpleString()
    return Plan(spark.createDataFrame(spread, f"h_key {kind}, h_shard int, h_token long, h_shards int"), spark.createDataFrame(light, "l_bucket long, l_token long"), tasks, total, sorted(n for n, _ in free))


def spread(df: DataFrame, p: Plan, key: str, by: Column) -> DataFrame:
    """df with `token`, placed: rows of a heavy key are divided over its shards by the hash of `by`. Null keys go."""
    sizes = F.broadcast(p.heavy.select("h_key", "h_shards").distinct())
    rows = df.where(F.col(key).isNotNull()).join(sizes, F.col(key) == F.col("h_key"), "left").drop("h_key")
    rows = rows.withColumn("h_pick", F.pmod(F.xxhash64(by), F.col("h_shards")).cast("int")).withColumn("l_pick", F.when(F.col("h_shards").isNull(), F.pmod(F.xxhash64(key), F.lit(BUCKETS))))
    rows = rows.join(F.broadcast(p.heavy.drop("h_shards")), (F.col(key) == F.col("h_key")) & (F.col("h_pick") == F.col("h_shard")), "left")
    rows = rows.join(F.broadcast(p.light), F.col("l_pick") == F.col("l_bucket"), "left")
    return rows.withColumn("token", F.coalesce("h_token", "l_token", F.lit(0))).drop("h_key", "h_shard", "h_token", "h_shards", "h_pick", "l_pick", "l_bucket", "l_token")


def replicate(dim: DataFrame, p: Plan, key: str) -> DataFrame:
    """dim with `token`: rows of a heavy key once for each of its shards' tasks, all others once."""
    rows = dim.where(F.col(key).isNotNull()).join(F.broadcast(p.heavy.select("h_key", "h_token").distinct()), F.col(key) == F.col("h_key"), "left")
    rows = rows.withColumn("l_pick", F.when(F.col("h_token").isNull(), F.pmod(F.xxhash64(key), F.lit(BUCKETS)))).join(F.broadcast(p.light), F.col("l_pick") == F.col("l_bucket"), "left")
    return rows.withColumn("token", F.coalesce("h_token", "l_token", F.lit(0))).drop("h_key", "h_token", "l_pick", "l_bucket", "l_token")


def placed(df: DataFrame, p: Plan) -> DataFrame:
    return df.repartition(p.tasks, "token")


def frame_rows(frame_index: DataFrame) -> DataFrame:
    """The rows of frames_by_material(), by `key`."""
    return frame_index.select(plain_id(F.col("material_id")).alias("key"), F.lower(F.btrim("source_file")).alias("file"), "frame_index", "entry_id", "scanned_at", "n_atoms", "byte_length", "cell_volume")


def frames_by_material(frame_index: DataFrame, materials: DataFrame, tasks: int | None = None, p: Plan | None = None) -> DataFrame:
    """material_id, n_rows, n_frames, n_atoms, n_bytes, mean_cell_volume, chemsys.

    A frame is a source file (case and blanks around aside) and an index; of rows for the same frame the one scanned
    last counts, then the larger entry_id. The mean leaves null and NaN volumes out. chemsys is the smallest of the
    material's in `materials` (material_id, chemsys), the matching side; it is replicated to the material's shards.
    """
    rows = frame_rows(frame_index)
    p = p or plan(rows, "key", tasks)
    facts = spread(rows, p, "key", F.struct("file", "frame_index"))
    dim = replicate(materials.select(plain_id(F.col("material_id")).alias("key"), "chemsys").groupBy("key").agg(F.min("chemsys").alias("chemsys")), p, "key")
    both = placed(facts.withColumn("chemsys", F.lit(None).cast("string")).withColumn("fact", F.lit(True)).unionByName(dim.withColumn("fact", F.lit(False)), allowMissingColumns=True), p)
    frames = both.groupBy("token", "key", "fact", "file", "frame_index").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("n_atoms", "byte_length", "cell_volume"), F.struct("scanned_at", "entry_id")).alias("last"), F.max("chemsys").alias("chemsys"))
    # summed as decimals, so that the order of the shards can't change the sum
    volume = F.when(F.col("fact") & ~F.isnan("last.cell_volume"), F.col("last.cell_volume")).cast("decimal(24,8)")
    of_fact = lambda c: F.sum(F.when(F.col("fact"), c))
    part = frames.groupBy("token", "key").agg(of_fact(F.col("n")).alias("n_rows"), F.count_if("fact").alias("n_frames"), of_fact(F.col("last.n_atoms").cast("long")).alias("n_atoms"), of_fact(F.col("last.byte_length")).alias("n_bytes"), F.sum(volume).alias("v"), F.count(volume).alias("nv"), F.max("chemsys").alias("chemsys"))
    out = part.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_rows", "n_frames", "n_atoms", "n_bytes", "v", "nv")), F.max("chemsys").alias("chemsys")).where("n_rows > 0")
    return out.select(F.col("key").alias("material_id"), "n_rows", "n_frames", "n_atoms", "n_bytes", (F.col("v").cast("double") / F.nullif("nv", F.lit(0))).alias("mean_cell_volume"), "chemsys")


KINDS = ("band_optim_step", "source", "target", "traj_init", "directory", "other")


def member_rows(hop_member: DataFrame) -> DataFrame:
    """The rows of members_by_edge(), by `key`."""
    return hop_member.select(plain_id(F.col("edge_id")).alias("key"), F.lower(F.btrim("name")).alias("name"), "member_id", "packed_at", F.lower(F.btrim("kind")).alias("kind"), "step", "n_bytes")


def members_by_edge(hop_member: DataFrame, barriers: DataFrame, tasks: int | None = None, p: Plan | None = None) -> DataFrame:
    """edge_id, n_rows, n_members, a count for each kind, last_step, n_bytes, em.

    A member is a name (case and blanks around aside); of rows for the same member the one packed last counts, then
    the larger member_id. em is the largest finite barrier of the edge in `barriers` (edge_id, em), the matching side.
    """
    rows = member_rows(hop_member)
    p = p or plan(rows, "key", tasks)
    facts = spread(rows, p, "key", F.col("name"))
    dim = barriers.select(plain_id(F.col("edge_id")).alias("key"), "em").where("em is not null and not isnan(em)").groupBy("key").agg(F.max("em").alias("em"))
    both = placed(facts.withColumn("em", F.lit(None).cast("double")).withColumn("fact", F.lit(True)).unionByName(replicate(dim, p, "key").withColumn("fact", F.lit(False)), allowMissingColumns=True), p)
    members = both.groupBy("token", "key", "fact", "name").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("kind", "step", "n_bytes"), F.struct("packed_at", "member_id")).alias("last"), F.max("em").alias("em"))
    of_fact = lambda c: F.when(F.col("fact"), c)
    kinds = [F.count_if(F.col("fact") & (F.col("last.kind") == k)).alias(f"n_{k}") for k in KINDS]
    part = members.groupBy("token", "key").agg(F.sum(of_fact(F.col("n"))).alias("n_rows"), F.count_if("fact").alias("n_members"), *kinds, F.max(of_fact(F.col("last.step"))).alias("last_step"), F.sum(of_fact(F.col("last.n_bytes"))).alias("n_bytes"), F.max("em").alias("em"))
    sums = ["n_rows", "n_members", *(f"n_{k}" for k in KINDS), "n_bytes"]
    out = part.groupBy("key").agg(*(F.sum(c).alias(c) for c in sums), F.max("last_step").alias("last_step"), F.max("em").alias("em")).where("n_rows > 0")
    return out.select(F.col("key").alias("edge_id"), *sums, "last_step", "em")


def holding_most(results: DataFrame, key: str, total: int, share: float) -> DataFrame:
    """The keys of per-key results with at least `share` of all rows."""
    return results.where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select(F.col(key).alias("key_id"))
