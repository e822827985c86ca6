"""Queries of sources, sinks, streaming state and predictors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.hashing import bucket
from sitewise.functions.ids import plain_id
from sitewise.operators.predict import predicted
from sitewise.shared import shared_dir
from sitewise.sources import extxyz, sinks
from sitewise.sources.tables import table
from sitewise.streaming.sums import keep_sums, read_sums


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "frame_geometry").where("positions is not null and energy is not null")


def src_extxyz(spark: SparkSession, folder: str) -> DataFrame:
    """Frames written as extended XYZ and read back: atoms, energies and the sum of all positions by material."""
    path = _new(spark, "frames")
    extxyz.write_extxyz(_labelled(spark, folder).withColumn("material_id", plain_id(F.col("material_id"))), path)
    got = extxyz.read_extxyz(spark, path)
    x = F.aggregate(F.flatten("positions"), F.lit(0).cast("decimal(24,8)"), lambda s, v: (s + v.cast("decimal(20,8)")).cast("decimal(24,8)"))
    return got.groupBy("material_id").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n_atoms").alias("n_atoms"), F.max("energy").alias("most_energy"), F.sum(x).cast("double").alias("sum_positions"))


def snk_publish(spark: SparkSession, folder: str) -> DataFrame:
    """A derived table published, verified against a second run of itself, and read through its manifest."""
    df = table(spark, folder, "hop_member").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))
    path = _new(spark, "published")
    sinks.publish(df, path)
    sinks.publish(df, path)
    return sinks.read_published(spark, path)


def snk_csv_text(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.csv_text(table(spark, folder, "frame_geometry"), ["frame_key", "numbers", "material_id"])


def snk_buckets(spark: SparkSession, folder: str) -> DataFrame:
    path = _new(spark, "buckets")
    rows = table(spark, folder, "nebdft2k_index").select("row_id", plain_id(F.col("material_id")).alias("material"), F.coalesce("_split", F.lit("none")).alias("split"))
    sinks.write_buckets(rows, path, "split", F.col("material"))
    return spark.read.parquet(path).groupBy(F.col("bucket").cast("string").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("material").alias("n_materials")).withColumn("bucket", F.lpad("bucket", 2, "0")).where(bucket(F.lit("x")).isNotNull())


def stm_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Frames, bytes and atoms by file from a stream of the trajectory scan, merged from the sums of its batches."""
    schema = table(spark, folder, "frame_index").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{folder}/frame_inde[x].parquet")
    sums = {"n": F.lit(1), "n_bytes": F.col("byte_length"), "n_atoms": F.col("n_atoms").cast("long")}
    out = _new(spark, "sums")
    keep_sums(stream, out, ["source_file"], sums, _new(spark, "checkpoint")).awaitTermination()
    return read_sums(spark.read.parquet(out), ["source_file"], list(sums))


def _spring(state: object, numbers: list, positions: list, cell: list) -> tuple[float, list]:
    """A linear stand-in for a model: a pull towards the origin, refusing frames of other than 4 to 20 atoms."""
    del cell
    if not 4 <= len(numbers) <= 20:
        raise ValueError("unsupported size")
    k = state["k"]
    return 0.5 * k * sum(v * v for p in positions for v in p), [[-k * v for v in p] for p in positions]


def udf_predict(spark: SparkSession, folder: str) -> DataFrame:
    p = predicted(table(spark, folder, "frame_geometry").where("positions is not null"), "spring", lambda: {"k": 0.5}, _spring)
    return p.select("frame_id", "status", F.round("energy", 6).alias("energy"), F.size("forces").alias("n_forces"), "error_type")


QUERIES = {f.__name__: f for f in (src_extxyz, snk_publish, snk_csv_text, snk_buckets, stm_sums, udf_predict)}

from sitewise.plans.common import sql_id  # noqa: E402

SQL = {
    "src_extxyz": f"with f as (select {sql_id('material_id')} as material_id, len(numbers) as n, energy, list_sum(list_transform(flatten(positions), lambda v: v::decimal(20,8))) as x from frame_geometry where positions is not null and energy is not null) select material_id, count(*) as n_frames, sum(n)::bigint as n_atoms, max(energy) as most_energy, sum(x)::double as sum_positions from f group by 1",
    "snk_publish": "select kind, count(*) as n, sum(n_bytes)::bigint as n_bytes from hop_member group by 1",
    "snk_csv_text": "select frame_key::varchar as frame_key, array_to_string(numbers, ';') as numbers, coalesce(material_id, '') as material_id from frame_geometry",
    "snk_buckets": f"with r as (select {sql_id('material_id')} as m from nebdft2k_index) select substr(sha256(coalesce(m, '__missing__')), 1, 2) as bucket, count(*) as n, count(distinct m) as n_materials from r group by 1",
    "stm_sums": "select source_file, count(*) as n, sum(byte_length)::bigint as n_bytes, sum(n_atoms)::bigint as n_atoms from frame_index group by 1",
    "udf_predict": """select frame_id, case when len(numbers) between 4 and 20 then 'success' else 'failed' end as status, case when len(numbers) between 4 and 20 then round(0.25::double * list_sum(list_transform(flatten(positions), lambda v: v * v)), 6) end as energy,
  case when len(numbers) between 4 and 20 then len(numbers)::int end as n_forces, case when not len(numbers) between 4 and 20 then 'ValueError' end as error_type from frame_geometry where positions is not null""",
}
