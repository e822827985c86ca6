"""Views of the tables that several queries use, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.ids import plain_chemsys, plain_id, plain_split, source_of_file, split_of_file
from sitewise.operators.units import normalise_records
from sitewise.plans.unit_sql import record_unit
from sitewise.sources.tables import table


def sql_id(c: str) -> str:
    return f"nullif(trim(lower(translate({c}, '‐‑‒–—―−⁃﹘﹣－', '-----------')), ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '')"


def sql_split(c: str) -> str:
    t = f"trim(lower({c}), ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
    return f"case when {t} in ('valid', 'validation') then 'val' else nullif({t}, '') end"


def sql_chemsys(c: str) -> str:
    return f"nullif(array_to_string(list_sort(list_distinct(regexp_extract_all({c}, '[A-Z][a-z]?'))), '-'), '')"


def sql_file_split(c: str) -> str:
    return f"nullif(lower(regexp_extract(trim({c}), '(?i)_(train|val|test)\\.[A-Za-z0-9.]+$', 1)), '')"


def all_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Every hop row, with barriers or not: row_id, material, edge, system, split, tm, em_bvse, em_dft."""
    d = table(spark, folder, "nebdft2k_index")
    return d.select("row_id", plain_id(F.col("material_id")).alias("material"), plain_id(F.col("edge_id")).alias("edge"), plain_chemsys(F.col("chemsys")).alias("system"), plain_split(F.col("_split")).alias("split"), F.coalesce("has_specific_tm", F.lit(False)).alias("tm"), "em_bvse", "em_dft")


def hops(spark: SparkSession, folder: str) -> DataFrame:
    """all_hops() with both barriers (finite), for what computes with them."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return all_hops(spark, folder).where(fine("em_bvse") & fine("em_dft"))


_HOPS = f"""hops as (select row_id, {sql_id('material_id')} as material, {sql_id('edge_id')} as edge, {sql_chemsys('chemsys')} as system, {sql_split('_split')} as split,
  coalesce(has_specific_tm, false) as tm, em_bvse, em_dft from nebdft2k_index"""
#: all_hops() and hops() in SQL, both under the name hops.
ALL_HOPS, HOPS = f"{_HOPS})", f"{_HOPS} where em_bvse is not null and not isnan(em_bvse) and em_dft is not null and not isnan(em_dft))"


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """frame_key, frame_id, material, split, source, n, energy, numbers, cell, forces."""
    f = table(spark, folder, "frame_geometry")
    return f.select("frame_key", "frame_id", plain_id(F.col("material_id")).alias("material"), split_of_file(F.col("source_file")).alias("split"), source_of_file(F.col("source_file")).alias("source"), F.size("numbers").alias("n"), "energy", "numbers", "cell", "forces")


FRAMES = f"""frames as (select frame_key, frame_id, {sql_id('material_id')} as material, {sql_file_split('source_file')} as split,
  regexp_replace(trim(source_file), '(?i)_(train|val|test)\\.[A-Za-z0-9.]+$', '') as source, len(numbers)::int as n, energy, numbers, cell, forces from frame_geometry)"""


def last_forces(spark: SparkSession, folder: str) -> DataFrame:
    """model, frame_id, forces: of every model and frame the last attempt, if it has forces, in the common unit; null if their unit isn't known."""
    r = table(spark, folder, "inference_record")
    last = r.groupBy(F.col("model_name").alias("model"), "frame_id").agg(F.max_by(F.struct("row_id", "forces", "force_unit", "remark"), F.struct("attempt_number", "row_id")).alias("l"))
    rows = last.select("model", "frame_id", "l.*", F.lit(None).cast("double").alias("energy"), F.lit(None).cast("string").alias("energy_unit"))
    return normalise_records(rows, table(spark, folder, "unit_conversion"), ("model", "frame_id")).select("model", "frame_id", F.col("values").alias("forces"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """last_forces() of known units; agg_force_units counts the others."""
    return last_forces(spark, folder).where("forces is not null")


PREDICTIONS = f"""predictions as (select model, frame_id, list_transform(forces, lambda r: list_transform(r, lambda x: x * c.factor)) as forces
  from (select model_name as model, frame_id, forces, {record_unit('force_unit', 'force')} as unit from inference_record qualify row_number() over (partition by model_name, frame_id order by attempt_number desc, row_id desc) = 1) r
  join unit_conversion c on c.quantity = 'force' and c.source_unit = r.unit where forces is not null)"""
COMPONENTS = f"""{FRAMES}, {PREDICTIONS},
zipped as (select p.model, f.frame_id, f.material as material_id, f.numbers, f.forces as fx, p.forces as fy, unnest(range(1, least(len(f.numbers), len(f.forces), len(p.forces)) + 1)) as i from predictions p join frames f on f.frame_id = p.frame_id),
components as (select model, frame_id, material_id, numbers[i] as z, fx[i][k] as x, fy[i][k] as y from (select *, unnest([1, 2, 3]) as k from zipped)),
stats as (select model, frame_id, material_id, z, (count(*) / 3)::bigint as n_atoms, count(*) filter (where abs(x) >= 0.1) as n_informative, sum((x * y)::decimal(28,14))::double as sxy, sum((x * x)::decimal(28,14))::double as sxx, sum((y * y)::decimal(28,14))::double as syy from components group by 1, 2, 3, 4)"""
