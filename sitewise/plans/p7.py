"""Problem 7: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import skew
from sitewise.plans.common import sql_id
from sitewise.sources.tables import table


def p7_frames_by_material(spark: SparkSession, folder: str, p: skew.Plan | None = None) -> DataFrame:
    return skew.frames_by_material(table(spark, folder, "frame_index"), table(spark, folder, "bvel13k_index"), p=p)


def p7_members_by_edge(spark: SparkSession, folder: str, p: skew.Plan | None = None) -> DataFrame:
    return skew.members_by_edge(table(spark, folder, "hop_member"), table(spark, folder, "nebbvse122k_index"), p=p)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the per-key results with 2 % of the rows; how many rows there are is known from the plan."""
    frames, members = skew.plan(skew.frame_rows(table(spark, folder, "frame_index")), "key"), skew.plan(skew.member_rows(table(spark, folder, "hop_member")), "key")
    named = lambda df, key, p, name: skew.holding_most(df, key, p.total, 0.02).select(F.lit(name).alias("record_table"), "key_id")
    return named(p7_frames_by_material(spark, folder, frames), "material_id", frames, "frame_index").unionByName(named(p7_members_by_edge(spark, folder, members), "edge_id", members, "hop_member"))


QUERIES = {f.__name__: f for f in (p7_found, p7_frames_by_material, p7_members_by_edge)}

SQL = {
    "p7_found": f"""
select 'frame_index' as record_table, {sql_id('material_id')} as key_id from frame_index group by 2 having key_id is not null and count(*) >= 0.02 * (select count(*) from frame_index)
union all
select 'hop_member', {sql_id('edge_id')} as key_id from hop_member group by 2 having key_id is not null and count(*) >= 0.02 * (select count(*) from hop_member)""",
    "p7_frames_by_material": f"""
with r as (select {sql_id('material_id')} as k, lower(trim(source_file)) as f, * from frame_index),
d as (select *, row_number() over (partition by k, f, frame_index order by scanned_at desc, entry_id desc) as rn from r where k is not null),
m as (select {sql_id('material_id')} as k, min(chemsys) as chemsys from bvel13k_index group by 1)
select d.k as material_id, count(*) as n_rows, count(*) filter (where rn = 1) as n_frames, sum(n_atoms) filter (where rn = 1)::bigint as n_atoms,
  sum(byte_length) filter (where rn = 1)::bigint as n_bytes, sum(case when rn = 1 and not isnan(cell_volume) then cell_volume::decimal(24,8) end)::double / nullif(count(case when rn = 1 and not isnan(cell_volume) then 1 end), 0) as mean_cell_volume, any_value(m.chemsys) as chemsys
from d left join m on m.k = d.k group by 1""",
    "p7_members_by_edge": f"""
with r as (select {sql_id('edge_id')} as k, lower(trim(name)) as f, lower(trim(kind)) as kd, * from hop_member),
d as (select *, row_number() over (partition by k, f order by packed_at desc, member_id desc) = 1 as one from r where k is not null),
m as (select {sql_id('edge_id')} as k, max(em) as em from nebbvse122k_index where em is not null and not isnan(em) group by 1)
select d.k as edge_id, count(*) as n_rows, count(*) filter (where one) as n_members,
  count(*) filter (where one and kd = 'band_optim_step') as n_band_optim_step, count(*) filter (where one and kd = 'source') as n_source,
  count(*) filter (where one and kd = 'target') as n_target, count(*) filter (where one and kd = 'traj_init') as n_traj_init,
  count(*) filter (where one and kd = 'directory') as n_directory, count(*) filter (where one and kd = 'other') as n_other,
  sum(n_bytes) filter (where one)::bigint as n_bytes, max(step) filter (where one) as last_step, any_value(m.em) as em
from d left join m on m.k = d.k group by 1""",
}
