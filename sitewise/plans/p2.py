"""Problem 2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewise.operators.orphans import Reference, by_period, direct_orphans, references
from sitewise.sources.tables import table

GRAPH = [
    Reference("nebdft2k_index", "edge_id", "nebbvse122k_index", "edge_id"),
    Reference("nebdft2k_index", "material_id", "bvel13k_index", "material_id"),
    Reference("nebbvse122k_index", "material_id", "bvel13k_index", "material_id"),
]


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in ("nebdft2k_index", "nebbvse122k_index", "bvel13k_index")}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return direct_orphans(_tables(spark, folder), GRAPH)


def p2_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references(_tables(spark, folder), GRAPH)


def p2_by_month(spark: SparkSession, folder: str) -> DataFrame:
    t = _tables(spark, folder)
    return by_period(references(t, GRAPH), t, GRAPH)


QUERIES = {"p2_found": p2_found, "p2_orphans": p2_orphans, "p2_by_month": p2_by_month}

_ID = "nullif(trim(lower(translate({c}, '‐‑‒–—―−⁃﹘﹣－', '-----------')), ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '')"
_i = lambda c: _ID.format(c=c)

_CTES = f"""
bvel as (select {_i('material_id')} as id, loaded_at as s, coalesce(deleted_at, timestamp '9999-12-31') as u from bvel13k_index),
bvse as (select row_id, {_i('edge_id')} as id, {_i('material_id')} as mat, loaded_at as s, coalesce(deleted_at, timestamp '9999-12-31') as u from nebbvse122k_index),
dft as (select row_id, {_i('edge_id')} as edge, {_i('material_id')} as mat, loaded_at as t from nebdft2k_index),
bvse_bad as (select row_id from bvse c where mat is not null and not exists (select 1 from bvel p where p.id = c.mat and p.s <= c.s and p.u > c.s)),
found as (
  select 'nebdft2k_index' as child_table, 'edge_id' as ref_column, row_id, 'direct' as status, t from dft c
  where edge is not null and not exists (select 1 from bvse p where p.id = c.edge and p.s <= c.t and p.u > c.t)
  union all
  select 'nebdft2k_index', 'material_id', row_id, 'direct', t from dft c
  where mat is not null and not exists (select 1 from bvel p where p.id = c.mat and p.s <= c.t and p.u > c.t)
  union all
  select 'nebbvse122k_index', 'material_id', row_id, 'direct', s from bvse where row_id in (select row_id from bvse_bad)
  union all
  select 'nebdft2k_index', 'edge_id', row_id, 'inherited', t from dft c
  where edge is not null and exists (select 1 from bvse p where p.id = c.edge and p.s <= c.t and p.u > c.t)
    and not exists (select 1 from bvse p where p.id = c.edge and p.s <= c.t and p.u > c.t and p.row_id not in (select row_id from bvse_bad)))"""

SQL = {
    "p2_found": f"with {_CTES} select child_table, ref_column, row_id from found where status = 'direct'",
    "p2_orphans": f"with {_CTES} select child_table, ref_column, row_id, status from found",
    "p2_by_month": f"""with {_CTES}, refs as (
  select 'nebdft2k_index' as child_table, 'edge_id' as ref_column, row_id, t from dft where edge is not null
  union all select 'nebdft2k_index', 'material_id', row_id, t from dft where mat is not null
  union all select 'nebbvse122k_index', 'material_id', row_id, s from bvse where mat is not null)
select r.child_table, r.ref_column, strftime(r.t, '%Y-%m') as month, count(*) as n_references,
  count(*) filter (where f.status = 'direct') as n_direct, count(*) filter (where f.status = 'inherited') as n_inherited
from refs r left join found f on f.child_table = r.child_table and f.ref_column = r.ref_column and f.row_id = r.row_id group by 1, 2, 3""",
}
