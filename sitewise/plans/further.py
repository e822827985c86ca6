"""Queries of array checks, roll-ups, links, draws and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.functions.ids import plain_id
from sitewise.functions.physics import misfit
from sitewise.operators import arrays as A
from sitewise.operators import sampling as SA
from sitewise.operators import statistics as S
from sitewise.plans.common import COMPONENTS, FRAMES, HOPS, frames, hops, predictions, sql_id
from sitewise.sources.tables import table


def flt_array_status(spark: SparkSession, folder: str) -> DataFrame:
    """Are the stresses of a frame all finite and within (-0.05, 0.05]?"""
    return table(spark, folder, "frame_geometry").select("frame_key", A.array_status(F.col("stress"), -0.05, 0.05).alias("status"))


def agg_rolled_up(spark: SparkSession, folder: str) -> DataFrame:
    s = flt_array_status(spark, folder).join(frames(spark, folder).select("frame_key", "source"), "frame_key")
    return A.rolled_up(s, ["source"], "status", ["invalid", "missing", "empty", "recoverable"])


def agg_median_misfit(spark: SparkSession, folder: str) -> DataFrame:
    st = S.element_statistics(S.force_components(frames(spark, folder).withColumnRenamed("material", "material_id"), predictions(spark, folder)))
    per = st.groupBy("model", "frame_id").agg(*(F.sum(c).alias(c) for c in ("sxy", "sxx", "syy")))
    rows = per.select("model", misfit(F.col("sxy"), F.col("sxx"), F.col("syy"))["value"].alias("rho"))
    return A.median_of_defined(rows, ["model"], "rho").withColumn("median", F.round("median", 6))


def agg_scale_uncertainty(spark: SparkSession, folder: str) -> DataFrame:
    """As if each material's hops were draws of a slope: spread of the ratio of barriers about its mean."""
    h = hops(spark, folder).where("material is not null").withColumn("ratio", F.when(F.col("em_dft") > 0, F.col("em_bvse") / F.col("em_dft")))
    s = h.groupBy("material").agg(F.avg("em_dft").alias("s"))
    u = A.scale_uncertainty(h.join(s, "material"), ["material"], "s", "ratio")
    return u.select("material", F.round("relative_half_width", 6).alias("relative_half_width"), F.round("sd", 6).alias("sd"), "reason")


def win_order_violations(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "hop_member").select(plain_id(F.col("edge_id")).alias("edge"), "member_id", "step").where("edge is not null")
    return A.order_violations(m, "edge", "member_id", "step")


def jon_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Links pool -> frame -> record by material and frame: direct ones, and paths through a frame."""
    f = frames(spark, folder).where("material is not null")
    pool = table(spark, folder, "bvel13k_index").select(plain_id(F.col("material_id")).alias("material")).where("material is not null").distinct()
    a = pool.join(f.select("material", "frame_id"), "material").select(F.concat(F.lit("m:"), "material").alias("source"), F.lit("pool").alias("source_type"), F.concat(F.lit("f:"), "frame_id").alias("target"), F.lit("frame").alias("target_type"))
    r = table(spark, folder, "inference_record").select(F.concat(F.lit("f:"), "frame_id").alias("source"), F.lit("frame").alias("source_type"), F.concat(F.lit("r:"), F.col("row_id").cast("string")).alias("target"), F.lit("record").alias("target_type"))
    return A.link_counts(a.unionByName(r))


def str_json_leaves(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.explode(A.json_leaves(F.col("props"))).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


def str_rounded(spark: SparkSession, folder: str) -> DataFrame:
    """Barriers as text of fixed digits, and both as an interval."""
    h = hops(spark, folder)
    show = lambda c: F.format_string("%.4f", F.round(c, 4))
    return h.select("row_id", show("em_dft").alias("shown"), F.concat(F.lit("["), show(F.least("em_dft", "em_bvse")), F.lit(", "), show(F.greatest("em_dft", "em_bvse")), F.lit("]")).alias("interval"))


def srt_generator_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Ten bootstrap draws for each model over its frames, from one stream for each model."""
    n = table(spark, folder, "inference_record").groupBy(F.col("model_name").alias("model")).agg(F.countDistinct("frame_id").cast("int").alias("n")).withColumn("seed", F.abs(F.crc32("model")))
    return SA.generator_draws(n, "model", "seed", "n", 10)


def agg_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Records, successes and last attempt for every scope of model and split, the totals included."""
    r = table(spark, folder, "inference_record")
    return r.cube("model_name", "published_split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("n_success"), F.max("attempt_number").alias("last_attempt"))


def srt_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each source's frames in ascending order of their ids as text: 10 stands before 2."""
    f = table(spark, folder, "frame_geometry")
    return f.select("frame_key", F.row_number().over(Window.partitionBy("source_file").orderBy("frame_id")).alias("place"))


def srt_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Frames in blocks of 512 by key: size and digest of what each holds."""
    f = table(spark, folder, "frame_geometry")
    return f.groupBy(F.floor((F.col("frame_key") - 1) / 512).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("frame_key").alias("first_key"), F.max("frame_key").alias("last_key"), F.sum("n_atoms").alias("n_atoms"))


QUERIES = {f.__name__: f for f in (flt_array_status, agg_rolled_up, agg_median_misfit, agg_scale_uncertainty, win_order_violations, jon_link_counts, str_json_leaves, str_rounded, srt_generator_draws, agg_cube, srt_ordered, srt_shards)}

_STATUS = "status as (select frame_key, case when stress is null then 'missing' when len(stress) = 0 then 'empty' when len(list_filter(stress, lambda v: not coalesce(isfinite(v) and v > -0.05 and v <= 0.05, false))) = 0 then 'recoverable' else 'invalid' end as status from frame_geometry)"
SQL = {
    "flt_array_status": f"with {_STATUS} select * from status",
    "agg_rolled_up": f"with {FRAMES}, {_STATUS} select source, case when bool_or(status = 'invalid') then 'invalid' when bool_or(status = 'missing') then 'missing' when bool_or(status = 'empty') then 'empty' when bool_or(status = 'recoverable') then 'recoverable' end as status, " + ", ".join(f"count(*) filter (where status.status = '{s}') as n_{s}" for s in ("invalid", "missing", "empty", "recoverable")) + " from status join frames using (frame_key) group by 1",
    "agg_median_misfit": f"with {COMPONENTS}, a as (select model, frame_id, sum(sxy) as sxy, sum(sxx) as sxx, sum(syy) as syy from stats group by 1, 2), r as (select model, case when sxx > 0 and syy > 0 and sxy > 0 then sqrt(greatest(0, 1 - sxy * sxy / (sxx * syy))) end as rho from a) select model, round(median(rho), 6) as median, count(rho) as n_defined, count(*) - count(rho) as n_undefined from r group by 1",
    "agg_scale_uncertainty": f"""with {HOPS}, h as (select material, em_dft, case when em_dft > 0 then em_bvse / em_dft end as ratio from hops where material is not null),
a as (select material, avg(em_dft) as s, count(*) as n, count(*) - count(ratio) as bad, quantile_cont(ratio, 0.025) as lo, quantile_cont(ratio, 0.975) as hi, stddev_samp(ratio) as sd from h group by 1),
r as (select *, case when bad > 0 then 'undefined_draw' when n < 2 then 'too_few_draws' when s is null or s <= 0 then 'nonpositive_estimate' end as reason from a)
select material, case when reason is null then round((hi - lo) / (2 * s), 6) end as relative_half_width, case when reason is null then round(sd, 6) end as sd, reason from r""",
    "win_order_violations": f"with m as (select {sql_id('edge_id')} as edge, member_id, step from hop_member where step is not null), l as (select *, lag(step) over (partition by edge order by member_id) as b from m where edge is not null) select edge, count(*) as n_known, count(*) filter (where step < b) as n_violations from l group by 1",
    "jon_link_counts": f"""with {FRAMES}, pool as (select distinct {sql_id('material_id')} as m from bvel13k_index), a as (select m, frame_id from pool join frames on frames.material = m)
select 'pool' as source_type, 'frame' as target_type, (select count(*) from a) as n_direct, 0 as n_through union all select 'frame', 'record', (select count(*) from inference_record), 0
union all select 'pool', 'record', 0, (select count(*) from a join inference_record using (frame_id))""",
    "str_json_leaves": "select leaf, count(*) as n from (select unnest(json_keys(props)) as leaf from events) group by 1",
    "str_rounded": f"with {HOPS} select row_id, printf('%.4f', round(em_dft, 4)) as shown, '[' || printf('%.4f', round(least(em_dft, em_bvse), 4)) || ', ' || printf('%.4f', round(greatest(em_dft, em_bvse), 4)) || ']' as interval from hops",
    "agg_cube": "select model_name, published_split, count(*) as n, count(*) filter (where status = 'success') as n_success, max(attempt_number) as last_attempt from inference_record group by cube (model_name, published_split)",
    "srt_ordered": "select frame_key, row_number() over (partition by source_file order by frame_id)::int as place from frame_geometry",
    "srt_shards": "select (frame_key - 1) // 512 as shard, count(*) as n, min(frame_key) as first_key, max(frame_key) as last_key, sum(n_atoms)::bigint as n_atoms from frame_geometry group by 1",
}
