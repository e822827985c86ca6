"""Queries of force statistics, barriers and error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import sampling as SA
from sitewise.operators import statistics as S
from sitewise.operators.prefix import quantiles
from sitewise.plans.common import COMPONENTS, FRAMES, HOPS, PREDICTIONS, frames, hops, last_forces, predictions
from sitewise.plans.unit_sql import record_unit
from sitewise.shared import written
from sitewise.sources.tables import table

LEAST = (3, 30, 3)


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return S.element_statistics(S.force_components(frames(spark, folder).withColumnRenamed("material", "material_id"), predictions(spark, folder)))


def agg_element_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _stats(spark, folder).select("model", "frame_id", "z", "n_atoms", "n_informative", *(F.round(c, 10).alias(c) for c in ("sxy", "sxx", "syy")))


def agg_component_sets(spark: SparkSession, folder: str) -> DataFrame:
    return S.combined(_stats(spark, folder), ["model"]).select("model", "component_set", "n_atoms", "n_informative", *(F.round(c, 9).alias(c) for c in ("sxy", "sxx", "syy")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("slope", F.round("slope", 6)).withColumn("residual", F.round("residual", 6))


def agg_estimates_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.estimates(_stats(spark, folder), [], LEAST))


def agg_estimates_by_material(spark: SparkSession, folder: str) -> DataFrame:
    s = _stats(spark, folder).where("material_id is not null")
    return _rounded(S.estimates(s, ["material_id"], LEAST, pooled=False))


def agg_deciles(spark: SparkSession, folder: str) -> DataFrame:
    f = frames(spark, folder).where("material is not null and energy is not null and not isnan(energy)")
    return S.energy_deciles(f.select("frame_key", F.col("material").alias("material_id"), "n", "energy"))


def agg_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = S.error_metrics(hops(spark, folder).where("split is not null"), ["split"], "em_bvse", "em_dft", [0.3, 0.5])
    return m.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))


def agg_error_reduction(spark: SparkSession, folder: str) -> DataFrame:
    h = hops(spark, folder).withColumn("fixed", F.col("em_bvse") * 0.9 + 0.05)
    return S.error_reduction(h, ["tm"], "em_bvse", "fixed", "em_dft").withColumn("reduction", F.round("reduction", 6))


def agg_barriers(spark: SparkSession, folder: str) -> DataFrame:
    """Highest minus lowest energy over the frames of a material, as over the images of a path."""
    f = frames(spark, folder).where("material is not null")
    return S.barrier(f, ["material"], "energy").withColumn("barrier", F.round("barrier", 6))


def agg_common_population(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "inference_record").where("status = 'success'").select(F.col("model_name").alias("model"), "frame_id").distinct()
    return S.common_population(r, "model", "frame_id").groupBy("in_all").agg(F.count(F.lit(1)).alias("n_frames"))


def agg_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "frame_index").where("cell_volume is not null and not isnan(cell_volume)")
    q = quantiles(f, ["source_file"], "cell_volume", [0.5, 0.95, 1.0])
    return q.select("source_file", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p95"), F.col("q")[2].alias("most"))


def agg_model_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per model: estimates by status, and median and quartiles of the slopes of materials over all atoms."""
    e = S.estimates(_stats(spark, folder).where("material_id is not null"), ["material_id"], (1, 10, 1), pooled=False).where("component_set = 'all'")
    e = written(e.select("model", "status", "slope"))
    n = e.groupBy("model").agg(F.count_if(F.col("status") == "estimated").alias("n_estimated"), F.count_if(F.col("status") == "unsupported").alias("n_unsupported"))
    q = quantiles(e, ["model"], "slope", [0.25, 0.5, 0.75])
    return n.join(q, "model", "left").select("model", "n_estimated", "n_unsupported", *(F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q25", "median", "q75"))))


def agg_lithium_host_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Per model the median over materials of the lithium slope minus the host slope, where both are estimated."""
    e = S.estimates(_stats(spark, folder).where("material_id is not null"), ["material_id"], (1, 1, 1), pooled=False)
    p = e.where("slope is not null").groupBy("model", "material_id").pivot("component_set", ["Li", "host"]).agg(F.first("slope"))
    gaps = written(p.select("model", (F.col("Li") - F.col("host")).alias("gap")).where("gap is not null"))
    return quantiles(gaps, ["model"], "gap", [0.5]).select("model", F.round(F.col("q")[0], 6).alias("gap"), F.col("n").alias("n_materials"))


def agg_accounting(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "inference_record")
    by = lambda c: r.groupBy("model_name", F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select("model_name", F.lit(c).alias("category"), "value", "n")
    return by("status").unionByName(by("published_split"))


def agg_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Per model: attempted, succeeded and usable records, and rates over what was attempted."""
    r = table(spark, folder, "inference_record")
    ok = F.col("status") == "success"
    use = ok & F.col("energy").isNotNull() & F.col("forces").isNotNull()
    n = F.count(F.lit(1))
    return r.groupBy("model_name").agg(n.alias("n_attempted"), F.count_if(ok).alias("n_success"), F.count_if(use).alias("n_usable"), F.round(F.count_if(ok) / n, 6).alias("success_rate"), F.round(F.count_if(use) / F.nullif(F.count_if(ok), F.lit(0)), 6).alias("usable_rate"))


def agg_force_units(spark: SparkSession, folder: str) -> DataFrame:
    """Per model: last attempts with forces, those that the statistics use, and those left out as their unit isn't known."""
    return last_forces(spark, folder).groupBy("model").agg(F.count(F.lit(1)).alias("n_forces"), F.count("forces").alias("n_used"), F.count_if(F.col("forces").isNull()).alias("n_unknown_unit"))


def flt_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Per model how far the predicted forces stand against the frames' own."""
    return S.alignment(frames(spark, folder), predictions(spark, folder))


DRAWS = 10_000


def _frame_sums(spark: SparkSession, folder: str) -> DataFrame:
    return S.combined(_stats(spark, folder), ["model", "frame_id"]).where("component_set = 'all'").select("model", "frame_id", "sxy", "sxx")


def sta_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile intervals of each model's slope over all atoms, DRAWS draws of whole frames."""
    d = SA.bootstrap_slopes(_frame_sums(spark, folder), ["model"], "frame_id", DRAWS, 5)
    return S.ratio_interval(d, ["model"]).select("model", "n_draws", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "reason")


def _label_units(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of frames by model; the frames of a source's split are a unit, those of a source a scope."""
    f = frames(spark, folder).select("frame_id", F.concat_ws("/", "source", "split").alias("unit"), "source")
    return _frame_sums(spark, folder).join(f, "frame_id").select("model", "unit", F.col("source").alias("scope"), F.col("frame_id").alias("item"), "sxy", "sxx")


def srt_label_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Spread and bias of slopes from K of a unit's frames, K in (1, 3, 5, 10, 30), 1,000 draws, units of 60 frames or more."""
    rows = _label_units(spark, folder).where("sxx > 0")  # a frame without reference forces settles no slope
    out = SA.label_budget(written(rows), "unit", "scope")
    return out.withColumn("median_sd", F.round("median_sd", 6)).withColumn("median_off", F.round("median_off", 6))


def agg_label_units(spark: SparkSession, folder: str) -> DataFrame:
    """Per model and unit: frames that have a slope of their own, and the slope of all of them."""
    rows = _label_units(spark, folder).where("sxx > 0")
    return rows.groupBy("model", "unit").agg(F.count(F.lit(1)).alias("n_frames"), F.round(F.sum("sxy") / F.sum("sxx"), 6).alias("s_all"))


def srt_median_split(spark: SparkSession, folder: str) -> DataFrame:
    f = frames(spark, folder).where("material is not null and energy is not null")
    return S.median_split(f.select("frame_key", "material", "energy"), ["material"], "energy", "frame_key").select("frame_key", "half")


QUERIES = {f.__name__: f for f in (agg_element_statistics, agg_component_sets, agg_estimates_by_model, agg_estimates_by_material, agg_deciles, agg_metrics, agg_error_reduction, agg_barriers, agg_common_population, agg_quantiles, agg_model_summary, agg_lithium_host_gap, agg_accounting, agg_funnel, agg_force_units, flt_alignment, agg_label_units, sta_bootstrap, srt_label_budget, srt_median_split)}

_SETS = "sets as (select model, frame_id, material_id, unnest(['all', case when z = 3 then 'Li' else 'host' end, 'Z' || z]) as component_set, n_atoms, n_informative, sxy, sxx, syy from stats)"


def _estimates(keys: str, least: tuple[int, int, int], pooled: bool) -> str:
    group = "model, component_set" + keys
    reason = f"concat_ws(';', case when n_frames < {least[0]} then 'too_few_frames' end, case when n_informative < {least[1]} then 'too_few_informative_components' end" + (f", case when n_materials < {least[2]} then 'too_few_materials' end" if pooled else "") + ")"
    return f"""{COMPONENTS}, {_SETS},
per_frame as (select model, frame_id, material_id, component_set, sum(n_informative) as n_informative, sum(sxy) as sxy, sum(sxx) as sxx, sum(syy) as syy from sets {'where material_id is not null' if keys else ''} group by all),
pooled as (select {group}, count(*) as n_frames, count(distinct material_id) as n_materials, sum(n_informative)::bigint as n_informative, sum(sxy) as sxy, sum(sxx) as sxx, sum(syy) as syy from per_frame group by all),
estimates as (select {group}, n_frames, n_materials, n_informative, {reason} as reasons, case when {reason} = '' and sxx > 0 then sxy / sxx end as slope,
  case when {reason} = '' and sxx > 0 and syy > 0 then greatest(0, 1 - sxy * sxy / (sxx * syy)) end as residual, case when {reason} = '' then 'estimated' else 'unsupported' end as status from pooled)"""


_metric = lambda t, n: f"count(*) filter (where em_bvse < {t} and em_dft < {t}) as tp_{n}, count(*) filter (where em_bvse < {t} and em_dft >= {t}) as fp_{n}, count(*) filter (where em_bvse >= {t} and em_dft < {t}) as fn_{n}, round(tp_{n} / nullif(tp_{n} + fp_{n}, 0), 6) as precision_{n}, round(tp_{n} / nullif(tp_{n} + fn_{n}, 0), 6) as recall_{n}, round(2 * tp_{n} / nullif(2 * tp_{n} + fp_{n} + fn_{n}, 0), 6) as f1_{n}"
_ALL = f"{COMPONENTS}, one as (select model, frame_id, sum(sxy) as sxy, sum(sxx) as sxx from stats group by 1, 2)"

SQL = {
    "agg_element_statistics": f"with {COMPONENTS} select model, frame_id, z, n_atoms, n_informative, round(sxy, 10) as sxy, round(sxx, 10) as sxx, round(syy, 10) as syy from stats",
    "agg_component_sets": f"with {COMPONENTS}, {_SETS} select model, component_set, sum(n_atoms)::bigint as n_atoms, sum(n_informative)::bigint as n_informative, round(sum(sxy), 9) as sxy, round(sum(sxx), 9) as sxx, round(sum(syy), 9) as syy from sets group by 1, 2",
    "agg_estimates_by_model": f"with {_estimates('', LEAST, True)} select * replace (round(slope, 6) as slope, round(residual, 6) as residual) from estimates",
    "agg_estimates_by_material": f"with {_estimates(', material_id', LEAST, False)} select * replace (round(slope, 6) as slope, round(residual, 6) as residual) from estimates",
    "agg_deciles": f"""with {FRAMES}, f as (select frame_key, material, n, energy from frames where material is not null and energy is not null and not isnan(energy)),
a as (select frame_key, (energy - min(energy) over (partition by material, n)) / n as above from f),
c as (select quantile_cont(above, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts from a)
select frame_key, (1 + len(list_filter(cuts, lambda x: x < above)))::int as decile from a, c""",
    "agg_metrics": f"with {HOPS} select split, count(*) as n, round(avg(abs(em_bvse - em_dft)), 6) as mae, round(sqrt(avg((em_bvse - em_dft) * (em_bvse - em_dft))), 6) as rmse, round(avg(em_bvse - em_dft), 6) as bias, round(median(abs(em_bvse - em_dft)), 6) as median_abs, {_metric('0.3', '0_3')}, {_metric('0.5', '0_5')} from hops where split is not null group by 1",
    "agg_error_reduction": f"with {HOPS} select tm, round(1 - avg(abs(em_bvse * 0.9::double + 0.05::double - em_dft)) / nullif(avg(abs(em_bvse - em_dft)), 0), 6) as reduction, count(*) as n from hops group by 1",
    "agg_barriers": f"with {FRAMES} select material, count(e) as n_images, case when count(e) >= 2 then round(max(e) - min(e), 6) end as barrier from (select material, case when not isnan(energy) then energy end as e from frames where material is not null) group by 1",
    "agg_common_population": "with r as (select distinct model_name, frame_id from inference_record where status = 'success'), p as (select frame_id, count(*) = (select count(distinct model_name) from r) as in_all from r group by 1) select in_all, count(*) as n_frames from p group by 1",
    "agg_quantiles": "select source_file, round(median(cell_volume), 6) as median, round(quantile_cont(cell_volume, 0.95), 6) as p95, max(cell_volume) as most from frame_index where cell_volume is not null and not isnan(cell_volume) group by 1",
    "agg_model_summary": f"with {_estimates(', material_id', (1, 10, 1), False)} select model, count(*) filter (where status = 'estimated') as n_estimated, count(*) filter (where status = 'unsupported') as n_unsupported, round(quantile_cont(slope, 0.25), 6) as q25, round(quantile_cont(slope, 0.5), 6) as median, round(quantile_cont(slope, 0.75), 6) as q75 from estimates where component_set = 'all' group by 1",
    "agg_lithium_host_gap": f"with {_estimates(', material_id', (1, 1, 1), False)} select a.model, round(median(a.slope - b.slope), 6) as gap, count(*) as n_materials from estimates a join estimates b on a.model = b.model and a.material_id = b.material_id where a.component_set = 'Li' and b.component_set = 'host' and a.slope is not null and b.slope is not null group by 1",
    "agg_accounting": "select model_name, 'status' as category, status as value, count(*) as n from inference_record group by 1, 3 union all select model_name, 'published_split', published_split, count(*) from inference_record group by 1, 3",
    "agg_funnel": "select model_name, count(*) as n_attempted, count(*) filter (where status = 'success') as n_success, count(*) filter (where status = 'success' and energy is not null and forces is not null) as n_usable, round(n_success / count(*), 6) as success_rate, round(n_usable / nullif(n_success, 0), 6) as usable_rate from inference_record group by 1",
    "agg_force_units": f"""with r as (select model_name as model, forces, {record_unit('force_unit', 'force')} as unit from inference_record qualify row_number() over (partition by model_name, frame_id order by attempt_number desc, row_id desc) = 1)
select model, count(*) as n_forces, count(c.factor) as n_used, count(*) - count(c.factor) as n_unknown_unit from r left join unit_conversion c on c.quantity = 'force' and c.source_unit = r.unit where forces is not null group by 1""",
    "flt_alignment": f"""with {FRAMES}, {PREDICTIONS}, b as (select p.model, f.frame_id is not null as known, coalesce(len(f.forces), 0) as nx, len(p.forces) as ny, len(list_filter(p.forces, lambda r: len(r) <> 3 or len(list_filter(r, lambda v: v is null)) > 0)) as bad from predictions p left join frames f on f.frame_id = p.frame_id)
select model, count(*) as n_frames, count(*) filter (where not known) as n_unknown, sum(least(nx, ny))::bigint as n_aligned, sum(greatest(nx - ny, 0))::bigint as n_not_predicted, sum(greatest(ny - nx, 0))::bigint as n_without_reference, sum(bad)::bigint as n_ragged from b group by 1""",
    "agg_label_units": f"with {_ALL} select model, concat_ws('/', source, split) as unit, count(*) as n_frames, round(sum(sxy) / sum(sxx), 6) as s_all from one join frames using (frame_id) where sxx > 0 group by 1, 2",
    "srt_median_split": f"with {FRAMES} select frame_key, case when row_number() over (partition by material order by energy, frame_key) <= (count(*) over (partition by material) + 1) // 2 then 'low' else 'high' end as half from frames where material is not null and energy is not null",
}
