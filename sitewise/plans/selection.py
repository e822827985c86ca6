"""Queries of conformal selection, risk curves and ranks over hops: the valence-map barrier predicts the DFT barrier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.hashing import seed64
from sitewise.operators import sampling as SA
from sitewise.operators import screening as C
from sitewise.operators.prefix import quantiles
from sitewise.plans.common import ALL_HOPS, HOPS, all_hops, hops

CUT = 0.4


def _units(spark: SparkSession, folder: str) -> DataFrame:
    h = hops(spark, folder).where("split is not null")
    return h.select(F.col("row_id").alias("unit_id"), "tm", "system", F.when(F.col("split") == "train", "calibration").otherwise("test").alias("side"), F.col("em_bvse").alias("yhat"), F.col("em_dft").alias("y"))


def _p(spark: SparkSession, folder: str) -> DataFrame:
    return C.conformal_pvalues(_units(spark, folder), ["tm"], CUT)


def win_pvalues(spark: SparkSession, folder: str) -> DataFrame:
    return _p(spark, folder).select("unit_id", F.round("p", 10).alias("p"))


def win_bh(spark: SparkSession, folder: str) -> DataFrame:
    return C.step_up(_p(spark, folder), ["tm"], 0.5).select("unit_id", "selected")


def win_by(spark: SparkSession, folder: str) -> DataFrame:
    return C.step_up(_p(spark, folder), ["tm"], 0.9, dependent=True).select("unit_id", "selected")


def agg_selection_outcome(spark: SparkSession, folder: str) -> DataFrame:
    s = C.step_up(_p(spark, folder), ["tm"], 0.5).join(_units(spark, folder).select("unit_id", "y"), "unit_id")
    o = C.selection_outcome(s, ["tm"], CUT)
    return o.select("tm", "n_selected", "n_false", F.round("fdp", 8).alias("fdp"), F.round("power", 8).alias("power"))


def agg_realized_fdr(spark: SparkSession, folder: str) -> DataFrame:
    u = _units(spark, folder).where("system is not null").withColumn("selected", F.col("yhat") < CUT)
    r = C.realized_fdr(C.selection_outcome(u, ["tm", "system"], CUT), "system", 0.1)
    return r.select("n_partitions", F.round("fdr", 8).alias("fdr"), F.round("se", 8).alias("se"), "controlled")


def win_tie_free(spark: SparkSession, folder: str) -> DataFrame:
    u = _units(spark, folder).withColumn("tie", seed64("tie", F.col("unit_id")))
    return C.tie_free_ranks(u, ["tm"], "yhat", "tie").select("unit_id", "rank")


def _weighted(spark: SparkSession, folder: str) -> DataFrame:
    u = _units(spark, folder).where("system is not null")
    return u.select("unit_id", "system", "side", F.col("yhat").alias("score"), F.when(F.col("tm"), 1.5).otherwise(1.0).alias("weight"))


def win_weighted_pvalues(spark: SparkSession, folder: str) -> DataFrame:
    return C.weighted_pvalues(_weighted(spark, folder), ["system"]).select("unit_id", F.round("p", 10).alias("p"))


def win_weighted_selection(spark: SparkSession, folder: str) -> DataFrame:
    return C.weighted_selection(_weighted(spark, folder), ["system"], 0.5).select("unit_id", "size", "selected")


def win_weighted_tie_free(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted selection by places, equal scores settled by a hash of the unit."""
    u = _weighted(spark, folder).withColumn("tie", seed64("tie", F.col("unit_id")))
    return C.weighted_selection_tie_free(u, ["system"], 0.5, "tie").select("unit_id", "size", "selected")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Error of the raw barrier, and a score that is undefined for some."""
    h = hops(spark, folder)
    return h.select("row_id", "tm", F.when(F.col("em_bvse") < 1.2, F.round("em_bvse", 1)).alias("score"), F.round(F.abs(F.col("em_bvse") - F.col("em_dft")), 4).alias("raw"), F.when(F.col("em_bvse") < 1.2, F.round(F.abs(F.col("em_bvse") * 0.9 - F.col("em_dft")), 4)).alias("fixed"))


def win_risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    c = C.risk_curve(_scored(spark, folder), ["tm"], "score", "raw", "row_id")
    return c.select("tm", F.col("k").cast("long").alias("k"), F.round("coverage", 8).alias("coverage"), F.round("risk", 8).alias("risk"))


def win_risk_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = C.risk_summary(_scored(spark, folder), ["tm"], "score", "raw", "row_id")
    return s.select(*(F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


def win_correct_or_raw(spark: SparkSession, folder: str) -> DataFrame:
    c = C.correct_or_raw(_scored(spark, folder), ["tm"], "score", "fixed", "raw", "row_id")
    return c.select("tm", "k", F.round("coverage", 8).alias("coverage"), F.round("risk", 7).alias("risk"))


def win_percentile_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return C.percentile_ranks(_scored(spark, folder), ["tm"], "score", "pr").select("row_id", F.round("pr", 8).alias("pr"))


def win_combined_score(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the defined percentile ranks of two scores, and how many are defined."""
    s = C.percentile_ranks(C.percentile_ranks(_scored(spark, folder), ["tm"], "score", "a"), ["tm"], "fixed", "b")
    n = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    return s.select("row_id", F.round((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / F.nullif(n, F.lit(0)), 8).alias("combined"), n.alias("n_defined"))


def win_spearman(spark: SparkSession, folder: str) -> DataFrame:
    return C.spearman(hops(spark, folder).where("split is not null"), ["split"], "em_bvse", "em_dft").withColumn("rho", F.round("rho", 7))


def agg_gate_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    s = _scored(spark, folder)
    n = s.groupBy("tm").agg(F.count("score").alias("n_defined"), F.count_if(F.col("score").isNull()).alias("n_undefined"))
    return n.join(quantiles(s, ["tm"], "score", [0.8]).select("tm", F.round(F.col("q")[0], 8).alias("threshold")), "tm", "left")


def flt_gate(spark: SparkSession, folder: str) -> DataFrame:
    s, t = _scored(spark, folder), agg_gate_thresholds(spark, folder)
    j = s.join(t.select("tm", "threshold"), "tm")
    return j.select("row_id", (F.col("score").isNotNull() & (F.col("score") <= F.col("threshold"))).alias("pass"), F.when(F.col("score").isNull(), "undefined").when(F.col("score") > F.col("threshold"), "above_threshold").alias("reason"))


def srt_partitions(spark: SparkSession, folder: str) -> DataFrame:
    s = all_hops(spark, folder).where("system is not null").groupBy("system").agg(F.when(F.max("tm"), "with_tm").otherwise("without_tm").alias("stratum"))
    return SA.grouped_partitions(s, 20240101)


def srt_one_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return SA.one_per_group(all_hops(spark, folder).where("system is not null"), "system", "edge", 9)


def srt_lowest_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    return SA.lowest_by_hash(all_hops(spark, folder).where("edge is not null"), "edge", 50)


def srt_without_replacement(spark: SparkSession, folder: str) -> DataFrame:
    return SA.without_replacement(all_hops(spark, folder).where("system is not null and edge is not null"), ["system"], "edge", 3, 5, 2)


def srt_representative(spark: SparkSession, folder: str) -> DataFrame:
    return SA.representative(hops(spark, folder), ["tm"], "em_dft", 9)


def srt_first_of_each(spark: SparkSession, folder: str) -> DataFrame:
    return SA.first_of_each(all_hops(spark, folder).where("system is not null"), ["system"], ["row_id"], 3).select("system", "row_id")


QUERIES = {f.__name__: f for f in (win_pvalues, win_bh, win_by, agg_selection_outcome, agg_realized_fdr, win_tie_free, win_weighted_pvalues, win_weighted_selection, win_weighted_tie_free, win_risk_coverage, win_risk_summary, win_correct_or_raw, win_percentile_ranks, win_combined_score, win_spearman, agg_gate_thresholds, flt_gate, srt_partitions, srt_one_per_group, srt_lowest_by_hash, srt_without_replacement, srt_representative, srt_first_of_each)}

_U = f"{HOPS}, u as (select row_id as unit_id, tm, system, case when split = 'train' then 'calibration' else 'test' end as side, em_bvse as yhat, em_dft as y from hops where split is not null)"
_P = f"""{_U}, c as (select *, sum(case when side = 'calibration' and y >= 0.4 then 1 else 0 end) over (partition by tm order by yhat range between unbounded preceding and current row) as k, count(*) filter (where side = 'calibration') over (partition by tm) as n from u),
p as (select unit_id, tm, y, ((k + 1) / (n + 1))::double as p from c where side = 'test')"""
_BH = """r as (select *, count(*) over (partition by tm order by p range between unbounded preceding and current row) as i, count(*) over (partition by tm) as m from p),
h as (select *, {a} as a from r), b as (select *, max(case when p <= a * i / m then i end) over (partition by tm) as k from h), s as (select unit_id, tm, y, coalesce(p <= a * k / m, false) as selected from b)"""
_H = "0.9::double / list_sum(list_transform(range(1, m + 1), lambda k: 1.0::double / k))"
_W = f"{_U}, w as (select unit_id, system, side, yhat as score, case when tm then 1.5::double else 1.0::double end as weight from u where system is not null)"
_WP = f"""{_W}, wp as (select *, sum(case when side = 'calibration' then weight else 0 end) over (partition by system order by score range between unbounded preceding and current row) as wc, sum(case when side = 'calibration' then weight else 0 end) over (partition by system) as wall from w)"""
_S = f"{HOPS}, sc as (select row_id, tm, case when em_bvse < 1.2::double then round(em_bvse, 1) end as score, round(abs(em_bvse - em_dft), 4) as raw, case when em_bvse < 1.2::double then round(abs(em_bvse * 0.9::double - em_dft), 4) end as fixed from hops)"


def _curve(name: str, source: str, score: str, error: str) -> str:
    return f"""{name}_g as (select tm, {score} as s, count(*) as n, sum({error}) as e from {source} group by 1, 2),
{name}_c as (select *, sum(n) over (partition by tm order by s nulls last rows between unbounded preceding and 1 preceding) as nb, sum(e) over (partition by tm order by s nulls last rows between unbounded preceding and 1 preceding) as eb, sum(n) over (partition by tm) as na from {name}_g),
{name} as (select tm, (coalesce(nb, 0) + j)::bigint as k, (coalesce(nb, 0) + j) / na as coverage, (coalesce(eb, 0) + j * (e / n)) / (coalesce(nb, 0) + j) as risk from (select *, unnest(range(1, n + 1)) as j from {name}_c))"""


_PR = lambda c: f"case when {c} is not null then (rank() over (partition by tm order by {c} nulls last) + (count(*) over (partition by tm, {c}) - 1) / 2) / count({c}) over (partition by tm) end"

SQL = {
    "win_pvalues": f"with {_P} select unit_id, round(p, 10) as p from p",
    "win_bh": f"with {_P}, {_BH.format(a='0.5::double')} select unit_id, selected from s",
    "win_by": f"with {_P}, {_BH.format(a=_H)} select unit_id, selected from s",
    "agg_selection_outcome": f"with {_P}, {_BH.format(a='0.5::double')} select tm, count(*) filter (where selected) as n_selected, count(*) filter (where selected and y >= 0.4) as n_false, round(n_false / greatest(n_selected, 1), 8) as fdp, round((n_selected - n_false) / nullif(count(*) filter (where y < 0.4), 0), 8) as power from s group by 1",
    "agg_realized_fdr": f"""with {_U}, o as (select tm, system, count(*) filter (where yhat < 0.4) as k, count(*) filter (where yhat < 0.4 and y >= 0.4) / greatest(k, 1) as fdp from u where system is not null group by 1, 2),
f as (select system, avg(fdp) as fdp from o group by 1) select count(*) as n_partitions, round(avg(fdp), 8) as fdr, round(stddev_samp(fdp) / sqrt(count(*)), 8) as se, avg(fdp) <= 0.1 + 2 * stddev_samp(fdp) / sqrt(count(*)) as controlled from f""",
    "win_tie_free": f"with {_U} select unit_id, row_number() over (partition by tm order by yhat, ('0x' || substr(sha256(concat_ws(chr(0), 'tie', unit_id)), 1, 16))::ubigint) - 1 as rank from u",
    "win_weighted_pvalues": f"with {_WP} select unit_id, round((wc + weight) / (wall + weight), 10) as p from wp where side = 'test'",
    "win_weighted_selection": f"""with {_WP}, t as (select *, (wc + weight) / (wall + weight) as p, count(*) over (partition by system) as m from wp where side = 'test'),
bl as (select t.unit_id, coalesce(sum(w.weight), 0) as wb from t left join w on w.system = t.system and w.side = 'calibration' and w.score < t.score group by 1),
aux as (select j.unit_id, j.m, (bl.wb + case when j.score < l.score then j.weight else 0 end) / (j.wall + j.weight) as a from t j join t l on l.system = j.system and l.unit_id <> j.unit_id join bl on bl.unit_id = l.unit_id),
r as (select *, row_number() over (partition by unit_id order by a) as i from aux),
z as (select unit_id, max(case when a <= 0.5::double * (i + 1) / m then i + 1 end) as size from r group by 1),
f as (select t.unit_id, t.system, t.p, coalesce(z.size, 1) as size, t.p <= 0.5::double * coalesce(z.size, 1) / t.m as passes from t left join z using (unit_id)),
q as (select system, max(case when size <= i then i end) as r from (select *, row_number() over (partition by system order by size, unit_id) as i from f where passes) group by 1)
select f.unit_id, f.size::bigint as size, f.passes and f.size <= coalesce(q.r, 0) as selected from f left join q using (system)""",
    "win_risk_coverage": f"with {_S}, {_curve('cv', 'sc', 'score', 'raw')} select tm, k, round(coverage, 8) as coverage, round(risk, 8) as risk from cv",
    "win_risk_summary": f"""with {_S}, {_curve('cv', 'sc', 'score', 'raw')}, {_curve('best', 'sc', 'raw', 'raw')},
a as (select tm, avg(risk) as aurc, arg_min(risk, k) filter (where coverage >= 0.8::double - 1e-12) as risk_at_target, count(*) as n_units from cv group by 1), b as (select tm, avg(risk) as aurc_oracle from best group by 1),
c as (select tm, avg(raw) as aurc_random, count(*) filter (where score is null) as n_undefined from sc group by 1)
select tm, round(aurc, 7) as aurc, round(risk_at_target, 7) as risk_at_target, n_units, round(aurc_oracle, 7) as aurc_oracle, round(aurc_random, 7) as aurc_random, n_undefined, round(aurc - aurc_oracle, 7) as e_aurc,
  round(case when aurc_random - aurc_oracle > 0 then (aurc_random - aurc) / (aurc_random - aurc_oracle) end, 7) as normalized_gain from a join b using (tm) join c using (tm)""",
    "win_correct_or_raw": f"""with {_S}, able as (select tm, score, raw - fixed as gain from sc where fixed is not null), {_curve('cv', 'able', 'score', 'gain')},
t as (select tm, count(*) as na, sum(raw) as ra from sc group by 1), g as (select tm, k, risk * k as gain from cv union all select tm, 0, 0 from t)
select tm, k, round(k / na, 8) as coverage, round((ra - gain) / na, 7) as risk from g join t using (tm)""",
    "win_percentile_ranks": f"with {_S} select row_id, round({_PR('score')}, 8) as pr from sc",
    "win_combined_score": f"with {_S}, r as (select row_id, {_PR('score')} as a, {_PR('fixed')} as b from sc) select row_id, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0), 8) as combined, (a is not null)::int + (b is not null)::int as n_defined from r",
    "win_spearman": f"""with {HOPS}, r as (select split, rank() over (partition by split order by em_bvse) + (count(*) over (partition by split, em_bvse) - 1) / 2 as rx, rank() over (partition by split order by em_dft) + (count(*) over (partition by split, em_dft) - 1) / 2 as ry from hops where split is not null)
select split, count(*) as n, case when count(*) >= 3 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then round(corr(rx, ry), 7) end as rho from r group by 1""",
    "agg_gate_thresholds": f"with {_S} select tm, round(quantile_cont(score, 0.8), 8) as threshold, count(score) as n_defined, count(*) filter (where score is null) as n_undefined from sc group by 1",
    "flt_gate": f"with {_S}, t as (select tm, round(quantile_cont(score, 0.8), 8) as threshold from sc group by 1) select row_id, coalesce(score <= threshold, false) as pass, case when score is null then 'undefined' when score > threshold then 'above_threshold' end as reason from sc join t using (tm)",
    "srt_partitions": f"""with {ALL_HOPS}, s as (select system, case when bool_or(tm) then 'with_tm' else 'without_tm' end as stratum from hops where system is not null group by 1),
z as (select stratum, count(*) as n from s group by 1), w as (select sum(n) as nn, least(sum(n) // 2, greatest(1, floor(0.4 * sum(n) + 0.5)))::bigint as want from z),
x as (select stratum, want * n / nn as exact, floor(want * n / nn) as base, want from z, w),
t as (select stratum, base + case when row_number() over (order by base - exact, stratum) <= want - sum(base) over () then 1 else 0 end as take from x),
r as (select *, unnest(range(0, 10)) as repeat from s join t using (stratum))
select repeat::int as repeat, system, case when row_number() over (partition by repeat, stratum order by sha256(concat_ws(chr(0), 'partition', '20240101', repeat, system)), system) <= take then 'test' else 'train' end as side from r""",
    "srt_one_per_group": f"with {ALL_HOPS} select system, edge from hops where system is not null and edge is not null qualify row_number() over (partition by system order by sha256(concat_ws(chr(0), 'draw', '9', edge)), edge) = 1",
    "srt_lowest_by_hash": f"with {ALL_HOPS} select edge from (select distinct edge from hops where edge is not null) order by sha256(concat_ws(chr(0), 'pilot', edge)), edge limit 50",
    "srt_without_replacement": f"""with {ALL_HOPS}, d as (select *, unnest(range(1, 6)) as draw from (select distinct system, edge from hops where system is not null and edge is not null))
select system, edge, draw::int as draw from d qualify row_number() over (partition by system, draw order by ('0x' || substr(sha256(concat_ws(chr(0), 'budget', '2', draw, system, edge)), 1, 16))::ubigint, edge) <= 3""",
    "srt_representative": f"""with {HOPS}, r as (select tm, em_dft, row_number() over (partition by tm order by em_dft) - 1 as i, count(*) over (partition by tm) as n from hops),
k as (select distinct tm, n, least(9, n) as k from r), j as (select tm, n, k, unnest(range(0, k)) as j from k), q as (select distinct tm, case when k > 1 then round_even(j * (n - 1) / (k - 1), 0) else 0 end::bigint as i from j)
select r.tm, r.i as place, r.em_dft from r join q on q.tm = r.tm and q.i = r.i""",
    "srt_first_of_each": f"with {ALL_HOPS} select system, row_id from hops where system is not null qualify row_number() over (partition by system order by row_id) <= 3",
}
# the same with places in the system as scores
SQL["win_weighted_tie_free"] = SQL["win_weighted_selection"].replace("yhat as score", "row_number() over (partition by system order by yhat, ('0x' || substr(sha256(concat_ws(chr(0), 'tie', unit_id)), 1, 16))::ubigint) - 1 as score")
