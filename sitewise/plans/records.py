"""Queries of record rules, names of systems, nested keys, descriptor vectors and invariances, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.ids import edge_parts
from sitewise.functions.physics import anion_family, volume
from sitewise.operators import records as R
from sitewise.operators import transforms
from sitewise.plans.audit import agg_largest_frame
from sitewise.plans.common import ALL_HOPS, FRAMES, all_hops
from sitewise.sources.tables import table

FEATURES = ("li_share", "mean_z", "sd_z", "volume_per_atom", "li_density", "hop_length", "em_bvse", "oxide", "sulfide", "halide", "nitride", "other")


def str_system_problem(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of trouble, how many texts are no name of a chemical system."""
    c = table(spark, folder, "nebbvse122k_index").select(F.coalesce(R.system_problem(F.col("chemsys")), F.lit("none")).alias("problem"))
    return c.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def flt_record_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Records that break a rule, and which."""
    known = table(spark, folder, "frame_geometry").select("frame_id", F.lit(True).alias("known")).distinct()
    rows = table(spark, folder, "inference_record").join(known, "frame_id", "left")
    return R.broken_rules(rows, R.record_problems(F.col("known")), "row_id")


def agg_successes(spark: SparkSession, folder: str) -> DataFrame:
    """How many record keys have how many successes; a sound run has no more than one each."""
    per = table(spark, folder, "inference_record").groupBy("record_key").agg(F.count_if(F.col("status") == "success").alias("n_success"), F.count(F.lit(1)).alias("n_attempts"))
    return per.groupBy("n_success", "n_attempts").agg(F.count(F.lit(1)).alias("n_keys"))


def flt_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of the snapshots against the entries of the trajectory scan, both ways."""
    key = lambda n: table(spark, folder, n).select(F.lower(F.btrim("source_file")).alias("file"), "frame_index")
    return R.coverage(key("frame_index"), key("frame_geometry"), ["file", "frame_index"])


def str_json_paths(spark: SparkSession, folder: str) -> DataFrame:
    """How often each path of the nested properties occurs, and how many values it has."""
    e = table(spark, folder, "events").select(F.explode(R.json_paths(F.col("props"))).alias("path", "value"))
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


def mth_descriptor_vector(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve label-free features of every hop: of its host (the material's largest frame), of the jump and of the valence map.

    The jump goes from the source site to the target site moved by the hop's own cell offset. What is missing is null.
    """
    host = agg_largest_frame(spark, folder).select("material", "frame_key").join(table(spark, folder, "frame_geometry").select("frame_key", "numbers", "positions", "cell"), "frame_key")
    h = all_hops(spark, folder).select("row_id", "material", edge_parts(F.col("edge")).alias("e"), "em_bvse").join(host, "material", "left")
    n, v = F.size("numbers"), volume(F.col("cell"))
    z = F.transform("numbers", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(z) / n
    li = F.size(F.filter("numbers", lambda x: x == 3))
    site = lambda c, k: F.get(F.get(F.col("positions"), F.col(f"e.{c}")), F.lit(k))
    cell = lambda i, k: F.get(F.get(F.col("cell"), F.lit(i)), F.lit(k))
    step = [site("target", k) + sum((F.col(f"e.{o}") * cell(i, k) for i, o in enumerate(("ox", "oy", "oz"))), F.lit(0.0)) - site("source", k) for k in range(3)]
    family = anion_family(F.col("numbers"))
    one = [F.when(F.col("numbers").isNotNull(), (family == f).cast("double")) for f in FEATURES[7:]]
    values = [li / n, mean, F.sqrt(total(F.transform(z, lambda x: (x - mean) * (x - mean))) / n), v / n, li / v, F.sqrt(sum((d * d for d in step), F.lit(0.0))), F.when(~F.isnan("em_bvse"), F.col("em_bvse")), *one]
    have = F.col("numbers").isNotNull() & (v > 0)
    return h.select("row_id", *(F.round(x if name == "em_bvse" else F.when(have, x), 8).alias(name) for name, x in zip(FEATURES, values, strict=True)))


def _pairs(state: object, numbers: list, positions: list, cell: list) -> tuple[float, list]:
    """A stand-in for a model that sees distances only: springs between all atoms of one image."""
    import numpy as np

    del cell
    x, w = np.array(positions), np.array(numbers, float) * state["k"]
    d = x[:, None] - x[None]
    return 0.25 * float((w[:, None] * w[None] * (d**2).sum(-1)).sum()), (-(w[:, None] * w[None])[..., None] * d).sum(1).tolist()


def udf_invariance(spark: SparkSession, folder: str) -> DataFrame:
    """Does a predictor of distances follow rotations and permutations, and does it see wrapping?"""
    f = table(spark, folder, "frame_geometry").where("positions is not null and cell is not null and size(positions) = size(numbers)")
    r = transforms.invariance(f, lambda: {"k": 0.01}, _pairs)
    return r.select("frame_id", "finite", "deterministic", (F.col("rotation") < 1e-9).alias("rotation_ok"), (F.col("translation") < 1e-9).alias("translation_ok"), (F.col("permutation") < 1e-9).alias("permutation_ok"))


QUERIES = {f.__name__: f for f in (str_system_problem, flt_record_rules, agg_successes, flt_coverage, str_json_paths, mth_descriptor_vector, udf_invariance)}

_SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
_VOL = "abs(cell[1][1] * (cell[2][2] * cell[3][3] - cell[2][3] * cell[3][2]) - cell[1][2] * (cell[2][1] * cell[3][3] - cell[2][3] * cell[3][1]) + cell[1][3] * (cell[2][1] * cell[3][2] - cell[2][2] * cell[3][1]))"
_site = lambda c, k: f"positions[{c} + 1][{k}]"
_step = lambda k: f"({_site('t', k)} + ox * cell[1][{k}] + oy * cell[2][{k}] + oz * cell[3][{k}] - {_site('s', k)})"
_among = lambda zs: f"len(list_filter(numbers, lambda z: z in ({zs})))"

SQL = {
    "str_system_problem": f"""with c as (select chemsys, regexp_extract_all(chemsys, '[A-Z][a-z]?') as s, regexp_replace(regexp_replace(chemsys, '[A-Z][a-z]?', '', 'g'), '[0-9\\s.()\\[\\]{{}},_+\\-/]+', '', 'g') as rest from nebbvse122k_index)
select case when chemsys is null or len(s) = 0 then 'empty' when rest <> '' then 'leftover' when len(list_filter(s, lambda x: not list_contains(string_split('{_SYMBOLS}', ' '), x))) > 0 then 'unknown' else 'none' end as problem, count(*) as n from c group by 1""",
    "flt_record_rules": """with k as (select distinct frame_id from frame_geometry), r as (select i.*, k.frame_id is not null as known from inference_record i left join k using (frame_id)),
b as (select row_id, concat_ws(';', case when coalesce(trim(record_key), '') = '' then 'no_key' end, case when coalesce(trim(frame_id), '') = '' then 'no_frame' end, case when coalesce(trim(frame_id), '') <> '' and not known then 'unknown_frame' end,
  case when not coalesce(published_split in ('train', 'val', 'test'), false) then 'bad_split' end, case when not coalesce(status in ('success', 'failed'), false) then 'bad_status' end, case when not coalesce(n_atoms > 0, false) then 'bad_count' end, case when not coalesce(attempt_number >= 1, false) then 'bad_attempt' end,
  case when status = 'success' and not coalesce(isfinite(energy), false) then 'no_energy' end, case when status = 'success' and forces is null then 'no_forces' end,
  case when forces is not null and len(list_filter(forces, lambda f: len(f) <> 3 or len(list_filter(f, lambda v: not coalesce(isfinite(v), false))) > 0)) > 0 then 'bad_forces' end, case when forces is not null and len(forces) > n_atoms then 'more_forces_than_atoms' end,
  case when status = 'failed' and (energy is not null or forces is not null) then 'values_of_a_failure' end) as broken from r) select row_id, broken from b where broken <> ''""",
    "agg_successes": "with p as (select record_key, count(*) filter (where status = 'success') as n_success, count(*) as n_attempts from inference_record group by 1) select n_success, n_attempts, count(*) as n_keys from p group by 1, 2",
    "flt_coverage": "with a as (select distinct lower(trim(source_file)) as f, frame_index as i from frame_index where source_file is not null and frame_index is not null), b as (select distinct lower(trim(source_file)) as f, frame_index as i from frame_geometry where source_file is not null and frame_index is not null) select count(*) filter (where a.f is not null and b.f is not null) as n_both, count(*) filter (where a.f is null) as n_missing, count(*) filter (where b.f is null) as n_unexpected from a full join b on a.f = b.f and a.i = b.i",
    "str_json_paths": "with k as (select props, unnest(json_keys(props)) as path from events) select path, count(*) as n, count(distinct json_extract(props, '$.' || path)::varchar) as n_values from k group by 1",
    "mth_descriptor_vector": f"""with {FRAMES}, {ALL_HOPS}, big as (select material, frame_key from frames where material is not null qualify row_number() over (partition by material order by n desc, frame_key) = 1),
host as (select big.material, g.numbers, g.positions, g.cell from big join frame_geometry g using (frame_key)),
h as (select row_id, em_bvse, numbers, positions, cell, regexp_extract(edge, '^.+((?:_-?[0-9]{{1,9}}){{5}})$', 1) as tail from hops left join host using (material)),
p as (select *, list_transform(regexp_extract_all(tail, '-?[0-9]+'), lambda x: x::int) as q from h), v as (select *, q[1] as s, q[2] as t, q[3] as ox, q[4] as oy, q[5] as oz, {_VOL} as vol, len(numbers) as n from p),
f as (select *, vol > 0 as have, {_among('8')} as o, {_among('16')} as su, {_among('9, 17, 35, 53')} as ha, {_among('7')} as ni from v),
g as (select *, case when greatest(o, su, ha, ni) <= 0 or (o = greatest(o, su, ha, ni))::int + (su = greatest(o, su, ha, ni))::int + (ha = greatest(o, su, ha, ni))::int + (ni = greatest(o, su, ha, ni))::int > 1 then 'other' when o = greatest(o, su, ha, ni) then 'oxide' when su = greatest(o, su, ha, ni) then 'sulfide' when ha = greatest(o, su, ha, ni) then 'halide' else 'nitride' end as family from f)
select row_id, round(case when have then {_among('3')} / n end, 8) as li_share, round(case when have then list_avg(numbers) end, 8) as mean_z, round(case when have then list_stddev_pop(numbers) end, 8) as sd_z, round(case when have then vol / n end, 8) as volume_per_atom, round(case when have then {_among('3')} / vol end, 8) as li_density,
  round(case when have then sqrt(pow({_step(1)}, 2) + pow({_step(2)}, 2) + pow({_step(3)}, 2)) end, 8) as hop_length, round(case when not isnan(em_bvse) then em_bvse end, 8) as em_bvse, {', '.join(f"case when have then (family = '{x}')::int::double end as {x}" for x in FEATURES[7:])} from g""",
}
