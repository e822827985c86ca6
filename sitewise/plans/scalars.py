"""Queries of the string, hashing and physics functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import hashing as H
from sitewise.functions import elements as E
from sitewise.functions import physics as P
from sitewise.functions.ids import canonical_hop, edge_parts, plain_chemsys, plain_id
from sitewise.plans.common import ALL_HOPS, COMPONENTS, FRAMES, HOPS, all_hops, frames, hops, predictions, sql_chemsys, sql_id
from sitewise.operators.statistics import element_statistics, force_components
from sitewise.operators.units import short
from sitewise.sources.files import KEYWORDS, keywords
from sitewise.sources.tables import table

def str_edge_parts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "nebdft2k_index").select("row_id", edge_parts(plain_id(F.col("edge_id"))).alias("e"))
    return d.select("row_id", "e.*")


def str_canonical_hop(spark: SparkSession, folder: str) -> DataFrame:
    e = str_edge_parts(spark, folder)
    return e.select("row_id", canonical_hop(*(F.col(c) for c in ("source", "target", "ox", "oy", "oz"))).alias("hop"))


def str_split_and_source(spark: SparkSession, folder: str) -> DataFrame:
    return frames(spark, folder).select("frame_key", "split", "source")


def str_chemsys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nebbvse122k_index").select("row_id", plain_chemsys(F.col("chemsys")).alias("system"), F.size(F.split(plain_chemsys(F.col("chemsys")), "-")).alias("n_elements"))


def str_json_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def str_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", keywords(F.col("text")).alias("keywords"))


def str_component_sets(spark: SparkSession, folder: str) -> DataFrame:
    atoms = table(spark, folder, "frame_geometry").select("frame_key", F.explode("numbers").alias("z"))
    return atoms.select("frame_key", F.explode(P.component_sets(F.col("z"))).alias("component_set")).groupBy("frame_key", "component_set").agg(F.count(F.lit(1)).alias("n_atoms"))


def str_labels(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "hop_member")
    return h.select("member_id", F.concat(F.coalesce(plain_id(F.col("edge_id")), F.lit("-")), F.lit(":"), "kind", F.lit(":"), F.coalesce(F.col("step").cast("string"), F.lit("-"))).alias("label"))


def str_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The first populated alias of a material, which it is, and whether aliases disagree."""
    r = table(spark, folder, "inference_record").select("row_id", "frame_id", plain_id(F.col("material_id")).alias("own"))
    f = frames(spark, folder).select("frame_id", F.col("material").alias("of_frame"))
    a = r.join(f, "frame_id", "left")
    return a.select("row_id", F.coalesce("own", "of_frame").alias("material"), F.when(F.col("own").isNotNull(), "material_id").when(F.col("of_frame").isNotNull(), "frame").alias("alias"), (F.size(F.array_distinct(F.array_compact(F.array("own", "of_frame")))) > 1).alias("conflict"))


def hsh_seed(spark: SparkSession, folder: str) -> DataFrame:
    s = all_hops(spark, folder).where("system is not null").select("system").distinct()
    return s.select("system", H.seed64("analysis", "cluster_bootstrap", F.col("system")).cast("string").alias("seed"))


def hsh_rank(spark: SparkSession, folder: str) -> DataFrame:
    return all_hops(spark, folder).where("edge is not null").select("row_id", H.rank_hex("rank", F.lit(17).cast("string"), F.col("edge")).alias("rank"))


def hsh_bucket(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "frame_index")
    return f.select(H.bucket(plain_id(F.col("material_id"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))


def hsh_ids_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per system the digest of its distinct hops."""
    return H.digest_by_group(all_hops(spark, folder), "system", "edge")


def hsh_tie_key(spark: SparkSession, folder: str) -> DataFrame:
    return all_hops(spark, folder).select("row_id", H.seed64("tie", "protocol-1", "analysis-1", F.col("row_id")).cast("string").alias("tie_key"))


def hsh_row_digest(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return n.select("n_nationkey", H.row_digest(key=F.col("n_nationkey"), name=F.col("n_name")).alias("digest"))


def hsh_species(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "frame_geometry").select("frame_key", F.sha2(F.array_join(F.col("numbers").cast("array<string>"), ","), 256).alias("species"))


def mth_cell(spark: SparkSession, folder: str) -> DataFrame:
    f = frames(spark, folder)
    return f.select("frame_key", F.round(P.volume(F.col("cell")), 6).alias("volume"), F.round(P.volume(F.col("cell")) / F.col("n"), 6).alias("volume_per_atom"))


def mth_family(spark: SparkSession, folder: str) -> DataFrame:
    f = frames(spark, folder)
    return f.select("frame_key", P.anion_family(F.col("numbers")).alias("family"), F.array_join(P.mixed_anions(F.col("numbers")), ";").alias("present"), (F.size(P.mixed_anions(F.col("numbers"))) >= 2).alias("mixed"))


def mth_population(spark: SparkSession, folder: str) -> DataFrame:
    h = all_hops(spark, folder).where("system is not null").select("system").distinct()
    has = lambda xs: F.arrays_overlap(F.split("system", "-"), F.array(*(F.lit(x) for x in xs)))
    return h.select("system", F.when(has(sorted({*E.D_BLOCK, *P.HUBBARD_SYMBOLS})), "secondary").otherwise("primary").alias("population"), (~has(E.F_BLOCK)).alias("f_block_free"))


def mth_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """Label-free features of a frame: lithium share, mean and spread of Z, volume per atom, lithium density."""
    f = frames(spark, folder).select("frame_key", P.volume(F.col("cell")).alias("v"), F.explode("numbers").alias("z"))
    a = f.groupBy("frame_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("z") == 3).alias("li"), F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("sd_z"), F.first("v").alias("v"))
    return a.select("frame_key", F.round(F.col("li") / F.col("n"), 6).alias("li_share"), F.round("mean_z", 6).alias("mean_z"), F.round("sd_z", 6).alias("sd_z"), F.round(F.col("v") / F.col("n"), 6).alias("volume_per_atom"), F.round(F.col("li") / F.col("v"), 9).alias("li_density"))


def mth_misfit(spark: SparkSession, folder: str) -> DataFrame:
    """Per model and frame over all atoms: slope, misfit with its reason, tangent."""
    s = element_statistics(force_components(frames(spark, folder).withColumnRenamed("material", "material_id"), predictions(spark, folder)))
    a = s.groupBy("model", "frame_id").agg(*(F.sum(c).alias(c) for c in ("sxy", "sxx", "syy")))
    m = a.withColumn("m", P.misfit(F.col("sxy"), F.col("sxx"), F.col("syy")))
    return m.select("model", "frame_id", F.round(P.slope(F.col("sxy"), F.col("sxx")), 6).alias("slope"), F.round("m.value", 5).alias("misfit"), F.col("m.reason").alias("reason"), F.round(P.misfit_tangent(F.round("m.value", 5)), 4).alias("tangent"))


def mth_barrier_ratios(spark: SparkSession, folder: str) -> DataFrame:
    h = hops(spark, folder)
    return h.select("row_id", F.round(P.log_ratio(F.col("em_bvse"), F.col("em_dft")), 6).alias("disagreement"), F.round(P.scaled(F.col("em_bvse"), F.lit(0.8)), 6).alias("scaled"))


def mth_low_barrier_score(spark: SparkSession, folder: str) -> DataFrame:
    h = hops(spark, folder).where("split is not null")
    side = F.when(F.col("split") == "train", "calibration").otherwise("test")
    return h.select("row_id", F.round(P.low_barrier_score(side, F.col("em_bvse"), F.col("em_dft"), 0.5), 6).alias("score"))


def mth_finite_text(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "descriptor_value").where("reading_text is not null")
    v = F.col("reading_text").try_cast("double")
    ok = F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))
    return r.select("row_id", ok.alias("finite")).groupBy("finite").agg(F.count(F.lit(1)).alias("n"))


def mth_unit_factor(spark: SparkSession, folder: str) -> DataFrame:
    """Readings whose unit column names a registered unit to the letter, converted."""
    r = table(spark, folder, "descriptor_value").where("reading is not null").select("row_id", "feature_name", "reading", "unit")
    m = short(table(spark, folder, "descriptor_fallback_manifest").select("feature_name", "quantity"))
    c = short(table(spark, folder, "unit_conversion").select("quantity", F.col("source_unit").alias("unit"), "factor", "canonical_unit"))
    return r.join(m, "feature_name").join(c, ["quantity", "unit"]).select("row_id", F.round(F.col("reading") * F.col("factor"), 8).alias("value"), "canonical_unit")


QUERIES = {f.__name__: f for f in (str_edge_parts, str_canonical_hop, str_split_and_source, str_chemsys, str_json_keys, str_keywords, str_component_sets, str_labels, str_aliases, hsh_seed, hsh_rank, hsh_bucket, hsh_ids_digest, hsh_tie_key, hsh_row_digest, hsh_species, mth_cell, mth_family, mth_population, mth_descriptors, mth_misfit, mth_barrier_ratios, mth_low_barrier_score, mth_finite_text, mth_unit_factor)}

_EDGE = r"^(.+)_(\d{1,9})_(\d{1,9})_(-?\d{1,9})_(-?\d{1,9})_(-?\d{1,9})$"
_PART = "edges as (select row_id, " + ", ".join(f"nullif(regexp_extract(e, '{_EDGE}', {i}), ''){'' if i == 1 else '::int'} as {n}" for i, n in enumerate(("material", "source", "target", "ox", "oy", "oz"), 1)) + f" from (select row_id, {sql_id('edge_id')} as e from nebdft2k_index))"
_VOL = "abs(cell[1][1] * (cell[2][2] * cell[3][3] - cell[2][3] * cell[3][2]) - cell[1][2] * (cell[2][1] * cell[3][3] - cell[2][3] * cell[3][1]) + cell[1][3] * (cell[2][1] * cell[3][2] - cell[2][2] * cell[3][1]))"
_FAM = {f: "len(list_filter(numbers, lambda z: z in (" + ", ".join(map(str, zs)) + ")))" for f, zs in P.FAMILIES.items()}
_in = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

SQL = {
    "str_edge_parts": f"with {_PART} select * from edges",
    "str_canonical_hop": f"""with {_PART} select row_id, case when oz is null then null
  when source > target or (source = target and (-ox, -oy, -oz) > (ox, oy, oz)) then concat_ws('_', target, source, -ox, -oy, -oz) else concat_ws('_', source, target, ox, oy, oz) end as hop from edges""",
    "str_split_and_source": f"with {FRAMES} select frame_key, split, source from frames",
    "str_chemsys": f"select row_id, {sql_chemsys('chemsys')} as system, len(string_split({sql_chemsys('chemsys')}, '-'))::int as n_elements from nebbvse122k_index",
    "str_json_keys": "select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by 1",
    "str_keywords": "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower(text), '{p}') then '{k}' end" for k, p in KEYWORDS.items()) + "], lambda x: x is not null), ';') as keywords from documents where text is not null",
    "str_component_sets": "select frame_key, unnest(['all', case when z = 3 then 'Li' else 'host' end, 'Z' || z]) as component_set, count(*) as n_atoms from (select frame_key, unnest(numbers) as z from frame_geometry) group by 1, 2",
    "str_labels": f"select member_id, coalesce({sql_id('edge_id')}, '-') || ':' || kind || ':' || coalesce(step::varchar, '-') as label from hop_member",
    "str_aliases": f"""with {FRAMES} select r.row_id, coalesce({sql_id('r.material_id')}, f.material) as material, case when {sql_id('r.material_id')} is not null then 'material_id' when f.material is not null then 'frame' end as alias,
  coalesce({sql_id('r.material_id')} <> f.material, false) as conflict from inference_record r left join frames f on f.frame_id = r.frame_id""",
    "hsh_seed": f"with {ALL_HOPS} select distinct system, ('0x' || substr(sha256(concat_ws(chr(0), 'analysis', 'cluster_bootstrap', system)), 1, 16))::ubigint::varchar as seed from hops where system is not null",
    "hsh_rank": f"with {ALL_HOPS} select row_id, sha256(concat_ws(chr(0), 'rank', '17', edge)) as rank from hops where edge is not null",
    "hsh_bucket": f"select substr(sha256(coalesce({sql_id('material_id')}, '__missing__')), 1, 2) as bucket, count(*) as n_rows from frame_index group by 1",
    "hsh_ids_digest": f"""with {ALL_HOPS} select system, sha256('[' || array_to_string(list_transform(list_sort(list_distinct(list(edge))), lambda x: '"' || x || '"'), ',') || ']') as digest, count(distinct edge) as n_ids from hops where system is not null and edge is not null group by 1""",
    "hsh_tie_key": f"with {ALL_HOPS} select row_id, ('0x' || substr(sha256(concat_ws(chr(0), 'tie', 'protocol-1', 'analysis-1', row_id::varchar)), 1, 16))::ubigint::varchar as tie_key from hops",
    "hsh_row_digest": """select n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') as digest from nation""",
    "hsh_species": "select frame_key, sha256(array_to_string(numbers, ',')) as species from frame_geometry",
    "mth_cell": f"with {FRAMES} select frame_key, round({_VOL}, 6) as volume, round({_VOL} / n, 6) as volume_per_atom from frames",
    "mth_family": f"""with {FRAMES}, c as (select frame_key, {', '.join(f'{q} as {f}' for f, q in _FAM.items())} from frames),
g as (select *, greatest(oxide, sulfide, halide, nitride) as best from c)
select frame_key, case when best <= 0 or (oxide = best)::int + (sulfide = best)::int + (halide = best)::int + (nitride = best)::int > 1 then 'other' when oxide = best then 'oxide' when sulfide = best then 'sulfide' when halide = best then 'halide' else 'nitride' end as family,
  array_to_string(list_filter([case when oxide > 0 then 'oxide' end, case when sulfide > 0 then 'sulfide' end, case when halide > 0 then 'halide' end, case when nitride > 0 then 'nitride' end], lambda x: x is not null), ';') as present,
  (oxide > 0)::int + (sulfide > 0)::int + (halide > 0)::int + (nitride > 0)::int >= 2 as mixed from g""",
    "mth_population": f"""with {ALL_HOPS} select distinct system, case when list_has_any(string_split(system, '-'), {_in('Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Tc Ru Rh Pd Ag Cd La Hf Ta W Re Os Ir Pt Au Hg Ac Rf Db Sg Bh Hs Mt Ds Rg Cn'.split())}) then 'secondary' else 'primary' end as population,
  not list_has_any(string_split(system, '-'), {_in('Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu'.split())}) as f_block_free from hops where system is not null""",
    "mth_descriptors": f"""with {FRAMES}, a as (select frame_key, {_VOL} as v, unnest(numbers) as z from frames)
select frame_key, round(count(*) filter (where z = 3) / count(*), 6) as li_share, round(avg(z), 6) as mean_z, round(stddev_pop(z), 6) as sd_z, round(any_value(v) / count(*), 6) as volume_per_atom, round(count(*) filter (where z = 3) / any_value(v), 9) as li_density from a group by 1""",
    "mth_misfit": f"""with {COMPONENTS}, a as (select model, frame_id, sum(sxy) as sxy, sum(sxx) as sxx, sum(syy) as syy from stats group by 1, 2),
m as (select *, case when sxx <= 0 then 'zero_reference_norm' when syy <= 0 then 'zero_predicted_norm' when sxy <= 0 then 'nonpositive_projection' end as reason from a),
v as (select *, case when reason is null then round(sqrt(greatest(0, 1 - sxy * sxy / (sxx * syy))), 5) end as misfit from m)
select model, frame_id, round(case when sxx > 0 then sxy / sxx end, 6) as slope, misfit, reason, round(case when misfit < 1 then misfit / sqrt(1 - misfit * misfit) end, 4) as tangent from v""",
    "mth_barrier_ratios": f"with {HOPS} select row_id, round(case when em_bvse > 0 and em_dft > 0 then abs(ln(em_bvse / em_dft)) end, 6) as disagreement, round(em_bvse / 0.8::double, 6) as scaled from hops",
    "mth_low_barrier_score": f"with {HOPS} select row_id, round(case when split = 'train' then em_bvse + case when em_dft < 0.5 then 1e6 else -0.5 end else em_bvse - 0.5 end, 6) as score from hops where split is not null",
    "mth_finite_text": "select coalesce(isfinite(try_cast(reading_text as double)), false) as finite, count(*) as n from descriptor_value where reading_text is not null group by 1",
    "mth_unit_factor": "select r.row_id, round(r.reading * c.factor, 8) as value, c.canonical_unit from descriptor_value r join descriptor_fallback_manifest m using (feature_name) join unit_conversion c on c.quantity = m.quantity and c.source_unit = r.unit where r.reading is not null",
}
