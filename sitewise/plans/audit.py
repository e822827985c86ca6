"""Queries of audits, linkage, set operations, graphs and support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.ids import plain_chemsys, plain_id, plain_split
from sitewise.operators import matching as M
from sitewise.operators import percolation as PC
from sitewise.operators import profile as P
from sitewise.operators import support as SU
from sitewise.plans.common import ALL_HOPS, FRAMES, HOPS, all_hops, frames, hops, sql_chemsys, sql_id, sql_split
from sitewise.shared import written
from sitewise.sources.tables import table


def src_column_summary(spark: SparkSession, folder: str) -> DataFrame:
    return P.column_summary(table(spark, folder, "nebdft2k_index"), ["material_id", "edge_id", "chemsys", "em_dft", "_split"])


def src_nested_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of frames: frames, unreadable ones, those whose count is at odds with the arrays, and sizes."""
    f = table(spark, folder, "frame_geometry").withColumn("source", F.col("source_file"))
    return f.groupBy("source").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("positions").isNull()).alias("n_unreadable"), F.count_if(F.col("n_atoms") != F.size("numbers")).alias("n_at_odds"), F.min(F.size("numbers")).alias("least_atoms"), F.max(F.size("numbers")).alias("most_atoms"))


def agg_split_summary(spark: SparkSession, folder: str) -> DataFrame:
    h = all_hops(spark, folder).where("split is not null")
    return P.split_summary(h, "split", "system", "edge")


def agg_spans(spark: SparkSession, folder: str) -> DataFrame:
    return P.spans(all_hops(spark, folder), "material", "split")


def agg_archive_steps(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "hop_member").where("kind = 'band_optim_step'").select(plain_id(F.col("edge_id")).alias("edge"), "step").where("edge is not null")
    return P.contiguity(m, ["edge"], "step")


def agg_step_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return agg_archive_steps(spark, folder).groupBy("n_steps", "contiguous").agg(F.count(F.lit(1)).alias("n_hops"))


def agg_kinds(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "hop_member").select(plain_id(F.col("edge_id")).alias("edge"), "kind")
    return m.groupBy("edge").pivot("kind", ["source", "target", "traj_init"]).agg(F.count(F.lit(1))).where("edge is not null").select("edge", *(F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in ("source", "target", "traj_init")))


def agg_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "inference_record")
    return r.groupBy("model_name").pivot("published_split", ["train", "val", "test"]).agg(F.count_if(F.col("status") == "success")).select("model_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("train", "val", "test")))


def agg_largest_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Per material its largest frame, the first of equal ones."""
    f = frames(spark, folder).where("material is not null")
    return f.groupBy("material").agg(F.max_by("frame_key", F.struct("n", -F.col("frame_key"))).alias("frame_key"), F.max("n").alias("n"))


def agg_repeated(spark: SparkSession, folder: str) -> DataFrame:
    return P.repeated(table(spark, folder, "frame_index"), [F.lower(F.btrim("source_file")), F.col("frame_index")], ["source_file", "frame_index"], "entry_id")


def agg_examples(spark: SparkSession, folder: str) -> DataFrame:
    f = frames(spark, folder)
    return P.bounded_examples(f.where("split is not null"), "split", "material", "frame_key", 5)


def win_runs(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "frame_geometry").select("source_file", "frame_index", plain_id(F.col("material_id")).alias("material"))
    return P.runs(f, "source_file", "frame_index", "material")


def set_compare(spark: SparkSession, folder: str) -> DataFrame:
    a = all_hops(spark, folder).select("material")
    b = table(spark, folder, "bvel13k_index").select(plain_id(F.col("material_id")).alias("material"))
    return P.set_comparison(a, b, "material")


def jon_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    names = ("bvel13k_index", "nebbvse122k_index", "nebdft2k_index", "frame_geometry")
    return P.pairwise_overlap({n: table(spark, folder, n).select(plain_id(F.col("material_id")).alias("material")) for n in names}, "material")


def set_tagged_union(spark: SparkSession, folder: str) -> DataFrame:
    """Frames and hops as one table of tagged records; materials whose split differs between the kinds."""
    f = frames(spark, folder).select(F.lit("frame").alias("record_kind"), "material", "split")
    h = all_hops(spark, folder).select(F.lit("hop").alias("record_kind"), "material", "split", "system")
    u = f.unionByName(h, allowMissingColumns=True)
    return u.where("material is not null and split is not null").groupBy("material").agg(F.count_if(F.col("record_kind") == "frame").alias("n_frames"), F.count_if(F.col("record_kind") == "hop").alias("n_hops"), F.countDistinct("split").alias("n_splits"))


def set_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Materials of the pool that no hop and no frame knows."""
    pool = table(spark, folder, "bvel13k_index").select(plain_id(F.col("material_id")).alias("material")).where("material is not null").distinct()
    used = all_hops(spark, folder).select("material").union(frames(spark, folder).select("material"))
    return pool.join(used, "material", "left_anti")


def jon_linkage(spark: SparkSession, folder: str) -> DataFrame:
    """One row: pool materials, those with valence-map hops, those of them with a hop that has a DFT barrier too."""
    pool = table(spark, folder, "bvel13k_index").select(plain_id(F.col("material_id")).alias("material")).where("material is not null").distinct()
    edges = table(spark, folder, "nebbvse122k_index").select(plain_id(F.col("material_id")).alias("material"), plain_id(F.col("edge_id")).alias("edge"))
    dft = hops(spark, folder).where("edge is not null").select("edge").distinct()
    both = edges.join(dft, "edge", "left_semi")
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return n(pool, "n_pool").crossJoin(n(pool.join(edges, "material", "left_semi"), "n_with_edges")).crossJoin(n(pool.join(both, "material", "left_semi"), "n_with_dft")).crossJoin(n(pool.join(edges, "material", "left_anti"), "n_without_edges"))


def jon_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the split and size of their frame and the system of their material in the pool."""
    r = table(spark, folder, "inference_record").select("row_id", "frame_id", plain_id(F.col("material_id")).alias("material"))
    f = frames(spark, folder).select("frame_id", "split", "n")
    b = table(spark, folder, "bvel13k_index").select(plain_id(F.col("material_id")).alias("material"), plain_chemsys(F.col("chemsys")).alias("system")).groupBy("material").agg(F.min("system").alias("system"))
    return r.join(f, "frame_id").join(b, "material", "left").select("row_id", "split", "n", "system")


def flt_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Hop rows against the rules of a linkage table: which rule each breaks."""
    d = table(spark, folder, "nebdft2k_index").select("row_id", plain_id(F.col("material_id")).alias("m"), plain_id(F.col("edge_id")).alias("e"), plain_split(F.col("_split")).alias("s"))
    t = F.array_join(F.array_compact(F.array(F.when(F.col("m").isNull(), "no_material"), F.when(F.col("e").isNull(), "no_edge"), F.when(~F.startswith("e", F.concat("m", F.lit("_"))), "edge_of_other_material"), F.when(F.col("s").isNull() | ~F.col("s").isin("train", "val", "test"), "no_split"))), ";")
    return d.select("row_id", t.alias("broken")).where("broken <> ''")


def flt_conflicting_materials(spark: SparkSession, folder: str) -> DataFrame:
    h = all_hops(spark, folder).where("material is not null")
    return h.groupBy("material").agg(F.countDistinct("system", "split").alias("n_pairs")).where("n_pairs > 1")


def flt_unique_success(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "inference_record").groupBy("record_key").agg(F.count_if(F.col("status") == "success").alias("n_success")).where("n_success > 1")


def flt_magnitudes(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: do all energies per atom, forces and stresses have a plausible magnitude?"""
    f = table(spark, folder, "frame_geometry").join(frames(spark, folder).select("frame_key", "source"), "frame_key")
    most = lambda c: F.array_max(F.transform(F.flatten(c), lambda v: F.abs(v)))
    return f.groupBy("source").agg(F.bool_and(F.abs(F.col("energy") / F.size("numbers")) < 20).alias("energy_ok"), F.bool_and(most("forces") < 50).alias("force_ok"), F.bool_and(F.array_max(F.transform("stress", lambda v: F.abs(v))) < 10).alias("stress_ok"))


def flt_informative(spark: SparkSession, folder: str) -> DataFrame:
    f = frames(spark, folder)
    return f.select("frame_key", F.size(F.filter(F.flatten("forces"), lambda v: F.abs(v) >= 0.1)).alias("n_informative"))


def srt_largest_components(spark: SparkSession, folder: str) -> DataFrame:
    """Per frame the three force components of largest magnitude, the earlier of equal ones."""
    flat = frames(spark, folder).where("forces is not null").select("frame_key", F.transform(F.flatten("forces"), lambda v, i: F.struct((-F.abs(v)).alias("m"), i.alias("i"))).alias("c"))
    return flat.select("frame_key", F.explode(F.slice(F.array_sort("c"), 1, 3)).alias("c")).select("frame_key", F.col("c.i").alias("component"), (-F.col("c.m")).alias("magnitude"))


def srt_model_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The model with the fewest failures among those with at least half of the best coverage, then by name."""
    r = table(spark, folder, "inference_record").groupBy("model_name").agg(F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") != "success").alias("n_failed"))
    best = r.agg((F.max("n_success") * 0.5).alias("least"))
    return r.crossJoin(F.broadcast(best)).where("n_success >= least").orderBy("n_failed", "model_name").limit(1).select("model_name", "n_success", "n_failed")


def sta_percolation(spark: SparkSession, folder: str) -> DataFrame:
    return PC.rate_limiting(table(spark, folder, "nebbvse122k_index").select("edge_id", "em"))


def sta_physical_hops(spark: SparkSession, folder: str) -> DataFrame:
    return PC.merged_hops(table(spark, folder, "nebbvse122k_index"))


def jon_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """val and test frames whose geometry stands in a train frame of the same material, atoms in the same order."""
    f = table(spark, folder, "frame_geometry").join(frames(spark, folder).select("frame_key", "material", "split"), "frame_key").select(F.col("frame_key").alias("id"), "material", "split", "numbers", "positions", "cell")
    return M.tolerance_join(f.where("split <> 'train'"), f.where("split = 'train'"), 1e-2)


def jon_classified(spark: SparkSession, folder: str) -> DataFrame:
    f = frames(spark, folder)
    found = jon_tolerance(spark, folder).join(f.select(F.col("frame_key").alias("right_id"), F.col("source").alias("hop")), "right_id")
    return M.classified(f.where("split <> 'train'").select(F.col("frame_key").alias("id")), found)


def agg_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Tallies of the mapping: frames by split and status, their candidates, and the most that one has."""
    split = frames(spark, folder).select(F.col("frame_key").alias("id"), "split")
    return jon_classified(spark, folder).join(split, "id").groupBy("split", "status").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("candidate_count").alias("n_candidates"), F.max("candidate_count").alias("most"))


#: Of the embeddings; the rows labelled below 5 are the development side.
DIMS = 64


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


#: Neighbours, and the quantile of the development side's own distances that bounds the support.
NEIGHBOURS, LEVEL = 5, 0.95


def _distances(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Distances of all rows, and the development side, both by the development side's mean and deviation."""
    v = _vectors(spark, folder)
    z = SU.standardised(v, DIMS, v.where("group < 5"))
    return SU.support_distances(z, z.where("group < 5"), NEIGHBOURS), z.where("group < 5")


def sta_support(spark: SparkSession, folder: str) -> DataFrame:
    return _distances(spark, folder)[0].select("id", F.round("distance", 6).alias("distance"))


def sta_gate(spark: SparkSession, folder: str) -> DataFrame:
    d, development = _distances(spark, folder)
    d = written(d)
    tau = SU.support_threshold(d, development, LEVEL)
    return SU.gated(d.crossJoin(F.broadcast(tau)), F.col("tau_d")).select("id", F.round("distance", 6).alias("distance"), "supported", "reason")


def sta_shift_weights(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).select("id", "x", F.when(F.col("group") < 5, "p").otherwise("q").alias("side"))
    model = SU.fit_domain(v, DIMS)
    return v.select("id", "side", SU.shift_weight(F.col("x"), model, 20.0).alias("weight"), SU.q_probability(F.col("x"), model).alias("q_probability"))


def agg_auc(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder).select("id", F.round(F.col("x")[0], 2).alias("s"), F.when(F.col("group") < 5, "p").otherwise("q").alias("side"))
    return SU.auc(v, "s").select(F.round("auc", 8).alias("auc"))


def agg_weight_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    h = hops(spark, folder).withColumn("w", F.col("em_dft") + 0.1)
    d = SU.weight_diagnostics(h, "w")
    return d.select(*(F.round(c, 6).alias(c) for c in d.columns))


QUERIES = {f.__name__: f for f in (src_column_summary, src_nested_profile, agg_split_summary, agg_spans, agg_archive_steps, agg_step_histogram, agg_kinds, agg_status_counts, agg_largest_frame, agg_repeated, agg_examples, win_runs, set_compare, jon_overlaps, set_tagged_union, set_exclusions, jon_linkage, jon_enrichment, flt_consistency, flt_conflicting_materials, flt_unique_success, flt_magnitudes, flt_informative, srt_largest_components, srt_model_selection, sta_percolation, sta_physical_hops, jon_tolerance, jon_classified, agg_mapping, sta_support, sta_gate, sta_shift_weights, agg_auc, agg_weight_diagnostics)}

_M = f"{sql_id('material_id')} as material"
_STEPS = f"steps as (select {sql_id('edge_id')} as edge, count(distinct step) as n_steps, max(step) as last_step, min(step) = 0 and max(step) = count(distinct step) - 1 as contiguous from hop_member where kind = 'band_optim_step' and step is not null group by 1 having edge is not null)"
_MEM = f"{_M} from"
_VEC = """v as (select vec_id as id, label as g, list_transform(embedding, lambda x: x::double) as x from embeddings), u as (select id, g, unnest(x) as x, unnest(range(1, 65)) as k from v),
st as (select k, avg(x) as m, stddev_pop(x) as s from u where g < 5 group by 1), z as (select u.id, u.g, u.k, (u.x - st.m) / case when st.s > 0 then st.s else 1 end as x from u join st using (k)),
d as (select a.id, b.id as r, sqrt(sum((a.x - b.x) * (a.x - b.x))) as d from z a join z b on a.k = b.k and a.g <> b.g and b.g < 5 group by 1, 2),
dist as (select id, round(case when count(*) = 5 then avg(d) end, 6) as distance from (select * from d qualify row_number() over (partition by id order by d, r) <= 5) group by 1)"""
_inverse = {(i, j): f"(la[{(j + 1) % 3 + 1}][{(i + 1) % 3 + 1}] * la[{(j + 2) % 3 + 1}][{(i + 2) % 3 + 1}] - la[{(j + 1) % 3 + 1}][{(i + 2) % 3 + 1}] * la[{(j + 2) % 3 + 1}][{(i + 1) % 3 + 1}])" for i in range(3) for j in range(3)}  # times the determinant
_fraction = lambda j: "round((" + " + ".join(f"d{k + 1} * {_inverse[k, j]}" for k in range(3)) + ") / det)"
_MET = f"""{FRAMES}, fr as (select f.frame_key, f.material, f.split, f.source, g.numbers, g.positions, g.cell from frames f join frame_geometry g using (frame_key) where g.positions is not null and g.cell is not null and len(g.numbers) > 0 and len(g.positions) = len(g.numbers)),
pr as (select a.frame_key as l, b.frame_key as r, b.source as hop, a.positions as xa, b.positions as xb, a.cell as la from fr a join fr b on a.material = b.material and a.numbers = b.numbers where a.split <> 'train' and b.split = 'train' and list_max(list_transform(list_zip(flatten(a.cell), flatten(b.cell)), lambda c: abs(c[1] - c[2]))) <= 0.01),
dv as (select *, la[1][1] * {_inverse[0, 0]} + la[1][2] * {_inverse[1, 0]} + la[1][3] * {_inverse[2, 0]} as det from pr), atoms as (select l, r, hop, la, det, unnest(list_zip(xa, xb)) as q from dv),
dd as (select l, r, hop, la, det, {', '.join(f'q[2][{k}] - q[1][{k}] as d{k}' for k in (1, 2, 3))} from atoms),
ww as (select l, r, hop, {', '.join(f"d{k} - ({' + '.join(f'{_fraction(j)} * la[{j + 1}][{k}]' for j in range(3))}) as w{k}" for k in (1, 2, 3))} from dd),
met as (select l as left_id, r as right_id, any_value(hop) as hop from ww group by 1, 2 having max(w1 * w1 + w2 * w2 + w3 * w3) <= 1e-4)"""
_all_of = lambda c, fn: " union all ".join(f"select '{t}' as t, {sql_id('material_id')} as material from {t}" for t in c)

SQL = {
    "src_column_summary": " union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) filter (where nullif(trim({c}::varchar), '') is null) as n_null, count(*) filter (where isfinite(try_cast(nullif(trim({c}::varchar), '') as double))) as n_numeric, count(distinct nullif(trim({c}::varchar), '')) as n_distinct from nebdft2k_index" for c in ("material_id", "edge_id", "chemsys", "em_dft", "_split")),
    "src_nested_profile": "select source_file as source, count(*) as n_frames, count(*) filter (where positions is null) as n_unreadable, count(*) filter (where n_atoms <> len(numbers)) as n_at_odds, min(len(numbers))::int as least_atoms, max(len(numbers))::int as most_atoms from frame_geometry group by 1",
    "agg_split_summary": f"with {ALL_HOPS} select split, count(*) as n_rows, count(distinct system) as n_systems, count(distinct edge) as n_units from hops where split is not null group by 1",
    "agg_spans": f"with {ALL_HOPS} select material, count(distinct split) as n_values from hops where material is not null and split is not null group by 1 having n_values > 1",
    "agg_archive_steps": f"with {_STEPS} select * from steps",
    "agg_step_histogram": f"with {_STEPS} select n_steps, contiguous, count(*) as n_hops from steps group by 1, 2",
    "agg_kinds": f"select {sql_id('edge_id')} as edge, count(*) filter (where kind = 'source') as n_source, count(*) filter (where kind = 'target') as n_target, count(*) filter (where kind = 'traj_init') as n_traj_init from hop_member group by 1 having edge is not null",
    "agg_status_counts": "select model_name, " + ", ".join(f"count(*) filter (where status = 'success' and published_split = '{s}') as {s}" for s in ("train", "val", "test")) + " from inference_record group by 1",
    "agg_largest_frame": f"with {FRAMES} select material, frame_key, n from frames where material is not null qualify row_number() over (partition by material order by n desc, frame_key) = 1",
    "agg_repeated": "select lower(trim(source_file)) as source_file, frame_index, count(*) as n, min(entry_id) as first_row, max(entry_id) as last_row from frame_index group by 1, 2 having n > 1",
    "agg_examples": f"with {FRAMES}, r as (select split, material, row_number() over (partition by split order by material is null, frame_key) as p from frames where split is not null) select split, count(material) as n_values, string_agg(material, ';' order by p) filter (where p <= 5 and material is not null) as examples from r group by 1",
    "win_runs": f"""with f as (select source_file, frame_index, {_M} from frame_geometry), s as (select *, material is distinct from lag(material) over w or row_number() over w = 1 as st from f window w as (partition by source_file order by frame_index))
select source_file, count(*) filter (where st) as n_runs, count(distinct material) + max((material is null)::int) as n_values, count(*) filter (where st) = count(distinct material) + max((material is null)::int) as contiguous from s group by 1""",
    "set_compare": f"""with {ALL_HOPS}, a as (select distinct material from hops where material is not null), b as (select distinct material from (select {_M} from bvel13k_index) where material is not null),
p as (select coalesce(a.material, b.material) as v, a.material is not null as ina, b.material is not null as inb from a full join b on a.material = b.material)
select count(*) filter (where ina and inb) as n_both, count(*) filter (where ina and not inb) as n_only_a, count(*) filter (where inb and not ina) as n_only_b, min(v) filter (where ina and inb) as first_both, min(v) filter (where ina and not inb) as first_only_a, min(v) filter (where inb and not ina) as first_only_b from p""",
    "jon_overlaps": "with u as (select distinct * from (" + _all_of(("bvel13k_index", "nebbvse122k_index", "nebdft2k_index", "frame_geometry"), None) + ") where material is not null) select a.t as left_table, b.t as right_table, count(*) as n_common from u a join u b on a.material = b.material and a.t < b.t group by 1, 2",
    "set_tagged_union": f"with {FRAMES}, {ALL_HOPS}, u as (select 'frame' as kind, material, split from frames union all select 'hop', material, split from hops) select material, count(*) filter (where kind = 'frame') as n_frames, count(*) filter (where kind = 'hop') as n_hops, count(distinct split) as n_splits from u where material is not null and split is not null group by 1",
    "set_exclusions": f"with {FRAMES}, {ALL_HOPS} select {_M} from bvel13k_index where {sql_id('material_id')} is not null except (select material from hops union select material from frames)",
    "jon_linkage": f"""with {HOPS}, pool as (select distinct m from (select {sql_id('material_id')} as m from bvel13k_index) where m is not null), e as (select {sql_id('material_id')} as m, {sql_id('edge_id')} as edge from nebbvse122k_index)
select (select count(*) from pool) as n_pool, (select count(*) from pool where m in (select m from e)) as n_with_edges, (select count(*) from pool where m in (select m from e where edge in (select edge from hops where edge is not null))) as n_with_dft,
  (select count(*) from pool where not exists (select 1 from e where e.m = pool.m)) as n_without_edges""",
    "jon_enrichment": f"with {FRAMES}, b as (select {sql_id('material_id')} as m, min({sql_chemsys('chemsys')}) as system from bvel13k_index group by 1) select r.row_id, f.split, f.n, b.system from inference_record r join frames f on f.frame_id = r.frame_id left join b on b.m = {sql_id('r.material_id')}",
    "flt_consistency": f"""with d as (select row_id, {sql_id('material_id')} as m, {sql_id('edge_id')} as e, {sql_split('_split')} as s from nebdft2k_index),
t as (select row_id, concat_ws(';', case when m is null then 'no_material' end, case when e is null then 'no_edge' end, case when not starts_with(e, m || '_') then 'edge_of_other_material' end, case when s is null or s not in ('train', 'val', 'test') then 'no_split' end) as broken from d) select * from t where broken <> ''""",
    "flt_conflicting_materials": f"with {ALL_HOPS} select material, count(distinct system || '|' || split) as n_pairs from hops where material is not null group by 1 having n_pairs > 1",
    "flt_unique_success": "select record_key, count(*) filter (where status = 'success') as n_success from inference_record group by 1 having n_success > 1",
    "flt_magnitudes": f"with {FRAMES} select f.source, bool_and(abs(g.energy / len(g.numbers)) < 20) as energy_ok, bool_and(list_max(list_transform(flatten(g.forces), lambda v: abs(v))) < 50) as force_ok, bool_and(list_max(list_transform(g.stress, lambda v: abs(v))) < 10) as stress_ok from frame_geometry g join frames f using (frame_key) group by 1",
    "flt_informative": f"with {FRAMES} select frame_key, len(list_filter(flatten(forces), lambda v: abs(v) >= 0.1))::int as n_informative from frames",
    "srt_largest_components": f"with {FRAMES}, c as (select frame_key, unnest(flatten(forces)) as v, unnest(range(0, len(flatten(forces)))) as i from frames where forces is not null) select frame_key, i::int as component, abs(v) as magnitude from c qualify row_number() over (partition by frame_key order by abs(v) desc, i) <= 3",
    "srt_model_selection": "with r as (select model_name, count(*) filter (where status = 'success') as n_success, count(*) filter (where status <> 'success') as n_failed from inference_record group by 1) select * from r where n_success >= (select max(n_success) * 0.5 from r) order by n_failed, model_name limit 1",
    "sta_physical_hops": f"""with e as (select {sql_id('edge_id')} as e, em from nebbvse122k_index), m as (select regexp_extract(e, '^(.+)((?:_-?[0-9]{{1,9}}){{5}})$', 1) as material_id, list_transform(regexp_extract_all(regexp_extract(e, '^(.+)((?:_-?[0-9]{{1,9}}){{5}})$', 2), '-?[0-9]+'), lambda x: x::int) as q, em from e where regexp_matches(e, '^.+_[0-9]{{1,9}}_[0-9]{{1,9}}_-?[0-9]{{1,9}}_-?[0-9]{{1,9}}_-?[0-9]{{1,9}}$')),
h as (select material_id, case when q[1] > q[2] or (q[1] = q[2] and [-q[3], -q[4], -q[5]] > [q[3], q[4], q[5]]) then [q[2], q[1], -q[3], -q[4], -q[5]] else q end as q, case when isfinite(em) then em end as em from m)
select material_id, q[1] as s, q[2] as t, q[3] as ox, q[4] as oy, q[5] as oz, min(em) as lo, max(em) as hi, count(*) as n_rows, count(*) - count(em) as n_bad from h group by 1, 2, 3, 4, 5, 6""",
    "jon_tolerance": f"with {_MET} select left_id, right_id from met",
    "jon_classified": f"""with {_MET}, c as (select left_id, count(distinct right_id) as nc, count(distinct hop) as nh, min(hop) as hop from met group by 1)
select f.frame_key as id, case when nc is null then 'unmapped' when nh > 1 then 'ambiguous' when nc = 1 then 'mapped_unique' else 'mapped_hop_unique' end as status, coalesce(nc, 0) as candidate_count, case when nh = 1 then hop end as hop from frames f left join c on c.left_id = f.frame_key where f.split <> 'train'""",
    "agg_mapping": f"""with {_MET}, c as (select left_id, count(distinct right_id) as nc, count(distinct hop) as nh from met group by 1),
s as (select f.split, case when nc is null then 'unmapped' when nh > 1 then 'ambiguous' when nc = 1 then 'mapped_unique' else 'mapped_hop_unique' end as status, coalesce(nc, 0) as n from frames f left join c on c.left_id = f.frame_key where f.split <> 'train')
select split, status, count(*) as n_frames, sum(n)::bigint as n_candidates, max(n) as most from s group by 1, 2""",
    "sta_support": f"with {_VEC} select v.id, distance from v left join dist using (id)",
    "sta_gate": f"""with {_VEC}, j as (select v.id, v.g, distance from v left join dist using (id)), t as (select quantile_cont(avg_d, 0.95) as tau from (select id, avg(d) as avg_d from (select * from d qualify row_number() over (partition by id order by d, r) <= 5) group by 1) x join v using (id) where v.g < 5),
g as (select id, distance, exact, case when exact is null then 'missing_feature' when exact > (select tau from t) then 'outside_support' end as reason from (select j.*, e.avg_d as exact from j left join (select id, avg(d) as avg_d from (select * from d qualify row_number() over (partition by id order by d, r) <= 5) group by 1 having count(*) = 5) e using (id)))
select id, distance, reason is null as supported, reason from g""",
    "agg_auc": """with v as (select round(embedding[1]::double, 2) as s, label >= 5 as q from embeddings), r as (select q, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as r from v)
select round((sum(r) filter (where q) - count(*) filter (where q) * (count(*) filter (where q) + 1) / 2) / (count(*) filter (where q) * count(*) filter (where not q)), 8) as auc from r""",
    "agg_weight_diagnostics": f"with {HOPS}, w as (select em_dft + 0.1::double as w from hops) select round(sum(w) * sum(w) / sum(w * w), 6) as effective_size, round(max(w), 6) as most, round(quantile_cont(w, 0.05), 6) as q05, round(quantile_cont(w, 0.5), 6) as q50, round(quantile_cont(w, 0.95), 6) as q95 from w",
}
