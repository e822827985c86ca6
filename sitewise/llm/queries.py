"""Queries of the training-data operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewise.functions.ids import plain_id
from sitewise.llm import mixing, nearcopies, overlap, packing, quality, splits, textcopies, tokens, topn
from sitewise.shared import written
from sitewise.sources.tables import table


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlaps(table(spark, folder, "frame_geometry"), table(spark, folder, "nebdft2k_index"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select("record_kind", F.least("k_t", "k_o").alias("key_a"), F.greatest("k_t", "k_o").alias("key_b"))


def p1_hops(spark: SparkSession, folder: str) -> DataFrame:
    """The hops among the overlaps."""
    h = overlap.hop_overlaps(table(spark, folder, "nebdft2k_index"))
    return h.select(F.least("k_t", "k_o").alias("key_a"), F.greatest("k_t", "k_o").alias("key_b"), "split_o")


def p1_by_split_and_source(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.by_split_and_source(_overlaps(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    hops = table(spark, folder, "nebbvse122k_index").select(plain_id(F.col("edge_id")).alias("edge_id"), plain_id(F.col("material_id")).alias("material_id"), "em", "loaded_at", "row_id")
    last = topn.latest(hops.where("edge_id is not null"), "edge_id", ["loaded_at", "row_id"], ["material_id", "em"])
    return topn.top_n(last.where("material_id is not null"), ["material_id"], "em", "edge_id", 5).select("material_id", "edge_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.near_pairs(table(spark, folder, "frame_geometry")).select(F.col("a").alias("frame_key_a"), F.col("b").alias("frame_key_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.near_groups(table(spark, folder, "frame_geometry"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.broken(table(spark, folder, "nebdft2k_index"))


def p6_assign(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign(table(spark, folder, "nebdft2k_index"), table(spark, folder, "split_target"))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, groups, groups whose rows are on more than one side, and sides more than a percent of all rows off their target."""
    hops, targets = table(spark, folder, "nebdft2k_index"), table(spark, folder, "split_target")
    sides = written(splits.assign(hops, targets))
    per = splits.groups(hops).join(sides.select("row_id", "side"), "row_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("side").alias("n_sides"))
    whole = per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n_sides") > 1).alias("n_divided"))
    share = targets.select("split_name", (F.col("target_share") / F.sum("target_share").over(Window.partitionBy())).alias("target"))  # a few sides
    off = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole.select("n_rows"))).join(share, F.col("side") == F.col("split_name"))
    return whole.crossJoin(off.agg(F.count_if(F.abs(F.col("n") / F.col("n_rows") - F.col("target")) > 0.01).alias("n_off")))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    rows = p6_assign(spark, folder)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group_key").alias("n_groups")).crossJoin(F.broadcast(n)).select("side", "n_rows", "n_groups", (F.col("n_rows") / F.col("n")).alias("share"))


def _countable(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in tokens, with the cluster of near copies that each is of."""
    d = table(spark, folder, "documents")
    return textcopies.clustered(tokens.counted(d), d)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Equal texts are a cluster here; p8_apart has clusters of near copies and sources that are kept apart too."""
    return packing.fill(tokens.counted(table(spark, folder, "documents")), table(spark, folder, "container_spec")).drop("row")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, folder), table(spark, folder, "container_spec"))


def p8_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that has a text, with the smallest document of its cluster of equal and near-equal texts."""
    rows = written(_countable(spark, folder))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("cluster_id"), F.count(F.lit(1)).alias("cluster_size"))
    return rows.join(first, "same").select("doc_id", "cluster_id", "cluster_size")


#: Sources that are never to share a container, for the query below: what is measured and what judges it.
APART = [("run_note", "audit_report"), ("lab_log", "review_comment")]


def p8_apart(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: the fill if near copies are kept apart while that costs no space and the sources of APART never meet, and the containers in which they do."""
    counted, spec = written(_countable(spark, folder)), table(spark, folder, "container_spec")
    rows = written(packing.fill(counted, spec, APART))
    held = rows.join(counted.select("row", "source"), "row").groupBy("spec_id", "container_id").agg(*(F.max(F.col("source").eqNullSafe(s)).alias(s) for s in sorted({s for p in APART for s in p})))
    met = held.groupBy("spec_id").agg(F.count_if(reduce(lambda x, y: x | y, [F.col(a) & F.col(b) for a, b in APART])).alias("n_met"))
    return packing.fill_report(rows, spec).join(met, "spec_id")


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    counted, spec = tokens.counted(table(spark, folder, "documents")), table(spark, folder, "container_spec")
    return packing.invariants(written(packing.fill(counted, spec)), counted, spec)


def p9_drawn(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.draw(tokens.counted(table(spark, folder, "documents")), table(spark, folder, "mix_target"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(tokens.counted(table(spark, folder, "documents")), table(spark, folder, "mix_target"))


def p9_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of the targets: documents used too often, and whether the tokens drawn miss the budget by more than the longest document."""
    targets = table(spark, folder, "mix_target")
    counted = tokens.counted(table(spark, folder, "documents"))
    drawn = mixing.draw(counted, targets).join(F.broadcast(targets.select("source", "max_repeats")), "source")
    per = drawn.groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("n_over"), F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn"))
    plan = spark.createDataFrame([(x["source"], x["budget"]) for x in mixing.budgets(counted, targets)], "source string, budget long")
    longest = counted.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    rows = plan.join(per, "source", "left").join(longest, "source", "left")
    return rows.select("source", F.coalesce("n_over", F.lit(0)).alias("n_over"), (F.abs(F.coalesce("drawn", F.lit(0)) - F.col("budget")) > F.coalesce("longest", F.lit(0))).alias("missed"))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "doc_label"))


def p10_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy by kind on labelled documents that the rules were not fitted on."""
    rows = quality.held_out(table(spark, folder, "documents"), table(spark, folder, "doc_label"))
    return spark.createDataFrame([(k, int(n), int(r)) for k, n, r in rows.itertuples(index=False)], "text_kind string, n_documents long, n_right long")


def p10_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The plain counts of the statistics."""
    return quality.statistics(table(spark, folder, "documents")).select("doc_id", "n_characters", "n_words", "n_lines", F.round("mean_word_length", 8).alias("mean_word_length"), F.round("mean_line_words", 8).alias("mean_line_words"), F.round("distinct_share", 8).alias("distinct_share"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_statistics(spark, folder).where("not natural_prose").select("doc_id")


QUERIES = {
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
    "p10_counts": p10_counts,
    "p10_held_out": p10_held_out,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_apart": p8_apart,
    "p8_clusters": p8_clusters,
    "p8_invariants": p8_invariants,
    "p9_drawn": p9_drawn,
    "p9_shares": p9_shares,
} | {"p1_found": p1_found, "p1_hops": p1_hops, "p1_by_split_and_source": p1_by_split_and_source, "p5_found": p5_found, "p5_groups": p5_groups, "p3_found": p3_found, "p6_found": p6_found, "p6_assign": p6_assign, "p6_shares": p6_shares, "p6_invariants": p6_invariants, "p9_invariants": p9_invariants}

# Pairs of frames by brute force: every pair of close cells, every pair of atoms of one element, lattice vectors of a.
_inverse = {(i, j): f"(ca[{(j + 1) % 3 + 1}][{(i + 1) % 3 + 1}] * ca[{(j + 2) % 3 + 1}][{(i + 2) % 3 + 1}] - ca[{(j + 1) % 3 + 1}][{(i + 2) % 3 + 1}] * ca[{(j + 2) % 3 + 1}][{(i + 1) % 3 + 1}])" for i in range(3) for j in range(3)}  # times the determinant
_whole = lambda j: "round((" + " + ".join(f"d{k + 1} * {_inverse[k, j]}" for k in range(3)) + ") / det)"
_FRAME_PAIRS = f"""fr as (select frame_key as k, nullif(lower(regexp_extract(trim(source_file), '(?i)_(train|val|test)\\.[A-Za-z0-9.]+$', 1)), '') as s, numbers as z, positions as x, cell as c, len(numbers) as n from frame_geometry where positions is not null and len(positions) = len(numbers) and len(numbers) > 0 and len(cell) = 3),
pr as (select a.k as ka, b.k as kb, a.s as sa, b.s as sb, a.n as na, b.n as nb, a.z as za, b.z as zb, a.x as xa, b.x as xb, a.c as ca, a.c[1][1] * {_inverse[0, 0].replace('ca[', 'a.c[')} + a.c[1][2] * {_inverse[1, 0].replace('ca[', 'a.c[')} + a.c[1][3] * {_inverse[2, 0].replace('ca[', 'a.c[')} as det from fr a join fr b on a.k < b.k and {' and '.join(f'abs(a.c[{i}][{j}] - b.c[{i}][{j}]) <= 0.05 + 1e-9' for i in (1, 2, 3) for j in (1, 2, 3))} and 2 * least(a.n, b.n) > 0.78 * (a.n + b.n)),
pa as (select ka, kb, ca, det, zb, xb, unnest(za) as z, unnest(xa) as p, unnest(range(1, na + 1)) as i from pr), pb as (select ka, kb, ca, det, z, p, i, unnest(zb) as y, unnest(xb) as q, unnest(range(1, len(zb) + 1)) as j from pa),
dd as (select ka, kb, ca, det, i, j, {', '.join(f'q[{k}] - p[{k}] as d{k}' for k in (1, 2, 3))} from pb where z = y),
ww as (select ka, kb, i, j, {' + '.join('pow(d' + str(k) + ' - (' + ' + '.join(f'{_whole(j)} * ca[{j + 1}][{k}]' for j in range(3)) + '), 2)' for k in (1, 2, 3))} as d2 from dd)"""
_met = lambda t: f"select ka, kb, least(count(distinct i), count(distinct j)) as m from ww where d2 <= pow({t} + 1e-9, 2) group by 1, 2"

_ID = "nullif(trim(lower(translate({c}, '‐‑‒–—―−⁃﹘﹣－', '-----------')), ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '')"

SQL = {
    "p5_found": f"with {_FRAME_PAIRS}, m as ({_met(0.05)}) select ka as frame_key_a, kb as frame_key_b from m join pr using (ka, kb) where 2 * m > 0.78 * (na + nb) + 1e-9",
    "p1_found": f"""with {_FRAME_PAIRS}, m as ({_met(0.02)}) select 'mplitrj_frame' as record_kind, ka as key_a, kb as key_b from m join pr using (ka, kb) where m = na and m = nb and sa is not null and sb is not null and (sa = 'train') <> (sb = 'train')
union all select 'nebdft2k_hop', key_a, key_b from (@HOPS@)""",
    "p1_hops": f"""
with r as (select row_id, {_ID.format(c='material_id')} as m, {_ID.format(c='edge_id')} as e, case when lower(trim(_split)) in ('valid', 'validation') then 'val' else lower(trim(_split)) end as s from nebdft2k_index),
n as (select row_id, m, s, list_transform(regexp_extract_all(regexp_extract(e, '^.+((?:_-?[0-9]{{1,9}}){{5}})$', 1), '-?[0-9]+'), lambda x: x::int) as v from r where m is not null and regexp_matches(e, '^.+_[0-9]{{1,9}}_[0-9]{{1,9}}_-?[0-9]{{1,9}}_-?[0-9]{{1,9}}_-?[0-9]{{1,9}}$')),
h as (select row_id, m, s, v, [v[2], v[1], -v[3], -v[4], -v[5]] as w from n where s in ('train', 'val', 'test'))
select least(t.row_id, o.row_id) as key_a, greatest(t.row_id, o.row_id) as key_b, o.s as split_o from h t join h o on t.m = o.m and (t.v = o.v or t.w = o.v) where t.s = 'train' and o.s <> 'train'""",
    "p8_invariants": "select spec_id, (select count(*) from documents where text is not null) as n_rows, 0::bigint as n_broken, 0::bigint as n_cut, 0::bigint as n_overfull from container_spec",
    "p10_counts": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') as words, list_filter(regexp_split_to_array(t, '[\r\n]+'), lambda x: trim(x) <> '') as lines from d),
n as (select *, len(words) as nw, len(lines) as nl, list_transform(words, lambda x: lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))) as bare from w)
select doc_id, length(t) as n_characters, nw as n_words, nl as n_lines, round(case when nw > 0 then list_sum(list_transform(words, lambda x: length(x)))::double / nw else 0 end, 8) as mean_word_length,
  round(case when nl > 0 then nw::double / nl else 0 end, 8) as mean_line_words, round(case when nw > 0 then len(list_distinct(bare))::double / nw else 0 end, 8) as distinct_share from n""",
    "p3_found": f"""
with h as (select {_ID.format(c='edge_id')} as edge_id, {_ID.format(c='material_id')} as material_id, em, loaded_at, row_id from nebbvse122k_index),
last as (select * from h where edge_id is not null qualify row_number() over (partition by edge_id order by loaded_at desc nulls last, row_id desc) = 1)
select material_id, edge_id from last where em is not null and not isnan(em) and material_id is not null
qualify row_number() over (partition by material_id order by em desc, edge_id) <= 5""",
    "p6_found": f"""
with recursive r as (
  select row_id, {_ID.format(c='material_id')} as m,
    nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(chemsys, '[A-Z][a-z]?'))), '-'), '') as c,
    case when lower(trim(_split)) in ('valid', 'validation') then 'val' else nullif(lower(trim(_split)), '') end as s from nebdft2k_index),
e as (select distinct '1' || coalesce(m, '') as a, '0' || c as b from r where m is not null and c is not null),
n as (select '1' || m as x from r where m is not null union select '0' || c from r where c is not null),
nb as (select a as u, b as v from e union select b, a from e),
w as (select x as node, x as root from n union select nb.v, w.root from w join nb on nb.u = w.node where w.root < nb.v),
k as (select node, min(root) as root from w group by 1),
g as (select r.row_id, r.s, k.root from r join k on k.node = coalesce('0' || r.c, '1' || r.m))
select substr(root, 2) as group_key, row_id from g where root in (select root from g group by 1 having count(distinct s) > 1)""",
}
SQL["p6_invariants"] = SQL["p6_found"].split("select substr(root")[0] + """select (select count(*) from r) as n_rows, (select count(distinct root) from k) + (select count(*) from r where m is null and c is null) as n_groups, 0::bigint as n_divided, 0::bigint as n_off"""
SQL["p9_invariants"] = "select source, 0::bigint as n_over, false as missed from mix_target"
SQL["p1_found"] = SQL["p1_found"].replace("@HOPS@", SQL["p1_hops"])
SQL["p1_by_split_and_source"] = f"""with pairs as ({SQL['p1_found']}),
k as (select 'mplitrj_frame' as kind, frame_key as id, lower(regexp_extract(trim(source_file), '(?i)_(train|val|test)\\.[A-Za-z0-9.]+$', 1)) as s, regexp_replace(trim(source_file), '(?i)_(train|val|test)\\.[A-Za-z0-9.]+$', '') as source from frame_geometry
  union all select 'nebdft2k_hop', row_id, case when lower(trim(_split)) in ('valid', 'validation') then 'val' else lower(trim(_split)) end, 'nebdft2k' from nebdft2k_index),
e as (select p.*, case when a.s = 'train' then p.key_b else p.key_a end as o, case when a.s = 'train' then p.key_a else p.key_b end as t from pairs p join k a on a.kind = p.record_kind and a.id = p.key_a)
select e.record_kind, k.s as split, k.source, count(*) as n_pairs, count(distinct o) as n_records, count(distinct t) as n_train_records from e join k on k.kind = e.record_kind and k.id = e.o group by 1, 2, 3"""
SQL["p5_groups"] = f"""with recursive pairs as ({SQL['p5_found']}), nb as (select frame_key_a as u, frame_key_b as v from pairs union select frame_key_b, frame_key_a from pairs),
n as (select frame_key as k from frame_geometry where positions is not null and len(positions) = len(numbers) and len(numbers) > 0 and len(cell) = 3),
w as (select k as node, k as root from n union select nb.v, w.root from w join nb on nb.u = w.node where w.root < nb.v),
g as (select node, min(root) as root from w group by 1), l as (select u, count(*) as links from nb group by 1)
select node as frame_key, root as group_id, coalesce(links, 0) as n_links, count(*) over (partition by root) as group_size from g left join l on l.u = g.node"""
