"""Force sums per element as mergeable sufficient statistics, and what is estimated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.physics import component_sets, residual_fraction, slope
from sitewise.operators.prefix import join_value, prefix_by_value, quantiles
from sitewise.shared import written

INFORMATIVE = 0.1


def force_components(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(model, frame_id, material_id, z, x, y): each component of each atom that both sides have.

    reference: frame_id, material_id, numbers, forces; predicted: model, frame_id, forces, of the first atoms. Atoms that
    one side lacks are left out; alignment() counts them.
    """
    both = predicted.select("model", "frame_id", F.col("forces").alias("fy")).join(reference.select("frame_id", "material_id", "numbers", F.col("forces").alias("fx")), "frame_id")
    atoms = both.select("model", "frame_id", "material_id", F.explode(F.arrays_zip("numbers", "fx", "fy")).alias("a")).where("a.fx is not null and a.fy is not null and a.numbers is not null")
    parts = atoms.select("model", "frame_id", "material_id", F.col("a.numbers").alias("z"), F.explode(F.arrays_zip(F.col("a.fx").alias("x"), F.col("a.fy").alias("y"))).alias("c"))
    return parts.select("model", "frame_id", "material_id", "z", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


def alignment(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per model: predicted frames, those without a reference frame, atoms that both sides have, atoms that one lacks,
    and atoms whose forces aren't three numbers."""
    both = predicted.select("model", "frame_id", F.col("forces").alias("fy")).join(reference.select("frame_id", F.col("forces").alias("fx"), F.lit(True).alias("known")), "frame_id", "left")
    nx, ny = F.coalesce(F.size("fx"), F.lit(0)), F.coalesce(F.size("fy"), F.lit(0))
    ragged = F.size(F.filter("fy", lambda r: (F.size(r) != 3) | F.exists(r, lambda v: v.isNull())))
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("known").isNull()).alias("n_unknown"), F.sum(F.least(nx, ny)).alias("n_aligned"), F.sum(F.greatest(nx - ny, F.lit(0))).alias("n_not_predicted"), F.sum(F.greatest(ny - nx, F.lit(0))).alias("n_without_reference"), F.sum(ragged).alias("n_ragged"))


def exact_sum(c: Column) -> Column:
    """A sum of doubles to 14 decimal places that no order of rows or tasks can change."""
    return F.sum(c.cast("decimal(28,14)")).cast("double")


def element_statistics(components: DataFrame, informative: float = INFORMATIVE) -> DataFrame:
    """Per model, frame and element: atoms, informative components, and the sums of products."""
    return components.groupBy("model", "frame_id", "material_id", "z").agg(
        (F.count(F.lit(1)) / 3).cast("long").alias("n_atoms"),
        F.count_if(F.abs("x") >= informative).alias("n_informative"),
        exact_sum(F.col("x") * F.col("y")).alias("sxy"),
        exact_sum(F.col("x") * F.col("x")).alias("sxx"),
        exact_sum(F.col("y") * F.col("y")).alias("syy"),
    )


def combined(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Element rows rolled up to component sets: keys, component_set and summed statistics."""
    each = stats.withColumn("component_set", F.explode(component_sets(F.col("z"))))
    return each.groupBy(*keys, "component_set").agg(*(F.sum(c).alias(c) for c in ("n_atoms", "n_informative", "sxy", "sxx", "syy")))


def support_reasons(n_frames: Column, n_informative: Column, n_materials: Column | None, least: tuple[int, int, int]) -> Column:
    """Why an estimate isn't supported, in fixed order; empty if it is."""
    tests = [F.when(n_frames < least[0], "too_few_frames"), F.when(n_informative < least[1], "too_few_informative_components")]
    if n_materials is not None:
        tests.append(F.when(n_materials < least[2], "too_few_materials"))
    return F.array_compact(F.array(*tests))


def estimates(stats: DataFrame, scope: list[str], least: tuple[int, int, int] = (10, 100, 3), *, pooled: bool = True) -> DataFrame:
    """Per scope, component set and model: frames, materials, informative components, slope, residual and status.

    An unsupported estimate keeps its counts and has null values; it is never replaced by another scope's.
    """
    sets = combined(stats, ["model", "frame_id", "material_id", *[s for s in scope if s not in ("model", "material_id")]])
    a = sets.where("n_atoms > 0").groupBy(*dict.fromkeys(["model", *scope]), "component_set").agg(
        F.count(F.lit(1)).alias("n_frames"), F.countDistinct("material_id").alias("n_materials"), *(F.sum(c).alias(c) for c in ("n_informative", "sxy", "sxx", "syy"))
    )
    reasons = support_reasons(F.col("n_frames"), F.col("n_informative"), F.col("n_materials") if pooled else None, least)
    a = a.withColumn("reasons", reasons)
    good = F.size("reasons") == 0
    return a.select(*dict.fromkeys(["model", *scope]), "component_set", "n_frames", "n_materials", "n_informative", F.when(good, slope(F.col("sxy"), F.col("sxx"))).alias("slope"), F.when(good, residual_fraction(F.col("sxy"), F.col("sxx"), F.col("syy"))).alias("residual"), F.when(good, "estimated").otherwise("unsupported").alias("status"), F.array_join("reasons", ";").alias("reasons"))


def energy_deciles(frames: DataFrame) -> DataFrame:
    """(frame_key, decile): energy per atom above the lowest of the same material and size, cut at nine linear quantiles.

    A value on a cut belongs to the lower decile. frames: frame_key, material_id, n, energy, without nulls.
    """
    low = frames.groupBy("material_id", "n").agg(F.min("energy").alias("low"))
    above = frames.join(low, ["material_id", "n"]).select("frame_key", ((F.col("energy") - F.col("low")) / F.col("n")).alias("above"))
    above = written(above)
    cuts = quantiles(above, [], "above", [k / 10 for k in range(1, 10)], "cuts").select("cuts")
    return above.crossJoin(F.broadcast(cuts)).select("frame_key", (1 + F.size(F.filter("cuts", lambda c: c < F.col("above")))).alias("decile"))


def error_metrics(pairs: DataFrame, group: list[str], predicted: str, reference: str, thresholds: list[float]) -> DataFrame:
    """Per group: n, mae, rmse, mean and median absolute error, and for each threshold precision, recall and f1 of `<`."""
    d = F.col(predicted) - F.col(reference)
    out = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias")]
    for t in thresholds:
        p, r = F.col(predicted) < t, F.col(reference) < t
        tp, fp, fn = F.count_if(p & r), F.count_if(p & ~r), F.count_if(~p & r)
        name = str(t).replace(".", "_")
        out += [tp.alias(f"tp_{name}"), fp.alias(f"fp_{name}"), fn.alias(f"fn_{name}"), (tp / F.nullif(tp + fp, F.lit(0))).alias(f"precision_{name}"), (tp / F.nullif(tp + fn, F.lit(0))).alias(f"recall_{name}"), (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias(f"f1_{name}")]
    middle = quantiles(pairs.select(*group, F.abs(d).alias("_abs")), group, "_abs", [0.5]).select(*group, F.col("q")[0].alias("median_abs"))
    return pairs.groupBy(*group).agg(*out).join(middle, group, "left")


def error_reduction(pairs: DataFrame, group: list[str], raw: str, corrected: str, reference: str) -> DataFrame:
    """1 - mean |corrected - reference| / mean |raw - reference|; null where raw is perfect."""
    return pairs.groupBy(*group).agg((1 - F.avg(F.abs(F.col(corrected) - F.col(reference))) / F.nullif(F.avg(F.abs(F.col(raw) - F.col(reference))), F.lit(0.0))).alias("reduction"), F.count(F.lit(1)).alias("n"))


def barrier(images: DataFrame, path: list[str], energy: str) -> DataFrame:
    """Per path: highest minus lowest energy of at least two images, null otherwise; NaN energies count as missing."""
    e = F.when(~F.isnan(energy), F.col(energy))
    return images.groupBy(*path).agg(F.count(e).alias("n_images"), F.when(F.count(e) >= 2, F.max(e) - F.min(e)).alias("barrier"))


def common_population(members: DataFrame, method: str, item: str) -> DataFrame:
    """Items that every method has, and how many each method has besides: (item, in_all)."""
    n = members.select(method).distinct().agg(F.count(F.lit(1)).alias("n_methods"))
    per = members.groupBy(item).agg(F.countDistinct(method).alias("m"))
    return per.crossJoin(F.broadcast(n)).select(item, (F.col("m") == F.col("n_methods")).alias("in_all"))


def ratio_interval(draws: DataFrame, group: list[str], level: float = 0.95) -> DataFrame:
    """Per group of bootstrap slopes: linear tail percentiles; null with a reason if a draw is undefined."""
    tail = (1 - level) / 2
    undefined = F.count_if(F.col("slope").isNull())
    q = F.percentile("slope", F.array(F.lit(tail), F.lit(1 - tail)))
    return draws.groupBy(*group).agg(F.count(F.lit(1)).alias("n_draws"), F.when(undefined == 0, q[0]).alias("lower"), F.when(undefined == 0, q[1]).alias("upper"), F.when(undefined > 0, "undefined_draw").alias("reason"))


def median_split(frames: DataFrame, group: list[str], energy: str, order: str) -> DataFrame:
    """frames with half: 'low' for the first ceil(n / 2) by energy and order, else 'high'; ranks are prefix sums."""
    keyed = frames.withColumn("_by", F.struct(F.col(energy).alias("e"), F.col(order).alias("o")))
    per = prefix_by_value(keyed, group, "_by", {"_n": F.lit(1)})
    n = frames.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    rows = join_value(keyed, per, group, "_by", ["_n_upto"]).join(n, group)
    return rows.withColumn("half", F.when(F.col("_n_upto") <= F.floor((F.col("_all") + 1) / 2), "low").otherwise("high")).drop("_by", "_n_upto", "_all")
