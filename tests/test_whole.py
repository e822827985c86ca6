"""That queries do their whole job: nothing dropped, capped or sampled."""

import random

import numpy as np
import pytest
from sitewise.operators import screening, support
from sitewise.plans import audit, common, estimation
from sitewise.sources import extxyz
from test_operators import _wcs

RECORD = "row_id long, model_name string, frame_id string, attempt_number int, forces array<array<double>>, force_unit string, remark string"


def test_forces_of_every_known_unit(spark, tmp_path):
    units = ["eV/angstrom", "eV Å^-1", "ev/Ang", "meV/Å", "eV/nm", "Ha/bohr", "?", None]
    rows = [(i, "m", f"f{i}", 1, [[2.0, 0.0, 0.0]], u, "forces: eV/nm" if u is None else None) for i, u in enumerate(units)]
    rows += [(10, "m", "f0", 2, [[5.0, 0.0, 0.0]], "eV/Å", None), (11, "m", "f1", 2, None, None, None)]  # later attempts
    spark.createDataFrame(rows, RECORD).write.parquet(f"{tmp_path}/inference_record.parquet")
    factors = [("force", u, "eV/angstrom", f) for u, f in (("eV/angstrom", 1.0), ("meV/angstrom", 0.001), ("eV/nm", 0.1), ("hartree/bohr", 50.0))]
    spark.createDataFrame(factors, "quantity string, source_unit string, canonical_unit string, factor double").write.parquet(f"{tmp_path}/unit_conversion.parquet")
    got = {r.frame_id: r.forces[0][0] for r in common.predictions(spark, str(tmp_path)).collect()}
    assert got == {"f0": 5.0, "f2": 2.0, "f3": 0.002, "f4": 0.2, "f5": 100.0, "f7": 0.2}
    assert tuple(estimation.agg_force_units(spark, str(tmp_path)).first()) == ("m", 7, 6, 1)


def test_weighted_selection_of_a_large_group(spark):
    """More than 2,000 test units in one group, most scores tied or distinct, beside a group of one."""
    r = random.Random(8)
    cal = [(round(r.random(), 2), r.choice([1.0, 1.5])) for _ in range(900)]
    test = [(r.random() ** 2 - 0.2 if i % 2 else round(r.random() - 0.3, 1), r.choice([1.0, 1.5])) for i in range(2100)]
    rows = [("hot", f"c{i}", "calibration", *x) for i, x in enumerate(cal)] + [("hot", f"t{i:04}", "test", *x) for i, x in enumerate(test)] + [("one", "u", "test", 0.5, 1.0)]
    u = spark.createDataFrame(rows, "g string, unit_id string, side string, score double, weight double")
    got = {x.unit_id: (x.size, x.selected) for x in screening.weighted_selection(u, ["g"], 0.5).collect()}
    assert len(got) == 2101 and got["u"][0] == 1
    wc, m, sized = sum(w for _, w in cal), len(test), sorted((s, sum(w for c, w in cal if c < s)) for s, _ in test)
    for j in range(0, m, 150):  # sizes from the definition
        s, w = test[j]
        rest = list(sized)
        rest.remove(next(x for x in rest if x[0] == s))
        aux = sorted((b + (w if s < t else 0)) / (wc + w) for t, b in rest)
        assert got[f"t{j:04}"][0] == max([1, *(i + 2 for i, a in enumerate(aux) if a <= 0.5 * (i + 2) / m)])


def test_weighted_selection_without_group(spark):
    r = random.Random(5)
    for _ in range(3):
        cal, test = ([(round(r.random() + d, 1), r.choice([0.5, 1.0, 2.0])) for _ in range(n)] for n, d in ((30, 0.2), (25, 0)))
        rows = [(f"c{i}", "calibration", *x) for i, x in enumerate(cal)] + [(f"t{i}", "test", *x) for i, x in enumerate(test)]
        u = spark.createDataFrame(rows, "unit_id string, side string, score double, weight double")
        got = {x.unit_id: (x.selected, x.size) for x in screening.weighted_selection(u, [], 0.5).collect()}
        assert got == {f"t{i}": x for i, x in enumerate(zip(*_wcs(cal, test, 0.5), strict=True))}


def test_audits_know_hops_without_barriers(spark, tmp_path):
    hop = "row_id long, material_id string, edge_id string, chemsys string, _split string, has_specific_tm boolean, em_bvse double, em_dft double"
    rows = [(1, "mp-1", "mp-1_0_1_0_0_0", "Li-O", "train", True, 0.1, 0.2), (2, "mp-1", "mp-1_0_2_0_0_0", "Li-O", "val", True, None, 0.2), (3, "mp-2", "mp-2_0_1_0_0_0", "Li-F", "test", None, 0.1, float("nan"))]
    spark.createDataFrame(rows, hop).write.parquet(f"{tmp_path}/nebdft2k_index.parquet")
    spark.createDataFrame([("mp-1",), ("mp-2",), ("mp-3",)], "material_id string").write.parquet(f"{tmp_path}/bvel13k_index.parquet")
    frame = "frame_key long, frame_id string, material_id string, source_file string, numbers array<int>, energy double, cell array<array<double>>, forces array<array<double>>"
    spark.createDataFrame([], frame).write.parquet(f"{tmp_path}/frame_geometry.parquet")
    run = lambda f: sorted(tuple(r) for r in f(spark, str(tmp_path)).collect())
    assert run(audit.set_exclusions) == [("mp-3",)] and run(audit.agg_spans) == [("mp-1", 2)]
    assert run(audit.flt_conflicting_materials) == [("mp-1", 2)] and run(audit.set_compare)[0][:3] == (2, 0, 1)
    assert run(audit.set_tagged_union) == [("mp-1", 0, 2, 2), ("mp-2", 0, 1, 1)] and sorted(r[1] for r in run(audit.agg_split_summary)) == [1, 1, 1]
    assert common.hops(spark, str(tmp_path)).count() == 1


def test_support_with_a_large_reference(spark):
    """A reference of several blocks, beyond the former cap of 5,000 rows."""
    r = np.random.default_rng(3)
    x, g = r.normal(size=(5300, 3)).round(1), r.integers(0, 7, 5300)
    ref = spark.createDataFrame([(i, int(g[i]), x[i].tolist()) for i in range(5300)], "id long, group int, x array<double>")
    rows = ref.where("id < 40").unionByName(spark.createDataFrame([(9000, 1, [0.0, None, 1.0])], ref.schema))
    got = {t.id: t.distance for t in support.support_distances(rows, ref, 5).collect()}
    assert got.pop(9000) is None and len(got) == 40
    for i, d in got.items():
        assert abs(d - np.sort(np.sqrt(((x[i] - x[g != g[i]]) ** 2).sum(1)))[:5].mean()) < 1e-9


def test_support_is_fitted_on_the_development_side(spark, tmp_path):
    """Mean, deviation and threshold come from rows labelled below 5, whatever the others are."""
    r = np.random.default_rng(6)
    x, g = r.normal(size=(80, 64)), np.arange(80) % 8
    x[g >= 5] *= 50
    spark.createDataFrame([(i, int(g[i]), x[i].tolist()) for i in range(80)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    dev = g < 5
    z = (x - x[dev].mean(0)) / x[dev].std(0)
    d = np.array([np.sort(np.sqrt(((z[i] - z[dev & (g != g[i])]) ** 2).sum(1)))[:5].mean() for i in range(80)])
    tau = np.quantile(d[dev], 0.95)
    got = {t.id: t for t in audit.sta_gate(spark, str(tmp_path)).collect()}
    assert all(abs(got[i].distance - d[i]) < 1e-5 and got[i].supported == (d[i] <= tau) for i in range(80))
    assert sum(t.supported for t in got.values()) == 47


@pytest.mark.parametrize("broken", [0, 4, 9])
def test_broken_frame_start_in_any_range(tmp_path, broken):
    """The count line of one of ten frames is damaged: the same result for every cut into ranges."""
    frame = 'COUNT\nLattice="9 0 0 0 9 0 0 0 9" Properties=species:S:1:pos:R:3:forces:R:3 energy=1.0\nLi 0 0 0 0 0 0\nO 1 1 1 0 0 0\n'
    path = tmp_path / "a.xyz"
    path.write_text("".join(frame.replace("COUNT", "2x" if i == broken else "2") for i in range(10)))
    size = len(frame) - 4
    for chunk in (1 << 20, size, 2 * size, 50, 333):
        of = lambda mode: extxyz.ExtxyzReader({"path": str(path), "mode": mode, "chunk": str(chunk)})  # noqa: E731, B023
        rows = [r for p in of("permissive").partitions() for r in of("permissive").read(p)]
        assert sum(r[-1] is None for r in rows) == 9 and sum(r[-1] is not None for r in rows) == 1
        with pytest.raises(ValueError, match="no frame at byte"):
            [r for p in of("failfast").partitions() for r in of("failfast").read(p)]
