import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import predict, records, screening, transforms
from sitewise.sources import files

XYZ = '2\nLattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:forces:R:3 energy=-1.5 material_id=mp-1\nLi 0 0 {i} 0.1 0 0\nO 1 1 1 0 0 0\n'


def test_system_problems(spark):
    df = spark.createDataFrame([("Li-Fe-O",), ("Li, Fe2 (O)",), ("Li-Xx",), ("lithium Li",), ("",), (None,), ("Li·O",)], "c string")
    assert [r[0] for r in df.select(records.system_problem(F.col("c"))).collect()] == [None, None, "unknown", "leftover", "empty", "empty", "leftover"]


def test_series(spark):
    rows = [([300.0, 400.0], "K"), ([25.0], "°C"), ([25.0], "F"), ([], "K"), (None, "K"), ([-300.0], "C"), ([float("nan")], "K"), ([1.0, None], "K"), ([2e4], "K"), ([1.0], None)]
    got = spark.createDataFrame(rows, "v array<double>, u string").select(records.temperature_series(F.col("v"), F.col("u")).alias("s")).select("s.*").collect()
    assert [r.status for r in got] == ["recoverable", "recoverable", "unit_unresolved", "empty", "missing", "invalid", "invalid", "invalid", "invalid", "unit_unresolved"]
    assert got[1].kelvin == [298.15] and got[2].kelvin is None
    rows = [([0.0, 2.0], "Å²"), ([1.0], "nm^2"), ([1.0], "pc"), ([-1.0], "A2"), ([], "A2"), (None, None)]
    got = spark.createDataFrame(rows, "v array<double>, u string").select(records.displacement_series(F.col("v"), F.col("u")).alias("s")).select("s.*").collect()
    assert [r.status for r in got] == ["recoverable", "recoverable", "unit_unresolved", "invalid", "empty", "missing"] and got[1].angstrom2 == [100.0]


def test_diffusion_pairs(spark):
    rows = [(1, "diffusion_mean_m2_s", 1e-9), (1, "diffusion_mean_cm2_s", 1e-5), (1, "Diffusion_std_si", 2e-9), (1, "diffusion_std_cm2_s", 3e-5), (1, "diffusion_min_cm2_s", 1e-6), (1, "diffusion_max_si", -1.0), (1, "energy_si", 1.0), (2, "diffusivity_si", float("nan"))]
    got = {(r.k, r.name): r.status for r in records.diffusion_pairs(spark.createDataFrame(rows, "k int, name string, value double"), "k").collect()}
    assert got == {(1, "diffusion_mean"): "agrees", (1, "diffusion_std"): "contradicts", (1, "diffusion_min"): "cgs_only", (1, "diffusion_max"): "invalid", (2, "diffusivity"): "invalid"}


def test_record_rules(spark):
    fine = ("k", "f1", "train", "success", 2, 1, -1.0, [[0.0, 0.0, 0.0]], True)
    schema = "record_key string, frame_id string, published_split string, status string, n_atoms int, attempt_number int, energy double, forces array<array<double>>, known boolean"
    rows = [fine, ("", "f1", "train", "failed", 2, 1, None, None, True), ("k", "f9", "x", "odd", 0, 0, None, None, None), ("k", "f1", "val", "success", 1, 1, float("nan"), [[0.0, None, 1.0], [0.0, 0.0, 0.0]], True), ("k", "f1", "val", "failed", 1, 1, 1.0, None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id int, {schema}")
    got = {r.row_id: r.broken for r in records.broken_rules(df, records.record_problems(F.col("known")), "row_id").collect()}
    assert got == {1: "no_key", 2: "unknown_frame;bad_split;bad_status;bad_count;bad_attempt", 3: "no_energy;bad_forces;more_forces_than_atoms", 4: "values_of_a_failure"}
    e = spark.createDataFrame([(-10.0, -5.0, 2), (-10.0, -5.1, 2)], "t double, a double, n int")
    assert [r[0] for r in e.select(records.energy_adds_up(F.col("t"), F.col("a"), F.col("n"))).collect()] == [True, False]


def test_json_paths(spark):
    texts = ['{"a": {"b": {"c": 1}}, "l": [{"x": 1}, {"x": 2, "y": null}], "s": "t"}', "not json", None, "[]", "{}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(records.json_paths(F.col("t"))).collect()]
    assert got == [{"a.b.c": "1", "l.x": "1", "l.y": "null", "s": '"t"'}, None, None, {}, {}]


def test_coverage_and_merge(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "x"), (None, "x")], "k int, v string"), spark.createDataFrame([(2, "y"), (3, "y"), (3, "y")], "k int, v string")
    assert tuple(records.coverage(a, b, ["k"]).first()) == (1, 1, 1)
    assert records.merged([a.where("k = 1"), b.where("k = 2")], ["k"]).count() == 2
    with pytest.raises(Exception, match="two parts"):
        records.merged([a, b], ["k"]).collect()


def test_transforms(spark):
    q = transforms.rotation_matrix(3)
    assert np.allclose(q @ q.T, np.eye(3)) and np.isclose(np.linalg.det(q), 1)
    cell = np.diag([4.0, 5.0, 6.0])
    x = np.array([[0.1, 0.2, 0.3], [3.9, 4.9, 5.9]])
    moved = transforms.translated(x, cell, np.array([0.5, 0.5, 0.5]))
    assert ((moved >= 0) & (moved < [4, 5, 6])).all() and np.allclose(transforms.translated(moved, cell, np.full(3, 0.5)), x)

    def springs(state, numbers, positions, cell):
        p = np.array(positions)
        return float((p**2).sum()), (-2 * p).tolist()

    def first_counts(state, numbers, positions, cell):
        if len(numbers) > 2:
            raise ValueError("too many")
        return float(numbers[0]), [[1.0, 0.0, 0.0]] * len(numbers)

    df = spark.createDataFrame([("f", [3, 8], x.tolist(), cell.tolist()), ("g", [3, 8, 8], [[0.0, 0.0, 0.0]] * 3, cell.tolist())], "frame_id string, numbers array<int>, positions array<array<double>>, cell array<array<double>>")
    r = {y.frame_id: y for y in transforms.invariance(df, dict, springs).collect()}
    assert r["f"].deterministic and r["f"].finite and r["f"].rotation < 1e-12 and r["f"].permutation < 1e-12 and r["f"].translation > 0.1
    r = {y.frame_id: y for y in transforms.invariance(df, dict, first_counts, seed=1).collect()}
    assert r["g"].error.startswith("ValueError") and r["f"].rotation > 0.1


def test_predictor_callbacks(spark, tmp_path):
    df = spark.createDataFrame([(f"f{n}", [3] * n, [[float(n), 0.0, 0.0]] * n, [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]) for n in (1, 2, 3)], "frame_id string, numbers array<int>, positions array<array<double>>, cell array<array<double>>")

    def check(energy, forces, numbers):
        if energy > 2:
            raise ArithmeticError("energy")

    got = predict.predicted(df, "count", dict, lambda s, z, x, c: (len(z), x), check)
    seen = []
    out = predict.compacted(got, str(tmp_path / "out"), seen.append)
    assert {r.frame_id: r.error_type for r in out.collect()} == {"f1": None, "f2": None, "f3": "ArithmeticError"}
    assert [(x["status"], x["n"]) for x in seen] == [("success", 2), ("failed", 1)]


def test_tie_free_weighted_selection(spark):
    """With distinct scores it is the plain rule; ties are settled by the key, whatever the order of rows."""
    rows = [("g", f"c{i}", "calibration", i / 10, 1.0, i) for i in range(20)] + [("g", f"t{i}", "test", i / 20 + 0.01, 1.5, 100 + i) for i in range(8)]
    u = spark.createDataFrame(rows, "g string, unit_id string, side string, score double, weight double, tie int")
    plain = {(r.unit_id, r.size, r.selected) for r in screening.weighted_selection(u, ["g"], 0.6).collect()}
    assert {(r.unit_id, r.size, r.selected) for r in screening.weighted_selection_tie_free(u, ["g"], 0.6, "tie").collect()} == plain
    tied = u.withColumn("score", F.lit(0.5))
    a = screening.weighted_selection_tie_free(tied, ["g"], 0.6, "tie").collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in screening.weighted_selection_tie_free(tied.repartition(3), ["g"], 0.6, "tie").collect()}


def test_false_discoveries_stay_within_the_level(spark):
    """500 uniform samples: p-values of exchangeable scores, stepped up at 0.2, select wrongly in at most 20 % on average."""
    r = np.random.default_rng(12)
    rows = []
    for g in range(500):
        score = r.random(40)
        rows += [(g, f"{g}c{i}", "calibration", float(s), 1.0) for i, s in enumerate(score[:30])] + [(g, f"{g}t{i}", "test", float(s), None) for i, s in enumerate(score[30:])]
    u = spark.createDataFrame(rows, "g int, unit_id string, side string, yhat double, y double")
    p = screening.conformal_pvalues(u, ["g"], 0.5)
    wrong = screening.step_up(p, ["g"], 0.2).groupBy("g").agg(F.max(F.col("selected").cast("double")).alias("any")).agg(F.avg("any")).first()[0]
    assert wrong <= 0.2 + 2 * (0.2 * 0.8 / 500) ** 0.5


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("r/mp-1_0_1_0_0_0.neb/band_optim_step_0.xyz", "r/mp-1_0_1_0_0_0.neb/band_optim_step_2.xyz", "x/mp-1_0_1_0_0_0.neb/band_optim_step_2.xyz", "r/mp-1_0_1_0_0_0.neb/source.xyz", "r/odd.neb/notes", "README", "metadata.json"):
            z.writestr(n, json.dumps({"b": 1, "a": 2}) if n.endswith("json") else XYZ.format(i=0) + XYZ.format(i=1))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    m = files.archive_members(spark, str(tmp_path / "a.zip"))
    hops = {r.edge_id: r for r in files.archive_hops(m).collect()}
    good = hops["mp-1_0_1_0_0_0"]
    assert (good.material_id, good.n_steps, good.last_step, good.contiguous, good.n_endpoints) == ("mp-1", 2, 2, False, 1) and hops["odd"].material_id is None
    found = {(r.name, r.problem) for r in files.archive_problems(m).collect()}
    assert found == {("x/mp-1_0_1_0_0_0.neb/band_optim_step_2.xyz", "duplicate"), ("README", "no_hop"), ("metadata.json", "no_hop"), ("r/odd.neb/notes", "unparseable"), ("r/odd.neb/notes", "unrecognised")}
    f = files.member_frames(m.where("kind = 'source'")).orderBy("place").collect()
    assert [r.place for r in f] == [0, 1] and f[1].positions[0][2] == 1.0
    with pytest.raises(Exception, match="no extended XYZ"):
        files.member_frames(m.where("name = 'README'")).collect()
    c = {r.archive.rsplit("/", 1)[1]: r for r in files.archive_containers(spark, str(tmp_path / "*.zip")).collect()}
    assert c["a.zip"].has_metadata_json and not c["a.zip"].has_data_json and c["a.zip"].metadata_keys == ["a", "b"] and not c["b.zip"].is_zip


def test_tables_and_listings(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n4,5\n6,7,8\n")
    (tmp_path / "u.csv").write_text("a,z\n1,2\n")
    assert tuple(files.short_rows(spark, str(tmp_path / "t.csv")).first())[1:] == (3, 1)
    assert files.select_index(spark, [str(tmp_path / n) for n in ("t.csv", "u.csv")], ["a", "b"]).endswith("t.csv")
    with pytest.raises(ValueError, match="2 files"):
        files.select_index(spark, [str(tmp_path / n) for n in ("t.csv", "u.csv")], ["a"])
    paths = ["/raw/A/x.xyz", "/raw/A_subsample/y.xyz", "/raw/B_subsample/z.xyz", "/raw/top.txt"]
    got = {tuple(r) for r in files.datasets(spark.createDataFrame([(p,) for p in paths], "path string"), "/raw").collect()}
    assert got == {("A", "", "/raw/A/x.xyz"), ("B", "_subsample", "/raw/B_subsample/z.xyz")}
    lines = ['{"x-optimade": {"meta": 1}}', '{"type": "structures", "id": "s1", "attributes": {"nsites": 1, "id_x": 2}}', '{"type": "structures", "attributes": {"elements": []}}', "{bad", ""]
    (tmp_path / "o.jsonl").write_text("\n".join(lines))
    s = files.jsonl_summary(spark, str(tmp_path / "o.jsonl")).first()
    assert (s.n_lines, s.header_present, s.n_ids, s.n_without_id, s.n_unparsed, s.truncated) == (4, True, 1, 1, 1, False)
    assert s.attribute_keys == ["elements", "id_x", "nsites"] and s.id_examples == ["s1"]
    assert files.jsonl_summary(spark, str(tmp_path / "o.jsonl"), 2).first().truncated
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "n.md").write_text("Forces and energies.\nThe trajectory.\n")
    (tmp_path / "d" / "c.yml").write_text("a: 1\nb:\n  - c: 2\n")
    (tmp_path / "d" / "t.csv").write_text("x,y\n1,2\n")
    k = {r.format: r for r in files.file_sketch(spark, str(tmp_path / "d")).collect()}
    assert k["text"].keywords == "trajectory;energy;force" and k["yaml"].keys == ["a", "b", "c"] and k["csv"].columns == ["x", "y"] and k["csv"].n_rows == 1
    (tmp_path / "conf.json").write_text(json.dumps({"data": "/raw", "out": "/raw/out"}))
    with pytest.raises(ValueError, match="lacks"):
        files.load_config(str(tmp_path / "conf.json"), ("seed",))
    with pytest.raises(ValueError, match="below"):
        files.load_config(str(tmp_path / "conf.json"), ("data",), ("out",), "/raw")
