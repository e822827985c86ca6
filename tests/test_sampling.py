import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise import shared
from sitewise.functions import hashing
from sitewise.operators import prefix, profile, sampling, statistics


def test_every_stratum_is_kept(spark):
    """1,500 strata, a null one among them: no system is lost, and test counts follow the sizes."""
    s = spark.range(5000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("system"), F.when(F.col("id") % 1500 > 0, (F.col("id") % 1500).cast("string")).alias("stratum"))
    got = sampling.grouped_partitions(s, 1, repeats=2)
    assert got.count() == 10_000 and got.select("system").distinct().count() == 5000
    assert {r["count"] for r in got.where("side = 'test'").groupBy("repeat").count().collect()} == {sampling.n_test(5000)}


def test_apportioned():
    assert sampling.apportioned({"a": 5, "b": 5, None: 1}, 4) == {"a": 2, "b": 2, None: 0}
    assert sampling.apportioned({}, 0) == {} and sum(sampling.apportioned({str(i): i + 1 for i in range(9)}, 17).values()) == 17


@pytest.mark.parametrize("salts", [1, 8])
def test_smallest_of_a_hot_group(spark, salts):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = sorted(map(tuple, sampling.smallest(df, ["g"], [F.col("v"), F.col("i")], 7, salts).collect()), key=str)
    want = [x for g in ("hot", "b", None) for x in sorted((y for y in rows if y[0] == g), key=lambda y: (y[1], y[2]))[:7]]
    assert got == sorted(want, key=str)


def test_quantiles_against_numpy(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.choice([None, float("nan"), round(r.random(), 1), r.random()])) for _ in range(500)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {x.g: (x.q, x.n) for x in prefix.quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set("abc")
    for g, (q, n) in got.items():
        v = [y for h, y in rows if h == g and y is not None and y == y]
        assert n == len(v) and np.allclose(q, np.quantile(v, probs))
    assert prefix.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0 and len(prefix.quantiles(df, [], "v", [0.5]).collect()) == 1


def test_runs_over_range_partitions(spark):
    r = random.Random(5)
    rows = [(p, i, r.choice([None, "x", "y"])) for p in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "p string, o int, v string").repartition(5)
    got = {x.p: x.n_runs for x in profile.runs(df, "p", "o", "v").collect()}
    for p in "ab":
        v = [x for q, _, x in rows if q == p]
        assert got[p] == 1 + sum(a != b for a, b in zip(v[:-1], v[1:], strict=True))


def test_bootstrap_in_blocks(spark):
    """Every draw has as many picks as clusters, whatever the blocks, and intervals are those of a plain bootstrap."""
    r = np.random.default_rng(2)
    x = r.normal(2, 1, 400)
    rows = [("m", f"c{i}", float(0.8 * v * v + 0.1 * w), float(v * v)) for i, (v, w) in enumerate(zip(x, r.normal(size=400), strict=True))]
    df = spark.createDataFrame(rows, "model string, c string, sxy double, sxx double")
    ones = df.select("model", "c", F.lit(1.0).alias("sxy"), F.lit(1.0).alias("sxx"))
    for block in (1000, 37):
        d = sampling.bootstrap_slopes(ones, ["model"], "c", 200, 7, block).collect()
        assert len(d) == 200 and all(y.slope == 1.0 for y in d)
        got = statistics.ratio_interval(sampling.bootstrap_slopes(df, ["model"], "c", 4000, 7, block), ["model"]).first()
        a = np.array([y[2:] for y in rows])
        plain = [(s := a[r.integers(0, 400, 400)].sum(0))[0] / s[1] for _ in range(4000)]
        assert np.allclose([got.lower, got.upper], np.quantile(plain, [0.025, 0.975]), atol=0.0015)


def test_bootstrap_counts_all_picks(spark):
    """Picks by block add up to the number of clusters, and each cluster is picked about once a draw."""
    df = spark.range(90).select(F.lit("m").alias("model"), F.col("id").alias("c"), F.when(F.col("id") == 5, 1.0).otherwise(0.0).alias("sxy"), F.lit(1.0).alias("sxx"))
    got = sampling.bootstrap_slopes(df, ["model"], "c", 3000, 1, 11).collect()
    picks = np.array([x.slope * 90 for x in got])
    assert np.allclose(picks, picks.round()) and abs(picks.mean() - 1) < 0.06 and abs(picks.var() - 1) < 0.12


def test_label_budget(spark):
    r = np.random.default_rng(3)
    rows = [(m, u, u[0], f"{u}{i}", s * float(v), float(v)) for u in ("a1", "a2", "b1", "small") for i, v in enumerate(r.uniform(1, 2, 8 if u == "small" else 80)) for m, s in (("even", 0.7), ("noisy", 0.7 + 0.3 * r.normal()))]
    rows = [x if x[0] == "even" else (*x[:4], x[4] + 0.4 * float(r.normal()), x[5]) for x in rows]
    rows = [x for x in rows if x != next(y for y in rows if y[0] == "noisy")] + [("gaps", *x[1:]) for x in rows if x[0] == "even" and x[3] != "a10"]
    df = spark.createDataFrame(rows, "model string, unit string, scope string, item string, sxy double, sxx double")
    got = {(x.model, x.k): x for x in sampling.label_budget(df, "unit", "scope", (1, 5, 30), 200).collect()}
    assert len(got) == 9 and got["even", 1].median_sd < 1e-9 and got["even", 1].plateau_k == 1 and got["even", 1].n_units == 3 and got["even", 1].n_scopes == 2
    assert got["gaps", 1].median_sd is None and not got["gaps", 5].complete and got["gaps", 5].plateau_k is None
    full = sampling.label_budget(df.where("model <> 'gaps' and item <> 'a10'"), "unit", "scope", (1, 5, 30), 300).where("model = 'noisy'").orderBy("k").collect()
    assert full[0].median_sd > full[1].median_sd > full[2].median_sd > 0 and full[0].complete
    # the corrected deviation is about s / sqrt(K) of single items
    assert abs(full[1].median_sd * np.sqrt(5) / full[0].median_sd - 1) < 0.25


def test_random_positions(spark):
    n = spark.createDataFrame([("a", 10), ("b", 3)], "u string, n long")
    got = sampling.random_positions(n, ["u"], [2, 5], 400, 1).toPandas()
    assert set(got[got.k == 5].u) == {"a"} and got.groupby(["u", "k", "draw"]).pos.nunique().eq(got.groupby(["u", "k", "draw"]).size()).all()
    assert abs(got[(got.u == "a") & (got.k == 2)].pos.mean() - 4.5) < 0.4 and got[got.u == "b"].pos.max() == 2


def test_null_parts_of_hashes_count(spark):
    df = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    one = df.select(hashing.rank_hex(F.col("x"), F.col("y"), F.col("z")), hashing.rank_hex(F.col("x"), F.col("z"))).first()
    assert one[0] != one[1]
    digests = df.select(hashing.row_digest(x=F.col("x"), y=F.col("y")), hashing.row_digest(x=F.col("x"))).first()
    assert digests[0] != digests[1]
    with pytest.raises(Exception, match="isn't finite"):
        df.select(hashing.row_digest(x=F.lit(float("nan")))).collect()


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        applicationId, master = "app-x", "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="must name a folder"):
        shared.shared_dir(Session())
    Context.master = "local-cluster[3,2,1000]"
    with pytest.raises(ValueError, match="must name a folder"):
        shared.shared_dir(Session())


def test_alignment(spark):
    ref = spark.createDataFrame([("f", [[1.0, 0.0, 0.0]] * 3), ("g", [[1.0, 0.0, 0.0]])], "frame_id string, forces array<array<double>>")
    pred = spark.createDataFrame([("m", "f", [[1.0, 0.0, 0.0]] * 2), ("m", "g", [[1.0, 0.0]] * 4), ("m", "h", [[0.0, 0.0, 0.0]])], "model string, frame_id string, forces array<array<double>>")
    assert tuple(statistics.alignment(ref, pred).first()) == ("m", 3, 1, 3, 1, 4, 4)


def test_digest_by_group(spark):
    import hashlib
    import json

    rows = [("a", f"e{i}") for i in range(300)] * 2 + [("b", 'q"uo\\te'), ("b", None), (None, "x"), ("c", "only")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.g: (r.digest, r.n_ids) for r in hashing.digest_by_group(spark.createDataFrame(rows, "g string, i string"), "g", "i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in "abc":
        ids = sorted({i for h, i in rows if h == g and i})
        assert got[g] == (hashlib.sha256(json.dumps(ids, separators=(",", ":")).encode()).hexdigest(), len(ids))
    assert set(got) == set("abc")
