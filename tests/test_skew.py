from pyspark.sql import functions as F

from sitewise.operators import skew


def test_skew_plan_balances(spark):
    rows = spark.range(20000).select(F.when(F.col("id") < 7000, "hot").when(F.col("id") < 9000, "warm").when(F.col("id") < 9100, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key"), "id")
    p = skew.plan(rows, "key", 8)
    assert max(p.loads) <= 1.25 * sum(p.loads) / 8 and p.total == 20000
    placed = skew.placed(skew.spread(rows, p, "key", F.col("id")), p).groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 8 and max(r["count"] for r in placed) <= 1.3 * 19900 / 8
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "key string, v int")
    both = skew.spread(rows, p, "key", F.col("id")).join(skew.replicate(dim, p, "key").withColumnRenamed("key", "dk"), "token").where("key = dk")
    assert both.where("key = 'hot'").count() == 7000 and both.where("key = 'k1'").count() == rows.where("key = 'k1'").count()


FRAMES = "entry_id long, source_file string, frame_index long, byte_length long, n_atoms int, material_id string, cell_volume double, scanned_at timestamp, token string, n long"
MEMBERS = "member_id long, edge_id string, kind string, step int, name string, n_bytes long, packed_at timestamp, em double"


def test_skewed_results(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "a.xyz", 0, 10, 2, "MP-1", 1.5, t(1), "", 0), (2, " A.xyz", 0, 30, 3, "mp-1", None, t(2), "", 0), (3, "a.xyz", 1, 5, None, "mp-1", float("nan"), t(1), "", 0), (4, "b.xyz", 0, 7, 1, None, 2.0, t(1), "", 0), (5, "b.xyz", 1, None, 1, "mp-2", 2.0, None, "", 0)]
    dim = spark.createDataFrame([("mp−1", "Li-O"), ("mp-1", "Fe-O"), ("mp-9", "x"), (None, "y")], "material_id string, chemsys string")
    got = {r.material_id: tuple(r)[1:] for r in skew.frames_by_material(spark.createDataFrame(rows, FRAMES), dim).collect()}
    assert got == {"mp-1": (3, 2, 3, 35, None, "Fe-O"), "mp-2": (1, 1, 1, None, 2.0, None)}
    empty = spark.createDataFrame([], FRAMES)
    assert skew.frames_by_material(empty, dim).count() == 0
    mem = spark.createDataFrame([(1, "E1", "source", None, "x", 1, t(1), 0.0), (2, "e1", "source", None, "X ", 4, t(3), 0.0), (3, "e1", "band_optim_step", 7, "s", None, t(1), 0.0), (4, None, "other", None, "o", 1, t(1), 0.0)], MEMBERS)
    bar = spark.createDataFrame([("e1", 0.5), ("e1", float("nan")), ("e1", 0.7), ("e2", 0.1)], "edge_id string, em double")
    r = skew.members_by_edge(mem, bar).collect()
    assert len(r) == 1 and (r[0].n_rows, r[0].n_members, r[0].n_source, r[0].n_band_optim_step, r[0].last_step, r[0].n_bytes, r[0].em) == (3, 2, 1, 1, 7, 4, 0.7)
