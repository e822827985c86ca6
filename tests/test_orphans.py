import datetime as dt
import random

import pytest

from sitewise.operators.orphans import Reference, by_period, direct_orphans, references

DAY = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
CHILD = "row_id long, material_id string, edge_id string, loaded_at timestamp, ref string, there boolean"
PARENT = "row_id long, material_id string, edge_id string, loaded_at timestamp, deleted_at timestamp, id string, day int"
GRAPH = [Reference("c", "edge_id", "p", "edge_id"), Reference("p", "material_id", "g", "material_id")]


def test_direct_and_inherited(spark):
    g = spark.createDataFrame([(1, "mp-1", None, DAY(0), DAY(10), "x", 1)], PARENT)
    p = spark.createDataFrame([(1, " MP−1 ", "e1", DAY(1), None, None, 0), (2, "mp-2", "e2", DAY(1), None, None, 0), (3, None, "e3", DAY(1), None, None, 0), (4, "mp-1", "e4", DAY(10), None, None, 0)], PARENT)
    c = spark.createDataFrame([(1, None, "E1", DAY(1), "a", True), (2, None, "e1", DAY(0), "a", True), (3, None, "e2", DAY(2), "a", True), (4, None, None, DAY(2), "a", True), (5, None, "", DAY(2), "a", True), (6, None, "e4", DAY(12), "a", True), (7, None, "e1", None, "a", True), (8, None, "e3", DAY(3), "a", True)], CHILD)
    got = {tuple(r) for r in references({"c": c, "p": p, "g": g}, GRAPH).collect()}
    assert got == {
        ("p", "material_id", 2, "direct"),
        ("p", "material_id", 4, "direct"),  # the pool's row is deleted at that very time
        ("c", "edge_id", 2, "direct"),
        ("c", "edge_id", 7, "direct"),
        ("c", "edge_id", 3, "inherited"),
        ("c", "edge_id", 6, "inherited"),
    }
    per = {(r.child_table, r.month): (r.n_references, r.n_direct, r.n_inherited) for r in by_period(references({"c": c, "p": p, "g": g}, GRAPH), {"c": c, "p": p, "g": g}, GRAPH).collect()}
    assert per[("c", "2024-01")] == (5, 1, 2) and per[("c", None)] == (1, 1, 0)


def test_empty_tables(spark):
    empty, none = spark.createDataFrame([], PARENT), spark.createDataFrame([], CHILD)
    p = spark.createDataFrame([(1, "mp-1", "e1", DAY(1), None, None, 0)], PARENT)
    assert references({"c": none, "p": empty, "g": empty}, GRAPH).count() == 0
    assert [tuple(r) for r in direct_orphans({"c": none, "p": p, "g": empty}, GRAPH).collect()] == [("p", "material_id", 1)]


@pytest.mark.parametrize("salt_rows", [1, 7, 1_000_000])
def test_against_brute_force(spark, salt_rows):
    """Days of an id dealt to many salts, to some, and to one give the same."""
    r = random.Random(5)
    parents = [(i, None, f"e{r.randrange(12)}", (s := DAY(r.randrange(6), r.randrange(24))), r.choice([None, None, s + dt.timedelta(hours=r.randrange(-5, 60))]), None, 0) for i in range(150)]
    children = [(i, None, f"e{r.randrange(14)}", DAY(r.randrange(7), r.randrange(24)), None, None) for i in range(200)]
    got = {x.row_id for x in direct_orphans({"c": spark.createDataFrame(children, CHILD), "p": spark.createDataFrame(parents, PARENT)}, GRAPH[:1], salt_rows=salt_rows).collect()}
    assert got == {c[0] for c in children if not any(p[2] == c[2] and p[3] <= c[3] and (p[4] is None or p[4] > c[3]) for p in parents)}
