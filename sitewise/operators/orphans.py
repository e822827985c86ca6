"""References to records that do not exist: direct and inherited orphans over a foreign-key graph.

A parent row is there during [loaded_at, deleted_at) (without end where deleted_at is null). A child's reference
is a direct orphan if no parent row of that id was there when the child was loaded. It is an inherited orphan if
such rows were there but each of them is itself a row with an orphan reference; this is iterated to the fixpoint,
with semi-joins down the graph, never row by row.

"Was a parent there at time t" is a prefix maximum: among the parent rows of the id loaded up to t, the largest
end must lie after t. It is computed by day: within a day by a window over (id, day, salt), before it by a window over
one row for each (id, day). So a hot id is spread over its days. Where children of one id crowd in a day (a bulk load),
they are dealt to salts of about SALT_ROWS, and the day's parents are replicated to these salts only. All references of
the graph go through one such pass, and children and parents are normalised once.

Defined cases: a null or blank reference is no reference. A null time on either side matches nothing, so the child
is an orphan. A deletion before or at the loading makes an empty interval. Repeated rows count each by itself.
Empty tables give empty results; without parents every reference is an orphan. Other columns are carried along
nowhere, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.ids import plain_id
from sitewise.shared import forget, written

FOREVER = "9999-12-31 00:00:00"
SALT_ROWS, FEW_DAYS = 1_000_000, 10_000


@dataclass(frozen=True)
class Reference:
    """child.ref_column names parent.key_column."""

    child: str
    ref_column: str
    parent: str
    key_column: str


def _salts(children: DataFrame, salt_rows: int) -> DataFrame | None:
    """(ref, id, day, salts) of the days of an id with more children than salt_rows, if there are any; a broadcast while they are few."""
    if children.count() <= salt_rows:  # then no day can have more
        return None
    crowded = children.groupBy("ref", "id", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > salt_rows)
    crowded = written(crowded.select("ref", "id", "day", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")))
    n = crowded.count()
    return None if not n else F.broadcast(crowded) if n <= FEW_DAYS else crowded


def alive(children: DataFrame, parents: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """children(ref, child, id, t) with the column `there`: was a row of parents(ref, id, start, until) there at t?"""
    at = ["ref", "id", "day"]
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01")).alias("day")
    c = children.select("ref", "id", day("t"), "t", F.lit(None).cast("timestamp").alias("until"), F.lit(1).alias("kind"), "child")
    p = parents.where(F.col("id").isNotNull() & F.col("start").isNotNull() & (F.col("until") > F.col("start")))
    p = p.select("ref", "id", day("start"), F.col("start").alias("t"), "until", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("child"))
    salts, key = _salts(c, salt_rows), at
    if salts is None:
        both = p.unionByName(c).repartition(*at)  # one exchange for the window and for the days
        days = both
    else:
        key, days = [*at, "salt"], p.unionByName(c)
        dealt = c.join(salts, at, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("child"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
        # of a crowded day each loading time of an id is copied once
        lived = p.groupBy("ref", "id", "day", "t", "kind", "child").agg(F.max("until").alias("until"))
        both = lived.join(salts, at, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts").unionByName(dealt)
    days = days.groupBy(*at).agg(F.max("until").alias("last"))
    earlier = days.select(*at, F.max("last").over(Window.partitionBy("ref", "id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    w = Window.partitionBy(*key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("today", F.max("until").over(w)).where("kind = 1")
    joined = seen.join(earlier.where("earlier is not null"), at, "left")
    return joined.select("ref", "child", F.coalesce(F.greatest("today", "earlier") > F.col("t"), F.lit(False)).alias("there"))


def references(tables: dict[str, DataFrame], graph: list[Reference], row_id: str = "row_id", at: str = "loaded_at", deleted: str = "deleted_at", salt_rows: int = SALT_ROWS) -> DataFrame:
    """(child_table, ref_column, row_id, status): each reference that is a direct or an inherited orphan."""
    if not graph:
        raise ValueError("the foreign-key graph is empty")

    def parent_rows(i: int, r: Reference) -> DataFrame:
        df = tables[r.parent]
        forever = F.lit(FOREVER).cast("timestamp")
        until: Column = F.coalesce(F.col(deleted).cast("timestamp"), forever) if deleted in df.columns else forever
        return df.select(F.lit(i).alias("ref"), plain_id(F.col(r.key_column)).alias("id"), F.col(at).cast("timestamp").alias("start"), until.alias("until"), F.col(row_id).cast("long").alias("parent")).where("id is not null")

    def child_rows(i: int, r: Reference) -> DataFrame:
        return tables[r.child].select(F.lit(i).alias("ref"), F.col(row_id).cast("long").alias("child"), plain_id(F.col(r.ref_column)).alias("id"), F.col(at).cast("timestamp").alias("t")).where("id is not null")

    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    every = list(enumerate(graph))
    children, parents = written(union([child_rows(i, r) for i, r in every])), written(union([parent_rows(i, r) for i, r in every]))
    named = df_of_names(children, graph)

    def orphans(which: list[int], status: str, gone: DataFrame | None) -> DataFrame:
        c, p = (df if len(which) == len(graph) else df.where(F.col("ref").isin(which)) for df in (children, parents))
        if gone is not None:  # parents that are themselves orphans: by table and row, under every reference to the table
            below = union([gone.where(F.col("child_table") == graph[i].parent).select(F.lit(i).alias("ref"), F.col("row_id").alias("parent")) for i in which])
            p = p.join(below.distinct(), ["ref", "parent"], "left_anti")
        out = alive(c, p, salt_rows).where("not there").join(F.broadcast(named), "ref")  # a row for each reference of the graph
        return out.select("child_table", "ref_column", F.col("child").alias("row_id"), F.lit(status).alias("status"))

    known = written(orphans([i for i, _ in every], "direct", None))
    changed = {r.child for r in graph}
    while True:
        below = [i for i, r in every if r.parent in changed]  # only tables whose parents lost rows in the last round
        if not below:
            break
        found = orphans(below, "inherited", known).join(known.select("child_table", "ref_column", "row_id"), ["child_table", "ref_column", "row_id"], "left_anti")
        found = written(found)
        changed = {x[0] for x in found.select("child_table").distinct().collect()}  # at most one row for each table of the graph
        if not changed:
            break
        more = written(known.unionByName(found))
        forget(known), forget(found)
        known = more
    forget(children), forget(parents)
    return known


def df_of_names(like: DataFrame, graph: list[Reference]) -> DataFrame:
    return like.sparkSession.createDataFrame([(i, r.child, r.ref_column) for i, r in enumerate(graph)], "ref int, child_table string, ref_column string")


def direct_orphans(tables: dict[str, DataFrame], graph: list[Reference], **names: str) -> DataFrame:
    """The direct orphans alone: (child_table, ref_column, row_id)."""
    return references(tables, graph, **names).where("status = 'direct'").select("child_table", "ref_column", "row_id")


def by_period(orphans: DataFrame, tables: dict[str, DataFrame], graph: list[Reference], row_id: str = "row_id", at: str = "loaded_at") -> DataFrame:
    """Per child table, reference and month of loading: references, direct and inherited orphans."""
    out = None
    for r in graph:
        month = F.date_format(F.col(at), "yyyy-MM").alias("month")
        all_rows = tables[r.child].select(F.lit(r.child).alias("child_table"), F.lit(r.ref_column).alias("ref_column"), F.col(row_id).cast("long").alias("row_id"), month, plain_id(F.col(r.ref_column)).alias("ref")).where("ref is not null").drop("ref")
        out = all_rows if out is None else out.unionByName(all_rows)
    joined = out.join(orphans, ["child_table", "ref_column", "row_id"], "left")
    return joined.groupBy("child_table", "ref_column", "month").agg(F.count(F.lit(1)).alias("n_references"), F.count_if(F.col("status") == "direct").alias("n_direct"), F.count_if(F.col("status") == "inherited").alias("n_inherited"))
