"""Connected components by parallel hooking and shortcutting over parent arrays in joined tables, and group splits.

Every node has a parent, at first the smallest node of its neighbourhood. A round hooks the root of a larger
neighbour tree onto the smallest root seen over the edges, then shortcuts parents to their parents. Edges are
rewritten to roots, and those inside one tree are dropped, so the edge table shrinks from round to round; the number
of rounds grows as the logarithm of the longest path. Parents and edges are tables in the shared folder.

Defined cases: null ends and self-loops connect nothing (a self-loop still names its node), repeated edges count
once, an empty edge table gives no node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.shared import forget, written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges(a, b) of one orderable type; component is the smallest node of the component."""
    whole = edges.where("a is not null and b is not null").select("a", "b")
    nodes = whole.select(F.col("a").alias("node")).union(whole.select(F.col("b").alias("node")))
    links = written(whole.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parents = None
    for _ in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        # hook: every node with a smaller neighbour takes the smallest one as parent, the others stay roots
        hooks = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        hooks = written(hooks)
        # shortcut until the parents of this round are roots: parent chains only go down
        while True:
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = hooks.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
            jumped = written(jumped)
            moved = jumped.where("moved").limit(1).count()
            forget(hooks)
            hooks = jumped
            if not moved:
                break
        hooks_only = hooks.select("node", "parent")
        if parents is None:
            new_parents = hooks_only
        else:  # nodes found earlier follow their root; roots hooked now are added
            moved_on = parents.join(hooks_only.select(F.col("node").alias("parent"), F.col("parent").alias("root")), "parent", "left")
            new_parents = moved_on.select("node", F.coalesce("root", "parent").alias("parent")).unionByName(hooks_only)
        new_parents = written(new_parents)
        root = lambda side: hooks_only.select(F.col("node").alias(side), F.col("parent").alias(f"r{side}"))
        rewritten = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        rewritten = written(rewritten.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        for old in (links, hooks, *([parents] if parents is not None else [])):
            forget(old)
        links, parents = rewritten, new_parents
    else:
        raise RuntimeError("the components did not settle")
    nodes = nodes.distinct()
    if parents is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(parents, "node", "left").select("node", F.coalesce("parent", "node").alias("component"))


def running_total(df: DataFrame, group: list[str], key: str, weight: str, total: str, buckets: int = 4096, tie: str | None = None) -> DataFrame:
    """df with `total`: the sum of weight over the rows of the group up to the row, by key ascending (a hash as LONG), equal keys by tie.

    A distributed prefix sum: the key's range is cut into equal buckets, their sums are added up by a window over at
    most `buckets` rows a group, and rows are added up within (group, bucket). No group meets in one task.
    """
    cut = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(2**63))), 64 - (buckets - 1).bit_length()).cast("int")
    rows = df.withColumn("_bucket", cut)
    sums = rows.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    names = [*group, "_bucket"]
    right = before.select(*(F.col(c).alias(f"_r_{c}") for c in names), "_before")
    same = None
    for c in names:
        eq = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        same = eq if same is None else same & eq
    w = Window.partitionBy(*names).orderBy(key, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_inner", F.sum(weight).over(w))
    return inner.join(right, same).withColumn(total, F.col("_inner") + F.col("_before")).drop("_inner", "_before", "_bucket", *(f"_r_{c}" for c in names))
