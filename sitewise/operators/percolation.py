"""Percolation bottlenecks on periodic site graphs.

A material's hops connect sites, with a cell offset each. Adding hops by rising barrier, the bottleneck for dimension d
is the barrier at which some component first has d independent cycle vectors. Hops are merged in both directions by
expressions; a material's merged hops then go through a union-find that tracks offsets, one material at a time. A
material has at most sites^2 x 27 or so merged hops, whatever the number of stored rows, so no group is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.ids import edge_parts, plain_id
from sitewise.shared import ship

TIE = 1e-9
OUT = "material_id string, dimension int, status string, barrier double, hop string, n_tied int, n_physical_hops int, n_rows long"
ARROW = pa.schema([("material_id", pa.string()), ("dimension", pa.int32()), ("status", pa.string()), ("barrier", pa.float64()), ("hop", pa.string()), ("n_tied", pa.int32()), ("n_physical_hops", pa.int32()), ("n_rows", pa.int64())])


Vector = tuple[int, int, int]


def _widens(basis: list[Vector], v: Vector) -> bool:
    """Is v independent of at most two independent vectors?"""
    if not any(v):
        return False
    if not basis:
        return True
    (a, b, c), (x, y, z) = basis[0], v
    cross = (b * z - c * y, c * x - a * z, a * y - b * x)
    if len(basis) == 1:
        return any(cross)
    return len(basis) == 2 and sum(p * q for p, q in zip(cross, basis[1], strict=True)) != 0


class Sites:
    """Union-find over sites with the offset of each from its root, and a basis of each component's cycle vectors."""

    def __init__(self) -> None:
        self.up: dict[int, tuple[int, Vector]] = {}
        self.cycles: dict[int, list[Vector]] = {}

    def root(self, s: int) -> tuple[int, Vector]:
        if s not in self.up:
            self.up[s] = (s, (0, 0, 0))
        at, (x, y, z) = s, (0, 0, 0)
        while self.up[at][0] != at:
            at, (i, j, k) = self.up[at]
            x, y, z = x + i, y + j, z + k
        if at != s:
            self.up[s] = (at, (x, y, z))
        return at, (x, y, z)

    def _added(self, a: int, b: int, offset: Vector) -> tuple[int, int, Vector, list[Vector]]:
        """Both roots, the offset of b's root from a's, and the basis of the component that the edge makes."""
        (ra, p), (rb, q) = self.root(a), self.root(b)
        gap = tuple(u + o - v for u, o, v in zip(p, offset, q, strict=True))
        basis = list(self.cycles.get(ra, ()))
        for v in (gap,) if ra == rb else self.cycles.get(rb, ()):
            if len(basis) < 3 and _widens(basis, v):
                basis.append(v)
        return ra, rb, gap, basis

    def rank_with(self, a: int, b: int, offset: Vector) -> int:
        """The rank that join() would give, without joining."""
        return len(self._added(a, b, offset)[3])

    def join(self, a: int, b: int, offset: Vector) -> int:
        """Connect a with b in the cell at offset; the rank of the component's cycle vectors."""
        ra, rb, gap, basis = self._added(a, b, offset)
        if ra != rb:
            self.up[rb] = (ra, gap)
            self.cycles.pop(rb, None)
        self.cycles[ra] = basis
        return len(basis)


def bottlenecks(hops: list[tuple[float, int, int, Vector]], dimensions: tuple[int, ...]) -> dict[int, tuple[str, float | None, int | None, int]]:
    """dimension -> (status, barrier, index of the completing hop, tied hops) for merged hops in order of (barrier, key).

    Tied are the hops at the bottleneck barrier any one of which completes the network of the hops strictly below it.
    """
    net, out, todo = Sites(), {}, sorted(dimensions)
    for i, (em, s, t, o) in enumerate(hops):
        rank = net.join(s, t, o)
        while todo and rank >= todo[0]:
            d = todo.pop(0)
            below = Sites()
            for h in hops:
                if h[0] >= em - TIE:
                    break
                below.join(h[1], h[2], h[3])
            tied = 0
            for h in hops:
                if h[0] > em + TIE:
                    break
                tied += h[0] >= em - TIE and below.rank_with(h[1], h[2], h[3]) >= d
            out[d] = ("percolating", em, i, tied)
        if not todo:
            break
    return out | {d: ("no_percolating_network", None, None, 0) for d in todo}


def merged_hops(hops: DataFrame) -> DataFrame:
    """Per material and direction-free hop: lowest and highest barrier, stored rows, rows without a finite barrier."""
    e = edge_parts(plain_id(F.col("edge_id")))
    rows = hops.select(e.alias("e"), "em").where("e.oz is not null")
    s, t, x, y, z = (F.col(f"e.{c}") for c in ("source", "target", "ox", "oy", "oz"))
    back = F.struct(-x, -y, -z)
    turn = (s > t) | ((s == t) & (back > F.struct(x, y, z)))
    pick = lambda a, b: F.when(turn, b).otherwise(a)
    bad = F.col("em").isNull() | F.isnan("em") | (F.abs("em") == F.lit(float("inf")))
    return rows.select(F.col("e.material").alias("material_id"), pick(s, t).alias("s"), pick(t, s).alias("t"), pick(x, -x).alias("ox"), pick(y, -y).alias("oy"), pick(z, -z).alias("oz"), F.when(~bad, F.col("em")).alias("em"), bad.alias("bad")).groupBy("material_id", "s", "t", "ox", "oy", "oz").agg(F.min("em").alias("lo"), F.max("em").alias("hi"), F.count(F.lit(1)).alias("n_rows"), F.count_if("bad").alias("n_bad"))


def rate_limiting(hops: DataFrame, dimensions: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per material and dimension: status, bottleneck barrier, the hop that completes it and the number of ties.

    hops: edge_id, em. Status non_finite_barrier if any barrier is null, NaN or infinite, direction_conflict if a hop's
    barriers differ by more than TIE, else percolating or no_percolating_network. Ids that don't parse are left out.
    """
    ship(hops.sparkSession)
    if not set(dimensions) <= {1, 2, 3}:
        raise ValueError("dimensions are 1, 2 and 3")

    names = [c.split()[0] for c in OUT.split(", ")]

    def result(m: str, rows: list[tuple]) -> list[tuple]:
        n = sum(r[7] for r in rows)
        status = "non_finite_barrier" if any(r[8] for r in rows) else "direction_conflict" if any(r[6] - r[5] > TIE for r in rows if r[5] is not None) else None
        if status:
            return [(m, d, status, None, None, 0, len(rows), n) for d in dimensions]
        listed = sorted((r[5], r[0], r[1], (r[2], r[3], r[4])) for r in rows)
        found = bottlenecks(listed, dimensions)
        key = lambda i: None if i is None else "_".join(map(str, (listed[i][1], listed[i][2], *listed[i][3])))
        return [(m, d, found[d][0], found[d][1], key(found[d][2]), found[d][3], len(rows), n) for d in dimensions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, done = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("material_id", "s", "t", "ox", "oy", "oz", "lo", "hi", "n_rows", "n_bad")]
            for m, *r in zip(*cols, strict=True):
                if m != last and rows:
                    done += result(last, rows)
                    rows = []
                last = m
                rows.append(tuple(r))
            if len(done) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=ARROW)
                done = []
        if rows:
            done += result(last, rows)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=ARROW)

    return merged_hops(hops).repartition("material_id").sortWithinPartitions("material_id").mapInArrow(run, OUT)
