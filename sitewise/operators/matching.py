"""Tolerance join of snapshots with the same atoms in the same order.

Rows of one block (material and species) are keyed by the bin of the first atom's fractional position, with all bins
that a match can reach on one side, so only rows that can match meet; the rest is tested exactly in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.shared import ship

BINS = 24


def _ragged(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    return c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (x, xo), (c, co) = _ragged(b.column("xyz")), _ragged(b.column("box"))
        atol, wide = b.column("atol").to_numpy(), b.column("wide").to_numpy(zero_copy_only=False)
        box, first = np.tile(np.eye(3), (b.num_rows, 1, 1)), np.zeros((b.num_rows, 3))
        ok = (np.diff(co) == 9) & (np.diff(xo) >= 3)
        at = np.nonzero(ok)[0]
        if len(at):
            box[at] = c[co[:-1][at][:, None] + np.arange(9)].reshape(-1, 3, 3)
            first[at] = x[xo[:-1][at][:, None] + np.arange(3)]
        thin = ~(np.abs(np.linalg.det(box)) > 1e-8)
        box[thin], first[thin], ok = np.eye(3), 0.0, ok & ~thin
        inverse = np.linalg.inv(box)
        f = np.einsum("ri,rij->rj", first, inverse) % 1.0
        # how far, in bins, the first atom may lie apart in a match: its own shift and that of up to three cell vectors
        reach = np.where(ok & wide, BINS * 4 * atol * np.sqrt((inverse**2).sum(1)).max(1) + 1e-9, 0.0)
        lo, hi = np.floor(f * BINS - reach[:, None]).astype(int), np.floor(f * BINS + reach[:, None]).astype(int)
        hi = np.minimum(hi, lo + BINS - 1)
        keys = [[((i % BINS) * BINS + j % BINS) * BINS + k % BINS for i in range(u[0], v[0] + 1) for j in range(u[1], v[1] + 1) for k in range(u[2], v[2] + 1)] for u, v in zip(lo.tolist(), hi.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.list_(pa.int32()))], names=["id", "keys"])


def tolerance_join(left: DataFrame, right: DataFrame, atol: float = 1e-4) -> DataFrame:
    """(left_id, right_id) of rows with equal material and numbers whose geometries match within atol.

    Both sides: id, material, numbers, positions, cell. Rows with null geometry or material match nothing.
    """
    ship(left.sparkSession)

    def flat(df: DataFrame, wide: bool) -> DataFrame:
        rows = df.where("material is not null and positions is not null and cell is not null and size(numbers) > 0 and size(positions) = size(numbers)")
        return rows.select("id", F.xxhash64("material", "numbers").alias("block"), "material", "numbers", F.flatten("positions").alias("xyz"), F.flatten("cell").alias("box"), F.lit(atol).alias("atol"), F.lit(wide).alias("wide"))

    a, b = flat(left, False), flat(right, True)
    keyed = lambda df, i: df.select("id", "xyz", "box", "atol", "wide").mapInArrow(_keys, "id long, keys array<int>").select("id", F.explode("keys").alias("key")).join(df.select("id", "block"), "id").select(F.col("id").alias(i), "block", "key")
    pairs = keyed(a, "left_id").join(keyed(b, "right_id"), ["block", "key"]).select("left_id", "right_id").distinct()
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.col("material").alias(f"{s}_m"), F.col("numbers").alias(f"{s}_n"), F.col("xyz").alias(f"{s}_x"), F.col("box").alias(f"{s}_c"))
    both = pairs.join(side(a, "left"), "left_id").join(side(b, "right"), "right_id").where("left_m = right_m and left_n = right_n")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            (xa, oa), (la, pa_), (xb, ob), (lb, pb) = (_ragged(t.column(c)) for c in ("left_x", "left_c", "right_x", "right_c"))
            size, keep = np.diff(oa), np.zeros(t.num_rows, bool)
            fit = (size == np.diff(ob)) & (np.diff(pa_) == 9) & (np.diff(pb) == 9)
            for n in np.unique(size[fit]):  # pairs of equal sizes are tested together
                rows = np.nonzero(fit & (size == n))[0]
                of = lambda v, o, m: v[o[:-1][rows][:, None] + np.arange(m)].reshape(len(rows), -1, 3)  # noqa: E731, B023
                a, b, cell, other = of(xa, oa, n), of(xb, ob, n), of(la, pa_, 9), of(lb, pb, 9)
                solid = np.abs(np.linalg.det(cell)) > 1e-8
                turned = np.where(solid[:, None, None], cell, np.eye(3))
                d = b - a
                d = d - np.where(solid[:, None, None], np.round(d @ np.linalg.inv(turned)) @ turned, 0.0)
                keep[rows] = (np.abs(cell - other) <= atol).all((1, 2)) & ((d**2).sum(2) <= atol * atol).all(1)
            yield pa.RecordBatch.from_arrays([t.column("left_id"), t.column("right_id")], names=["left_id", "right_id"]).filter(pa.array(keep))

    return both.select("left_id", "right_id", "left_x", "left_c", "right_x", "right_c").mapInArrow(test, "left_id long, right_id long")


def classified(frames: DataFrame, found: DataFrame) -> DataFrame:
    """Per frame of `frames` (id): mapping status from found (left_id, hop, right_id).

    unmapped without candidates, ambiguous with more than one hop, mapped_unique with one candidate, else mapped_hop_unique.
    """
    n = found.groupBy(F.col("left_id").alias("id")).agg(F.countDistinct("right_id").alias("n"), F.countDistinct("hop").alias("n_hops"), F.min("hop").alias("hop"))
    s = F.when(F.col("n").isNull(), "unmapped").when(F.col("n_hops") > 1, "ambiguous").when(F.col("n") == 1, "mapped_unique").otherwise("mapped_hop_unique")
    return frames.select("id").join(n, "id", "left").select("id", s.alias("status"), F.coalesce("n", F.lit(0)).alias("candidate_count"), F.when(F.col("n_hops") == 1, F.col("hop")).alias("hop"))
