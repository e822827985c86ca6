"""Atomistic snapshots as bit sketches, and the exact test of two of them.

Positions count up to lattice vectors and up to the order of atoms. Exact copies (same atoms, order aside, same cell)
are one class; sketches, candidates and tests run on one representative for each class, and members are joined at the
end, so copies cost no candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.ids import source_of_file, split_of_file
from sitewise.shared import ship, written

CELL_TOLERANCE = 0.05
SLACK = 1e-9
SALTS, FEW_BUCKETS = 16, 10_000
CLASS_SCHEMA = "frame_key long, split string, source string, n int, comp long, cls binary, numbers array<int>, xyz array<double>, box array<double>"


def _ragged(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    return c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_rows(bins: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A hash of rows of three bins."""
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # any odd numbers
    with np.errstate(over="ignore"):
        return mixed((bins.astype(np.uint64) * odd).sum(1, dtype=np.uint64) + mixed(np.asarray(seed, np.uint64)))


class Frames:
    """The atoms of a batch, flat: z, x, the frame each belongs to; box and n by frame."""

    def __init__(self, z: np.ndarray, x: np.ndarray, box: np.ndarray, n: np.ndarray) -> None:
        self.z, self.x, self.box, self.n = z, x.reshape(-1, 3), box.reshape(-1, 3, 3), n
        self.of = np.repeat(np.arange(len(n)), n)
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.inverse = np.linalg.inv(self.box) if len(n) else self.box
        self.fraction = np.einsum("ai,aij->aj", self.x, self.inverse[self.of])

    @classmethod
    def of_batch(cls, b: pa.RecordBatch) -> Frames:
        (z, zo), (x, xo), (c, co) = (_ragged(b.column(k)) for k in ("numbers", "xyz", "box"))
        return cls(z[zo[0] : zo[-1]], x[xo[0] : xo[-1]], c[co[0] : co[-1]], np.diff(zo))

    def subset(self, pick: np.ndarray) -> Frames:
        """The frames at the places of pick, ascending."""
        chosen = np.zeros(len(self.n), bool)
        chosen[pick] = True
        atoms = chosen[self.of]
        return Frames(self.z[atoms], self.x[atoms], self.box[pick], self.n[pick])


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (z, zo), (x, xo), (c, co) = (_ragged(b.column(k)) for k in ("numbers", "xyz", "box"))
        n, nine = np.diff(zo), np.diff(co) == 9
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x[xo[0] : xo[-1]]))])  # running counts, so that empty frames count nothing
        ok = nine & (n > 0) & (np.diff(xo) == 3 * n) & (np.diff(bad[xo - xo[0]]) == 0)
        box = np.zeros((b.num_rows, 3, 3))
        if nine.any():
            box[nine] = c[np.concatenate([np.arange(i, i + 9) for i in co[:-1][nine]])].reshape(-1, 3, 3)
        ok &= np.isfinite(box).all((1, 2))
        ok[ok] = np.abs(np.linalg.det(box[ok])) > 1e-8
        rows = np.nonzero(ok)[0]
        n = n[rows]
        of, start = np.repeat(np.arange(len(rows)), n), np.concatenate([[0], np.cumsum(n)])
        atom = np.repeat(zo[:-1][rows] - start[:-1], n) + np.arange(start[-1])
        zs = z[atom].astype("<i4")
        xs = x[np.repeat(xo[:-1][rows] - 3 * start[:-1], 3 * n) + np.arange(3 * start[-1])].reshape(-1, 3) + 0.0
        order = np.lexsort((xs[:, 2], xs[:, 1], xs[:, 0], zs, of))
        zs, xs, cells = zs[order], np.ascontiguousarray(xs[order]), box[rows] + 0.0
        comp = [_hash64(zs[i:j].tobytes()) for i, j in zip(start[:-1], start[1:], strict=True)]
        cls = [hashlib.blake2b(zs[i:j].tobytes() + xs[i:j].tobytes() + k.tobytes(), digest_size=16).digest() for i, j, k in zip(start[:-1], start[1:], cells, strict=True)]
        kept = b.filter(pa.array(ok))
        yield pa.RecordBatch.from_arrays([kept.column("frame_key"), kept.column("split"), kept.column("source"), pa.array(n, pa.int32()), pa.array(comp, pa.int64()), pa.array(cls, pa.binary()), kept.column("numbers"), kept.column("xyz"), kept.column("box")], names=["frame_key", "split", "source", "n", "comp", "cls", "numbers", "xyz", "box"])


def readable(frames: DataFrame) -> DataFrame:
    """Frames with usable arrays, and the digest of their class; written once, as several steps read it.

    Left out: null arrays or entries, positions that aren't three finite numbers for each atom, no atoms, a cell that
    isn't three rows of three or has no volume. n_atoms is not looked at.
    """
    ship(frames.sparkSession)
    flat = frames.select("frame_key", split_of_file(F.col("source_file")).alias("split"), source_of_file(F.col("source_file")).alias("source"), "numbers", F.flatten("positions").alias("xyz"), F.flatten("cell").alias("box"), F.forall("positions", lambda r: F.size(r) == 3).alias("ok"))
    whole = flat.where("ok and numbers is not null and xyz is not null and box is not null").where(~F.exists("numbers", lambda v: v.isNull()) & ~F.exists("xyz", lambda v: v.isNull()) & ~F.exists("box", lambda v: v.isNull()))
    return written(whole.drop("ok").mapInArrow(_classify, CLASS_SCHEMA))


def representatives(rows: DataFrame, **more: Column) -> DataFrame:
    """One row for each class: the geometry of its frame with the smallest key, as `rep`, and aggregates over its members."""
    first = rows.groupBy("cls").agg(F.min("frame_key").alias("frame_key"), *(c.alias(n) for n, c in more.items()))
    return rows.select("frame_key", "cls", "n", "comp", "numbers", "xyz", "box").join(first, ["cls", "frame_key"]).withColumnRenamed("frame_key", "rep")


def with_level(rows: DataFrame, limits: list[float]) -> DataFrame:
    """rows(rep, bucket, ...) with `level`: the first of limits that the number of rows of its bucket is within.

    Only buckets above the first limit are joined: as a broadcast while there are at most FEW_BUCKETS of them, else by
    their hash, each spread over SALTS rows, so a bucket that a third of all frames share meets in no single task.
    """
    level = F.coalesce(*(F.when(F.col("load") <= x, i) for i, x in enumerate(limits)))
    heavy = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("load")).select("bucket", level.alias("level")).where("level > 0"))
    if heavy.count() <= FEW_BUCKETS:
        out = rows.join(F.broadcast(heavy), "bucket", "left")
    else:
        spread = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(spread, ["bucket", "salt"], "left").drop("salt")
    return out.withColumn("level", F.coalesce("level", F.lit(0)))


def near(za: np.ndarray, xa: np.ndarray, la: np.ndarray, zb: np.ndarray, xb: np.ndarray, tolerance: float) -> np.ndarray:
    """For each atom of a and of b: same number and at most tolerance apart, up to lattice vectors of a.

    A distance within the tolerance changes no fractional coordinate by 0.5 or more unless the cell is very thin, so
    rounding finds its image; for thin cells the neighbouring images are tried too.
    """
    f = (xb[None] - xa[:, None]) @ np.linalg.inv(la)
    base = (f - np.round(f)) @ la
    ok = (base**2).sum(-1) <= (tolerance + SLACK) ** 2
    lengths = np.abs(np.linalg.inv(la)).sum(0) * tolerance
    if (lengths >= 0.5).any():
        for s in np.ndindex(3, 3, 3):
            ok |= ((base + (np.array(s) - 1) @ la) ** 2).sum(-1) <= (tolerance + SLACK) ** 2
    return ok & (za[:, None] == zb[None])


def paired(ok: np.ndarray) -> int:
    """The largest number of one-to-one pairs."""
    rows, cols = ok.sum(1), ok.sum(0)
    if rows.max(initial=0) <= 1 and cols.max(initial=0) <= 1:
        return int(rows.sum())
    of = [-1] * ok.shape[1]
    for start in range(ok.shape[0]):
        trail, seen, came = [start], set(), {}
        end = -1
        while trail and end < 0:  # breadth first, without recursion
            a = trail.pop(0)
            for b in np.nonzero(ok[a])[0].tolist():
                if b in seen:
                    continue
                seen.add(b)
                came[b] = a
                if of[b] < 0:
                    end = b
                    break
                trail.append(of[b])
        while end >= 0:
            a = came[end]
            before = next((b for b, o in enumerate(of) if o == a), -1)
            of[end], end = a, before
    return sum(o >= 0 for o in of)


def same_cell(la: np.ndarray, lb: np.ndarray) -> bool:
    return bool((np.abs(la - lb) <= CELL_TOLERANCE + SLACK).all())


def _counts(z: list, x: list, box: list, first: int, tolerance: float) -> np.ndarray:
    """How many atoms pair, for frames stacked by size: z, x, box of both sides; lattice vectors of side `first`."""
    a, b = first, 1 - first
    inv = np.linalg.inv(box[a])
    d = x[b][:, None] - x[a][:, :, None]
    f = np.einsum("pijk,pkl->pijl", d, inv)
    base = np.einsum("pijk,pkl->pijl", f - np.round(f), box[a])
    ok = ((base**2).sum(-1) <= (tolerance + SLACK) ** 2) & (z[a][:, :, None] == z[b][:, None])
    thin = (np.abs(inv).sum(1) * tolerance >= 0.5).any(1)
    out = ok.sum((1, 2))
    for i in np.nonzero(thin | (ok.sum(1).max(1) > 1) | (ok.sum(2).max(1) > 1))[0]:  # more than one candidate for an atom
        out[i] = paired(near(z[a][i], x[a][i], box[a][i], z[b][i], x[b][i], tolerance))
    return out


def verify(tolerance: float, share: float | None):  # noqa: ANN201
    """mapInArrow function over candidate pairs with both geometries: the pairs that hold.

    share None asks that all atoms pair; else that 2m over the atoms of both is more than share. Lattice vectors are
    those of the frame with the smaller key, and members of a class may stand on either side, so both are told: `ab`
    with the lattice of a, `ba` with that of b. Pairs of equal sizes are tested together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            side = []
            for s in "ab":
                cols = [_ragged(t.column(f"{c}_{s}")) for c in ("numbers", "xyz", "box")]
                side.append((cols, np.diff(cols[0][1])))
            holds = np.zeros((2, t.num_rows), bool)
            at = lambda c, o, rows, n: c[o[:-1][rows][:, None] + np.arange(n)]
            box = [at(c, o, np.arange(t.num_rows), 9).reshape(-1, 3, 3) for (_, _, (c, o)), _ in side]
            close = (np.abs(box[0] - box[1]) <= CELL_TOLERANCE + SLACK).all((1, 2))
            sizes = np.stack([n for _, n in side], 1)
            for na, nb in np.unique(sizes[close], axis=0) if close.any() else []:
                every = np.nonzero(close & (sizes == (na, nb)).all(1))[0]
                step = max(1, 250_000 // max(1, int(na) * int(nb)))
                for rows in (every[i : i + step] for i in range(0, len(every), step)):
                    z = [at(v, o, rows, n) for ((v, o), _, _), n in zip((c for c, _ in side), (na, nb), strict=True)]
                    x = [at(v, o, rows, 3 * n).reshape(len(rows), n, 3) for (_, (v, o), _), n in zip((c for c, _ in side), (na, nb), strict=True)]
                    cells = [c[rows] for c in box]
                    for first in (0, 1):
                        other = (cells[0] != cells[1]).any((1, 2)) if first else np.ones(len(rows), bool)
                        held = holds[0, rows].copy()
                        if other.any():
                            m = _counts([v[other] for v in z], [v[other] for v in x], [v[other] for v in cells], first, tolerance)
                            held[other] = 2 * m == na + nb if share is None else 2 * m > share * (na + nb) + SLACK
                        holds[first, rows] = held
            out = pa.RecordBatch.from_arrays([t.column("cls_a"), t.column("cls_b"), pa.array(holds[0]), pa.array(holds[1])], names=["cls_a", "cls_b", "ab", "ba"])
            yield out.filter(pa.array(holds.any(0)))

    return run


def verified(candidates: DataFrame, reps: DataFrame, tolerance: float, share: float | None) -> DataFrame:
    """(cls_a, cls_b, ab, ba) of candidates(a, b) of representatives that hold."""
    side = lambda s: reps.select(F.col("rep").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "numbers", "xyz", "box")))
    both = candidates.join(side("a"), "a").join(side("b"), "b")
    return both.select(*(f"{c}_{s}" for s in "ab" for c in ("cls", "numbers", "xyz", "box"))).mapInArrow(verify(tolerance, share), "cls_a binary, cls_b binary, ab boolean, ba boolean")


def expand(pairs: DataFrame, rows: DataFrame, same_class: bool = True) -> DataFrame:
    """Pairs of frames (a, b, split_a, split_b, source_a, source_b), key a < key b, from pairs of classes and within classes."""
    one = lambda s: rows.select(F.col("cls").alias(f"cls_{s}"), F.col("frame_key").alias(f"k_{s}"), F.col("split").alias(f"split_{s}"), F.col("source").alias(f"source_{s}"))
    links = pairs.select("cls_a", "cls_b", "ab", "ba")
    if same_class:
        many = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        links = links.unionByName(many.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.lit(True).alias("ab"), F.lit(False).alias("ba")))
    out = links.join(one("a"), "cls_a").join(one("b"), "cls_b").where("(ab and k_a < k_b) or (ba and k_b < k_a)")
    turn = F.col("k_a") > F.col("k_b")
    pick = lambda c, x, y: F.when(turn, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}"))
    return out.select(pick("k", "a", "b").alias("a"), pick("k", "b", "a").alias("b"), *(pick(c, x, y).alias(f"{c}_{x}") for c in ("split", "source") for x, y in (("a", "b"), ("b", "a"))))
