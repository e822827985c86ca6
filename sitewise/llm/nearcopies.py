"""Near-duplicate records with small edits: a parity-sketch join.

An atom is a token: its number and its bin in a grid. Every token flips bits of a sketch by XOR, so tokens that both
records have cancel out and the Hamming distance of two sketches is never more than the symmetric difference of the
token sets. The join goes in three steps.

1. Pigeonhole. The sketch of a grid is cut into segments, as many as the size band needs for few tokens in each, and
   records of one band that agree in a segment are candidates: a pair with few edits leaves some segments untouched.
   A segment is compared at the width of whole token hashes (their XOR, a 64-bit digest of its bits), so differing
   segments practically never look equal. A token's segment is set by the coarse bin around its bin, so an atom that
   crosses a bin's edge changes one segment and not two.
2. Distance. A second sketch has one bit for each token (coarse bins of the cell, 64 * WORDS bits). Bits that differ
   and that no move within the tolerance explains stand for an atom without a partner, so their count is a proven
   lower bound of the edits; pairs beyond what the share allows are dropped. Pairs of differing cells are kept.
3. Test. The rest is tested exactly.

Moved atoms cross edges, so there are several grids with shifted edges and one equal segment in any of them makes a
candidate; how many pairs at the very edge of tolerance and share that finds is measured (README, tests). Coordinates
are taken in angstrom after reduction by the record's own cell, so a cell within the tolerance moves no atom that was
not wrapped.

Frames of one material that vibrate about the same sites agree in short segments by chance, more of them the more
frames there are. So the width of segments follows the load: frames are counted by the cell they have (to 1 Å in each
component, with a second bin where a component is so near an edge that a cell within the tolerance may fall beyond),
and LEVELS says how fine the grids, how long the segments and how many the grids are for a load. A frame makes keys
for the levels of all its bins, so both frames of any pair have a level in common.

Defined cases: frames that readable() leaves out are in no pair. Exact copies are one class and cost no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.components import components
from sitewise.llm.frames import CELL_TOLERANCE, Frames, _ragged, expand, hash_rows, mixed, readable, representatives, verified, with_level
from sitewise.shared import ship, written

TOLERANCE, SHARE = 0.05, 0.78
#: Of two sizes in a pair at most: 2 min / (min + max) > SHARE.
RATIO = (2 - SHARE) / SHARE


class Level(NamedTuple):
    """Sketches of frames whose cell occurs at most `load` times: the grids' width in angstrom, coarse bins of 2 **
    coarse bins, tokens in a segment on average, the fewest that make a key, and how many segments all grids of a band
    have together."""

    load: float
    width: float
    coarse: int
    per_segment: float
    least: int
    segments: int


LEVELS = (Level(2_000, 0.45, 2, 2.5, 2, 72), Level(24_000, 0.35, 2, 3.5, 3, 288), Level(500_000, 0.25, 3, 4.0, 3, 1_000), Level(float("inf"), 0.25, 3, 5.0, 4, 3_000))
FEWEST_GRIDS = 10
CELL_STEP = 1.0
#: Of the distance sketch: bins on each axis, and 64-bit words.
COARSE, WORDS = 24, 4
CHUNK = 40_000


def bands(n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The two bands that n atoms belong to; sizes within RATIO of each other share one."""
    b = np.floor(np.log(n) / np.log(RATIO) + 1e-12).astype(np.int64)
    return b, b + 1


def segments_of(band: int, level: Level) -> tuple[int, int]:
    """Segments of a band's sketch, about per_segment tokens each, and how many grids the band has."""
    k = max(2, round(RATIO**band / level.per_segment))
    return k, max(FEWEST_GRIDS, -(-level.segments // k))


def segment_keys(f: Frames, level_no: int) -> tuple[np.ndarray, np.ndarray]:
    """(frame, key) of all segments with tokens enough, of all grids of a level and in both bands."""
    level, low, out = LEVELS[level_no], bands(f.n)[0], []
    for band in np.unique(low):
        pick = np.nonzero(low == band)[0]
        part = f if len(pick) == len(f.n) else f.subset(pick)
        sizes = [(b, *segments_of(b, level), 1 if RATIO**b <= 2 * level.least else level.least) for b in (int(band), int(band) + 1)]
        for grid in range(max(x[2] for x in sizes)):
            draw = np.random.Generator(np.random.PCG64([level_no, grid]))
            at, shift = draw.random(3), draw.random(3) * level.width * 2**level.coarse
            inside = part.x - np.einsum("ai,aij->aj", np.floor(part.fraction + at), part.box[part.of])
            bins = np.floor((inside + shift) / level.width).astype(np.int64)
            token = hash_rows(bins, part.z.astype(np.uint64) + (np.uint64(grid + 1) << np.uint64(32)))
            region = hash_rows(bins >> level.coarse, grid + 1) >> np.uint64(33)
            for b, k, grids, least in sizes:  # bands of few atoms have fewer segments in a grid, and more grids
                if grid >= grids:
                    continue
                slot = part.of * k + (region % np.uint64(k)).astype(np.int64)
                sketch = np.zeros(len(pick) * k, np.uint64)
                np.bitwise_xor.at(sketch, slot, token)
                full = np.nonzero(np.bincount(slot, minlength=len(sketch)) >= least)[0]
                with np.errstate(over="ignore"):
                    place = ((full % k).astype(np.uint64) << np.uint64(32)) + np.uint64((grid << 16) + (b << 4) + level_no)
                    out.append((pick[full // k], mixed(sketch[full] + mixed(place))))
    of, key = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
    return of, key.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rep, flags = b.column("rep").to_numpy(), b.column("levels").to_numpy()
        whole = Frames.of_batch(b)
        steps = np.minimum(np.searchsorted(whole.start, np.arange(0, whole.start[-1] + CHUNK, CHUNK)), b.num_rows)
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            for no in range(len(LEVELS)):
                pick = np.nonzero(flags[lo:hi] >> no & 1)[0] + lo
                of, key = segment_keys(whole.subset(pick), no) if len(pick) else (pick, pick)
                for s in range(0, len(key), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(key[s : s + (1 << 20)]), pa.array(rep[pick[of[s : s + (1 << 20)]]])], names=["key", "rep"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, bucket): every bin of the cell's nine components that a cell within the tolerance may share."""
    for b in batches:
        c, co = _ragged(b.column("box"))
        box = c[co[0] : co[-1]].reshape(-1, 9) / CELL_STEP + 0.37  # shifted, as components are often whole or zero
        reach = (CELL_TOLERANCE / 2 + 1e-6) / CELL_STEP  # two cells within the tolerance meet half way
        lo, hi = np.floor(box - reach).astype(np.int64), np.floor(box + reach).astype(np.int64)
        of, bins = np.arange(len(box)), lo.copy()
        for axis in range(9):
            two = np.nonzero(lo[of, axis] != hi[of, axis])[0]
            more = bins[two]
            more[:, axis] = hi[of[two], axis]
            of, bins = np.concatenate([of, of[two]]), np.concatenate([bins, more])
        cell = hash_rows(np.stack([hash_rows(bins[:, i : i + 3], i) for i in (0, 3, 6)], 1), 9)
        yield pa.RecordBatch.from_arrays([pa.array(b.column("rep").to_numpy()[of]), pa.array(cell.view(np.int64))], names=["rep", "bucket"])


def levels(reps: DataFrame) -> DataFrame:
    """(rep, levels): a bit for each level at which the frame makes keys, from how many frames have its cells."""
    rows = with_level(written(reps.select("rep", "box").mapInArrow(_cells, "rep long, bucket long")), [x.load for x in LEVELS])
    return rows.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1, level)")).alias("levels"))


def bitmaps(z: np.ndarray, x: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sketches() of one frame."""
    own, wide = sketches(Frames(z, x, box, np.array([len(z)])))
    return own[0], wide[0]


def sketches(f: Frames) -> tuple[np.ndarray, np.ndarray]:
    """By frame: the parity sketch of the atoms' own bins, and the bits of all bins that an atom within the tolerance of
    them in the same cell may be in."""
    reach = ((TOLERANCE + 1e-6) * np.sqrt((f.inverse**2).sum(1)) + 1e-9)[f.of]
    edge = [np.floor((f.fraction + r) * COARSE).astype(np.int64) % COARSE for r in (-reach, 0.0, reach)]

    def bit(bins: np.ndarray) -> np.ndarray:
        return ((hash_rows(bins, f.z.astype(np.uint64)) >> np.uint64(33)) % np.uint64(64 * WORDS)).astype(np.int64)

    m, size = len(f.n), 64 * WORDS
    own = (np.bincount(f.of * size + bit(edge[1]), minlength=m * size) & 1).astype(np.uint8).reshape(m, size)
    wide = np.zeros((m, size), np.uint8)
    for x in np.ndindex(3, 3, 3):
        wide[f.of, bit(np.stack([edge[x[i]][:, i] for i in range(3)], 1))] = 1
    thin = np.zeros(m, bool)
    np.logical_or.at(thin, f.of, (reach * COARSE >= 1).any(1))
    own[thin], wide[thin] = 0, 1  # a thin cell: anything may be near
    return np.packbits(own, axis=1).view(np.int64), np.packbits(wide, axis=1).view(np.int64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, wide = sketches(Frames.of_batch(b))
        columns = [pa.array(np.ascontiguousarray(w[:, i])) for w in (own, wide) for i in range(WORDS)]
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), b.column("cell"), *columns], names=["rep", "n", "cell", *(f"{w}{i}" for w in "od" for i in range(WORDS))])


def within_bound(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs(a, b) without those of one and the same cell that can't reach the share: the Hamming distance of their
    parity sketches, without the bits that a move within the tolerance explains, stands for atoms without a partner.
    """
    columns = ", ".join(f"{w}{i} long" for w in "od" for i in range(WORDS))
    marks = written(reps.select("rep", "n", F.xxhash64("box").alias("cell"), "numbers", "xyz", "box").mapInArrow(_bitmaps, f"rep long, n int, cell long, {columns}"))
    side = lambda s: marks.select(*(F.col(c).alias(s if c == "rep" else f"{c}_{s}") for c in marks.columns))
    lone = lambda s, t: sum((F.bit_count(F.col(f"o{i}_{s}").bitwiseXOR(F.col(f"o{i}_{t}")).bitwiseAND(F.col(f"o{i}_{s}")).bitwiseAND(F.bitwise_not(f"d{i}_{t}"))) for i in range(WORDS)), F.lit(0))
    reaches = lambda s, t: 2 * (F.col(f"n_{s}") - lone(s, t)) >= F.lit(SHARE) * (F.col("n_a") + F.col("n_b")) - 1e-6
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where((F.col("cell_a") != F.col("cell_b")) | (reaches("a", "b") & reaches("b", "a"))).select("a", "b")


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b), a < b, each once: representatives that agree in a segment of a sketch."""
    rows = reps.select("rep", "numbers", "xyz", "box").join(levels(reps), "rep")
    keys = rows.mapInArrow(_sketch, "key long, rep long")
    return keys.withColumnRenamed("rep", "a").join(keys.withColumnRenamed("rep", "b"), "key").where("a < b").select("a", "b").distinct()


def class_pairs(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(cls_a, cls_b, ab, ba): pairs of classes that share enough atoms."""
    return verified(within_bound(candidates(reps), reps), reps, TOLERANCE, SHARE)


def near_pairs(frames: DataFrame) -> DataFrame:
    """(a, b): frame keys, a < b, of every pair above the share, judged directly."""
    ship(frames.sparkSession)
    rows = readable(frames)
    reps = written(representatives(rows))
    return expand(class_pairs(rows, reps), rows)


def near_groups(frames: DataFrame) -> DataFrame:
    """One row for each readable frame: frame_key, group_id (smallest frame of its group), n_links to other frames, group_size.

    Groups are the components over pairs; copies are linked to each other and to all that their class is linked to.
    """
    ship(frames.sparkSession)
    rows = readable(frames)
    reps = written(representatives(rows))
    held = written(class_pairs(rows, reps))
    size = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("m"))
    ids = reps.select("cls", "rep")
    links = held.join(ids.select(F.col("cls").alias("cls_a"), F.col("rep").alias("a")), "cls_a").join(ids.select(F.col("cls").alias("cls_b"), F.col("rep").alias("b")), "cls_b")
    found = components(links.select("a", "b"))
    both = held.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(held.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    n = both.join(size.select(F.col("cls").alias("other"), "m"), "other").groupBy("cls").agg(F.sum("m").alias("n_others"))
    classes = ids.join(found, F.col("rep") == F.col("node"), "left").join(size, "cls").join(n, "cls", "left")
    classes = written(classes.select("cls", F.coalesce("component", "rep").alias("group_id"), (F.col("m") - 1 + F.coalesce("n_others", F.lit(0))).alias("n_links"), "m"))
    sizes = classes.groupBy("group_id").agg(F.sum("m").alias("group_size"))
    return rows.select("frame_key", "cls").join(classes.drop("m"), "cls").join(sizes, "group_id").select("frame_key", "group_id", "n_links", "group_size")
