"""Same or near-same records across splits.

Frames get a similarity-hash fingerprint: each bit is the sign of a sum over the atoms of a periodic random wave of
the fractional coordinates, with a phase for each atomic number, so neither the order of atoms nor lattice vectors
matter and small moves flip few bits. The fingerprint is cut into segments; records of different splits with the same
composition that agree in a segment's code block are candidates, those within the Hamming radius are tested exactly.
The evaluation side, the smaller one, also probes each segment with its least certain bits flipped.

Frames of one composition meet in a block by chance once in 2 ** block pairs, so blocks are wider, and more, for
compositions that many frames have (LEVELS); candidates then grow with the frames and not with their pairs.

Hops go the same way: a hop's fingerprint is the hash of its material and its direction-free sites and offset, a
single block with radius 0, compared once for each distinct hop of a side and tested on the text.

Only (key, id) is joined; fingerprints are fetched for the distinct candidates.

Defined cases: frames that readable() leaves out, and records without a split or with another one than train, val or
test, are in no pair. Repeated rows each count; exact copies are compared once and joined as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.ids import canonical_hop, edge_parts, plain_id, plain_split
from sitewise.llm.frames import Frames, mixed, readable, representatives, verified, with_level
from sitewise.shared import ship, written

TOLERANCE = 0.02


class Level(NamedTuple):
    """Fingerprints of frames whose composition occurs at most `load` times: bits of a block, number of blocks, and how
    many of a block's least certain bits are probed."""

    load: float
    block: int
    segments: int
    weak: int


LEVELS = (Level(50_000, 16, 20, 3), Level(5_000_000, 24, 32, 4), Level(float("inf"), 32, 48, 5))
#: Of all bits, how many may differ.
RADIUS = 0.3
WAVE, AT_ONCE = 10, 320
CHUNK = 8_000


def waves(bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The integer wave vectors (3 x bits) and the phases by atomic number (256 x bits)."""
    r = np.random.Generator(np.random.PCG64(seed))
    return r.integers(-WAVE, WAVE + 1, (3, bits)).astype(float), r.uniform(0, 2 * np.pi, (256, bits))


def sums(f: Frames, k: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """The sum of every wave over the atoms of every frame; its sign is the fingerprint's bit, its size how certain that is."""
    if not len(f.n):
        return np.zeros((0, k.shape[1]))
    inside, kind = f.fraction - np.floor(f.fraction), f.z & 255
    some = lambda c: np.add.reduceat(np.cos(2 * np.pi * (inside @ k[:, c]) + phase[:, c][kind]), f.start[:-1], axis=0)
    return np.concatenate([some(slice(i, i + AT_ONCE)) for i in range(0, k.shape[1], AT_ONCE)], axis=1)  # few waves at a time, to hold little


def words_of(s: np.ndarray) -> np.ndarray:
    """The fingerprints' bits in 64-bit words."""
    return np.packbits(s > 0, axis=1, bitorder="little").view("<i8")


def blocks(s: np.ndarray, comp: np.ndarray, level: Level, probes: bool) -> np.ndarray:
    """The keys of the code blocks of every frame; with probes, every block also with its least certain bits flipped."""
    size = s.reshape(len(s), level.segments, level.block)
    bit = np.uint64(1) << np.arange(level.block, dtype=np.uint64)
    codes = [np.where(size > 0, bit, np.uint64(0)).sum(2, dtype=np.uint64)]
    if probes:
        least = np.argsort(np.abs(size), axis=2, kind="stable")[:, :, : level.weak].astype(np.uint64)
        for i in range(level.weak):
            codes += [c ^ (np.uint64(1) << least[:, :, i]) for c in codes]
    with np.errstate(over="ignore"):
        place = mixed(comp.astype(np.uint64))[:, None] + (np.arange(level.segments, dtype=np.uint64) << np.uint64(8)) + np.uint64(level.block)
        return np.concatenate([mixed(mixed(place) + c) for c in codes], 1).view(np.int64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each frame: its level and words, the keys of its blocks, and if it is in an evaluation split its probes."""
    known = [waves(x.block * x.segments) for x in LEVELS]
    names = ["rep", "level", "words", "in_train", "keys", "probes"]
    for b in batches:
        rep, comp, levels = (b.column(c).to_numpy() for c in ("rep", "comp", "level"))
        in_train, in_other = (b.column(c).to_numpy(zero_copy_only=False) for c in ("in_train", "in_other"))
        whole = Frames.of_batch(b)
        steps = np.minimum(np.searchsorted(whole.start, np.arange(0, whole.start[-1] + CHUNK, CHUNK)), b.num_rows)
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            for no, level in enumerate(LEVELS):
                pick = np.nonzero(levels[lo:hi] == no)[0] + lo
                if not len(pick):
                    continue
                s = sums(whole.subset(pick), *known[no])
                keys, probed = blocks(s, comp[pick], level, False), np.nonzero(in_other[pick])[0]
                probes: list = [None] * len(pick)
                for i, row in zip(probed, blocks(s[probed], comp[pick[probed]], level, True), strict=True):
                    probes[i] = row
                columns = [pa.array(rep[pick]), pa.array(np.full(len(pick), no, np.int32)), pa.array(list(words_of(s)), pa.list_(pa.int64())), pa.array(in_train[pick]), pa.array(list(keys), pa.list_(pa.int64())), pa.array(probes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def block_pairs(train: DataFrame, other: DataFrame, words: DataFrame, radius: float) -> DataFrame:
    """(train_id, other_id), each once, of two tables (id, key) that are equal in a key and within the Hamming radius, a
    share of the bits of words(id, level, words)."""
    met = train.select(F.col("id").alias("train_id"), "key").join(other.select(F.col("id").alias("other_id"), "key"), "key").select("train_id", "other_id").distinct()
    side = lambda s: words.select(F.col("id").alias(f"{s}_id"), F.col("level").alias(f"{s}_level"), F.col("words").alias(f"{s}_words"))
    both = met.join(side("train"), "train_id").join(side("other"), "other_id").where("train_level = other_level")
    distance = F.aggregate(F.zip_with("train_words", "other_words", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    return both.where(distance <= F.lit(radius) * 64 * F.size("train_words")).select("train_id", "other_id").distinct()


def frame_overlaps(frames: DataFrame) -> DataFrame:
    """Pairs of frames, one in train and one in val or test, that hold the same atoms: a, b (a < b), splits and sources."""
    rows = readable(frames).where("split is not null")
    reps = written(representatives(rows, in_train=F.max(F.col("split") == "train"), in_other=F.max(F.col("split") != "train")))
    loads = with_level(reps.withColumn("bucket", F.col("comp")), [x.load for x in LEVELS])
    prints = loads.select("rep", "comp", "level", "in_train", "in_other", "numbers", "xyz", "box").mapInArrow(_fingerprint, "rep long, level int, words array<long>, in_train boolean, keys array<long>, probes array<long>")
    prints = written(prints).withColumnRenamed("rep", "id")
    pairs = block_pairs(prints.where("in_train").select("id", F.explode("keys").alias("key")), prints.select("id", F.explode("probes").alias("key")), prints.select("id", "level", "words"), RADIUS)
    pairs = pairs.where("train_id <> other_id").select(F.least("train_id", "other_id").alias("a"), F.greatest("train_id", "other_id").alias("b")).distinct()
    held = verified(pairs, reps, TOLERANCE, None)
    return expand_across(held, rows)


def expand_across(held: DataFrame, rows: DataFrame) -> DataFrame:
    """expand() for pairs across splits only: train members of a class meet the other side's val and test members."""
    train, other = rows.where("split = 'train'"), rows.where("split <> 'train'")
    side = lambda r, s: r.select(F.col("cls").alias(f"cls_{s}"), F.col("frame_key").alias(f"k_{s}"), F.col("split").alias(f"split_{s}"), F.col("source").alias(f"source_{s}"))
    links = held.select(F.col("cls_a").alias("cls_t"), F.col("cls_b").alias("cls_o"), F.col("ab").alias("t_first"), F.col("ba").alias("o_first"))
    links = links.unionByName(held.select(F.col("cls_b").alias("cls_t"), F.col("cls_a").alias("cls_o"), F.col("ba").alias("t_first"), F.col("ab").alias("o_first")))
    own = train.select("cls").distinct().join(other.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("cls_t"), F.col("cls").alias("cls_o"), F.lit(True).alias("t_first"), F.lit(True).alias("o_first"))
    out = links.unionByName(own).join(side(train, "t"), "cls_t").join(side(other, "o"), "cls_o").where("if(k_t < k_o, t_first, o_first)")
    return out.select("k_t", "k_o", "split_t", "split_o", "source_t", "source_o")


def hop_overlaps(hops: DataFrame) -> DataFrame:
    """Pairs of hop rows, one in train and one in val or test, with the same material, sites and offset in either direction."""
    e = edge_parts(plain_id(F.col("edge_id")))
    rows = hops.select("row_id", plain_id(F.col("material_id")).alias("m"), plain_split(F.col("_split")).alias("split"), e.alias("e"))
    rows = rows.select("row_id", "split", F.concat_ws("|", "m", canonical_hop(*(F.col(f"e.{c}") for c in ("source", "target", "ox", "oy", "oz")))).alias("text"), (F.col("m").isNotNull() & F.col("e.oz").isNotNull()).alias("whole"))
    rows = written(rows.where("whole and split in ('train', 'val', 'test')").select("row_id", "split", "text"))
    hop = rows.groupBy("text").agg(F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") != "train").alias("in_other"))
    hop = hop.select(F.col("text").alias("id"), F.xxhash64("text").alias("key"), "in_train", "in_other")
    met = block_pairs(hop.where("in_train"), hop.where("in_other"), hop.select("id", F.lit(0).alias("level"), F.array("key").alias("words")), 0.0)
    same = met.where("train_id = other_id").select(F.col("train_id").alias("text"))
    side = lambda s, only: rows.where(only).select("text", F.col("row_id").alias(f"k_{s}"), F.col("split").alias(f"split_{s}"))
    both = same.join(side("t", "split = 'train'"), "text").join(side("o", "split <> 'train'"), "text")
    return both.select("k_t", "k_o", "split_t", "split_o", F.lit("nebdft2k").alias("source_t"), F.lit("nebdft2k").alias("source_o"))


def overlaps(frames: DataFrame, hops: DataFrame) -> DataFrame:
    """(record_kind, k_t, k_o, split_t, split_o, source_t, source_o): every cross-split overlap of frames and of hops."""
    ship(frames.sparkSession)
    f = frame_overlaps(frames).withColumn("record_kind", F.lit("mplitrj_frame"))
    return f.unionByName(hop_overlaps(hops).withColumn("record_kind", F.lit("nebdft2k_hop")))


def by_split_and_source(pairs: DataFrame) -> DataFrame:
    """Per kind, evaluation split and source: overlapping pairs, and distinct records of the split and of train in them."""
    return pairs.groupBy("record_kind", F.col("split_o").alias("split"), F.col("source_o").alias("source")).agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("k_o").alias("n_records"), F.countDistinct("k_t").alias("n_train_records"))
