"""Clusters of texts that are equal or nearly so: word shingles and a pigeonhole join of parity segments.

A text's tokens are its runs of SHINGLE words in lower case, each once. Two texts are near copies if the Jaccard
similarity of their token sets is at least SIMILARITY; then their sizes differ by no more than its inverse, and their
sets by no more than a ninth of both sizes. In the size band that both share, tokens go to segments by their hash,
more segments than the sets can differ in, so some segments are untouched; a segment's XOR of token hashes is its key,
and texts that agree in a key, and whose parity sketches allow it, are compared exactly. A single token may be a phrase that very many texts have, so segments
of less than two tokens make no key (but in sets that can differ in at most FEW tokens); for that there are a third
more segments than the bound asks for, so many are untouched and it takes a set of many near-empty ones to be missed.

Equal texts are one node (`same`, the hash of the text) and meet in no pairs. Clusters are the connected components
over near copies.

Defined cases: a null text has no row; a text of fewer words than a shingle has the one token of all its words, an
empty text has none and is in no pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.components import components
from sitewise.llm.frames import _ragged, mixed
from sitewise.shared import ship, written

SHINGLE, SIMILARITY = 5, 0.8
RATIO = 1 / SIMILARITY
MAX_BROADCAST, FEW, BITS = 200_000, 3, 512


def tokens_of(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) | (len(w) << 32) for w in words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + mixed(h[i : len(h) - k + 1 + i]))
    return np.unique(total)


def segment_keys(t: np.ndarray) -> np.ndarray:
    """Keys of the filled segments in the two bands of the set's size."""
    out = []
    low = int(np.floor(np.log(len(t)) / np.log(RATIO) + 1e-12)) if len(t) else 0
    for band in (low, low + 1) if len(t) else ():
        most = int(2 * RATIO ** (band + 1) * (1 - SIMILARITY) / (1 + SIMILARITY))  # by how much sets of this band can differ
        k, least = (most + 1 + max(1, most // 3), 1 if most <= FEW else 2) if most else (1, 1)
        slot = ((t >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
        sketch = np.zeros(k, np.uint64)
        np.bitwise_xor.at(sketch, slot, t)
        full = np.nonzero(np.bincount(slot, minlength=k) >= least)[0]
        with np.errstate(over="ignore"):
            out.append(mixed(sketch[full] + mixed(full.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(band))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same, texts = b.column("same").to_numpy(), b.column("text")
        for at in range(0, b.num_rows, 1000):
            keys = [segment_keys(tokens_of(t.as_py())) for t in texts[at : at + 1000]]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(same[at : at + 1000], [len(k) for k in keys]))], names=["key", "same"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, n, sketch, tokens): the set's size, its parity sketch of one bit for each token, and the set."""
    for b in batches:
        sets = [tokens_of(t.as_py()) for t in b.column("text")]
        sketches = [np.packbits(np.bincount((t & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64) for t in sets]
        of = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("same"), pa.array([len(t) for t in sets], pa.int32()), pa.array(sketches, of), pa.array([t.view(np.int64) for t in sets], of)], names=["same", "n", "sketch", "tokens"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (x, xo), (y, yo) = (_ragged(b.column(c)) for c in ("tokens_a", "tokens_b"))
        both = np.array([len(np.intersect1d(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], assume_unique=True)) for i in range(b.num_rows)], np.int64)
        whole = np.diff(xo) + np.diff(yo) - both
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(both >= SIMILARITY * whole - 1e-9))


def near_texts(documents: DataFrame) -> DataFrame:
    """(a, b), a < b: hashes of distinct texts that are near copies."""
    ship(documents.sparkSession)
    texts = documents.where("text is not null and text <> ''").select(F.xxhash64("text").alias("same"), "text")
    keys = texts.mapInArrow(_keys, "key long, same long").distinct()
    pairs = keys.withColumnRenamed("same", "a").join(keys.withColumnRenamed("same", "b"), "key").where("a < b").select("a", "b").distinct()
    pairs = written(pairs)
    ids = pairs.select(F.col("a").alias("same")).union(pairs.select(F.col("b").alias("same"))).distinct()
    sets = written(texts.join(ids, "same", "left_semi").groupBy("same").agg(F.min("text").alias("text")).mapInArrow(_sets, "same long, n int, sketch array<long>, tokens array<long>"))
    side = lambda s, *c: sets.select(F.col("same").alias(s), *(F.col(x).alias(f"{x}_{s}") for x in c))
    # the Hamming distance of parity sketches is never more than what the sets differ in
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    close = apart <= F.lit((1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9) * (F.col("n_a") + F.col("n_b"))
    within = F.least("n_a", "n_b") >= F.lit(SIMILARITY - 1e-9) * F.greatest("n_a", "n_b")
    near = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").where(within & close).select("a", "b")
    return near.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_alike, "a long, b long")


def clustered(counted: DataFrame, documents: DataFrame) -> DataFrame:
    """counted with `same` of near copies brought to one number, the smallest of their cluster."""
    found = written(components(written(near_texts(documents))).where("node <> component"))
    small = found.count() <= MAX_BROADCAST
    right = found.select(F.col("node").alias("_node"), F.col("component").alias("_cluster"))
    rows = counted.join(F.broadcast(right) if small else right, F.col("same") == F.col("_node"), "left")
    return rows.withColumn("same", F.coalesce("_cluster", "same")).drop("_node", "_cluster")
