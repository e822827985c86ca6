"""Filling containers of fixed capacity with whole texts: conflict-constrained best fit.

A text longer than the capacity is cut into full pieces and a rest; nothing else is divided. Pieces are dealt by hash
to shards of bounded size, and each shard is packed by itself, longest first: open containers are kept by the space
they have left, and the search goes up from the tightest fit to the first compatible one. Containers carry bitmaps
of the sources and of the clusters of equal texts they hold. Two texts of a cluster, or of sources that are declared
to conflict, don't go together while that costs no space: a container is opened for a conflict only while the shard
has fewer than its tokens need at least; after that the tightest fit is taken, marked `relaxed`. Declared source
conflicts are never relaxed.

A shard holds SHARD_TOKENS tokens or SHARD_CONTAINERS containers, whichever is more, and leaves about one part-filled;
so the unused share doesn't grow with the data, nor with the capacity. A shard's rows grow with the capacity, as all
that goes into a container must meet somewhere.

Defined cases: a null text is not packed; an empty text takes no space and is put into a container all the same; a
capacity that is null or below 1 is an error; repeated documents are packed each, told apart by `row`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.shared import ship

SHARD_TOKENS, SHARD_CONTAINERS, SHARD_ITEMS = 1_000_000, 64, 40_000
OUT = "spec_id int, container_id string, doc_id long, row long, piece int, first_token long, n_tokens long, relaxed boolean"


def pack(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, conflicts: dict[int, int] | None = None) -> tuple[list[int], list[bool]]:
    """(container of each item, relaxed?) by best fit, longest first. clusters: -1 for none. conflicts: source -> bitmap of sources it must not meet."""
    conflicts = conflicts or {}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    needed = -(-sum(sizes) // capacity)
    by_left: dict[int, dict[int, None]] = {}  # space left -> containers in order of arrival
    filled = 0  # bitmap of the spaces left that occur
    left, has_cluster, has_source = [], [], []
    place, relaxed = [0] * len(sizes), [False] * len(sizes)

    def candidates(size: int):  # noqa: ANN202
        mask = filled >> size << size
        while mask:
            low = mask & -mask
            yield from by_left[low.bit_length() - 1]
            mask ^= low

    for i in order:
        size, cluster, source = sizes[i], clusters[i], sources[i]
        cbit, sbit, avoid = (1 << cluster if cluster >= 0 else 0), 1 << source, conflicts.get(source, 0)
        best, fallback = -1, -1
        for b in candidates(size):
            if has_source[b] & avoid:
                continue
            if not has_cluster[b] & cbit:
                best = b
                break
            if fallback < 0:
                fallback = b
        if best < 0 and fallback >= 0 and len(left) >= needed:
            best, relaxed[i] = fallback, True
        if best < 0:
            best = len(left)
            left.append(capacity)
            has_cluster.append(0)
            has_source.append(0)
        else:
            here = by_left[left[best]]
            del here[best]
            if not here:
                filled ^= 1 << left[best]
        left[best] -= size
        by_left.setdefault(left[best], {})[best] = None
        filled |= 1 << left[best]
        has_cluster[best] |= cbit
        has_source[best] |= sbit
        place[i] = best
    return place, relaxed


def shards_of(tokens: int, items: int, capacity: int) -> int:
    """How many shards: as many as the tokens fill and, unless the capacity needs larger ones, as keep items few."""
    return max(1, min(round(tokens / (SHARD_CONTAINERS * capacity)), max(round(tokens / SHARD_TOKENS), round(items / SHARD_ITEMS))))


def fill(counted: DataFrame, specs: DataFrame, conflicting_sources: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each piece of each text and spec: its container. counted: doc_id, source, same, n_tokens, row.

    container_id is 'd<row>-<k>' for a full piece, which is a container by itself, else '<shard>-<number>'.
    """
    ship(counted.sparkSession)
    few = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct().limit(1001).collect()
    if len(few) > 1000 or any(r["capacity"] is None or r["capacity"] < 1 for r in few):
        raise ValueError("specs must be at most 1000 capacities of at least 1")
    loads = counted.agg(*(F.coalesce(F.sum(F.col("n_tokens") % r["capacity"]), F.lit(0)).alias(f"t{i}") for i, r in enumerate(few)), F.count(F.lit(1)).alias("n")).first()
    plan = [(r["spec_id"], r["capacity"], shards_of(loads[f"t{i}"], loads["n"], r["capacity"])) for i, r in enumerate(few)]
    spec = F.broadcast(counted.sparkSession.createDataFrame(plan, "spec_id int, capacity long, shards int"))  # 1000 rows at most
    each = counted.crossJoin(spec)  # a row for each document and capacity is what is asked for
    rest = F.col("n_tokens") % F.col("capacity")
    long = each.where("n_tokens >= capacity")
    full = long.select("spec_id", "doc_id", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("n_tokens div capacity"))).alias("k"), "capacity")
    full = full.select("spec_id", F.concat(F.lit("d"), F.col("row").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("container_id"), "doc_id", "row", F.col("k").cast("int").alias("piece"), ((F.col("k") - 1) * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"), F.lit(False).alias("relaxed"))
    items = each.where((rest > 0) | (F.col("n_tokens") == 0)).select("spec_id", "capacity", "doc_id", "row", "source", "same", rest.alias("size"), (F.expr("n_tokens div capacity") + 1).cast("int").alias("piece"), (F.col("n_tokens") - rest).alias("first_token"), F.pmod(F.xxhash64("doc_id", "row"), F.col("shards")).alias("shard"))
    pairs = list(conflicting_sources or [])

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row"], kind="stable").reset_index(drop=True)
        many = pdf["same"].duplicated(keep=False)
        cluster = pd.Series(-1, index=pdf.index)
        cluster[many] = pd.factorize(pdf["same"][many])[0]
        names = pdf["source"].fillna("").astype(str)
        code, known = pd.factorize(names)
        at = {s: i for i, s in enumerate(known)}
        conflicts: dict[int, int] = {}
        for a, b in pairs:
            if a in at and b in at:
                conflicts[at[a]] = conflicts.get(at[a], 0) | 1 << at[b]
                conflicts[at[b]] = conflicts.get(at[b], 0) | 1 << at[a]
        place, relaxed = pack(pdf["size"].tolist(), cluster.tolist(), code.tolist(), int(pdf["capacity"].iat[0]), conflicts)
        base = f"{int(pdf['shard'].iat[0])}-"
        return pd.DataFrame({"spec_id": pdf["spec_id"], "container_id": [base + str(p) for p in place], "doc_id": pdf["doc_id"], "row": pdf["row"], "piece": pdf["piece"], "first_token": pdf["first_token"], "n_tokens": pdf["size"], "relaxed": relaxed})

    return full.unionByName(items.groupBy("spec_id", "shard").applyInPandas(shard, OUT))


def invariants(containers: DataFrame, counted: DataFrame, specs: DataFrame) -> DataFrame:
    """Per capacity, what must hold: rows packed, rows whose pieces don't add up to their tokens without gap or overlap,
    containers above the capacity, and pieces of texts that fit as a whole but were cut."""
    spec = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    boxes = containers.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(spec), "spec_id")
    over = boxes.groupBy("spec_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_overfull"))
    # pieces are without gap if they are numbered 1, 2, ... and every piece but the last is as long as the capacity
    rows = containers.groupBy("spec_id", "row").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"), F.countDistinct("first_token").alias("starts"))
    rows = rows.join(counted.select("row", "n_tokens"), "row", "full").join(F.broadcast(spec), "spec_id", "left")
    whole = (F.col("got") == F.col("n_tokens")) & (F.col("upto") == F.col("n_tokens")) & (F.col("n") == F.col("starts"))
    per = rows.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("n_broken"), F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("n") > 1)).alias("n_cut"))
    return per.join(over, "spec_id", "left").select("spec_id", "n_rows", "n_broken", "n_cut", "n_overfull")


def fill_report(containers: DataFrame, specs: DataFrame) -> DataFrame:
    """Per capacity: containers, documents, tokens, share of the space used, pieces placed in spite of a cluster."""
    spec = F.broadcast(specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity")))
    boxes = containers.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count_if("relaxed").alias("relaxed"), F.count_if(F.col("first_token") == 0).alias("starts"))
    per = boxes.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("starts").alias("n_documents"), F.sum("used").alias("n_tokens"), F.sum("relaxed").alias("n_relaxed"), F.max("used").alias("most"))
    return per.join(spec, "spec_id").select("spec_id", "capacity", "n_containers", "n_documents", "n_tokens", "n_relaxed", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("used_share"))
