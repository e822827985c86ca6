"""Mixing sources to target weights.

Documents get hash-random keys and are ordered by them within their source; distributed prefix sums of token counts
tell where the source's budget ends. A budget beyond one pass takes whole passes (every document once more each) and
then a part of the next, up to the source's cap. The document on the cut is taken if more than half of it is within
the budget, so a source misses its budget by half a document at most.

Without a total, the largest one is taken at which every source with a share can fill it within its cap. With a
larger total, sources that can't fill their share give all they have, and the report shows what was reached.

Defined cases: documents without a source or of a source without a share are not drawn; null texts neither; empty
texts have no tokens and go with the document before them; shares are scaled to add up to 1; repeated rows of a
document are documents; a null or non-positive share or cap gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.components import running_total
from sitewise.shared import written

MAX_SOURCES = 10_000


def budgets(counted: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per source of targets: source, share, cap, tokens, docs, budget. At most MAX_SOURCES rows."""
    rows = targets.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many sources in targets")
    have = {r["source"]: r for r in counted.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    scale = sum(r["target_share"] for r in rows if (r["target_share"] or 0) > 0)
    out = []
    for r in rows:
        share, cap = max(0.0, r["target_share"] or 0.0) / scale if scale else 0.0, max(0, r["max_repeats"] or 0)
        got = have.get(r["source"])
        out.append({"source": r["source"], "share": share, "cap": cap, "tokens": got["tokens"] if got else 0, "docs": got["docs"] if got else 0})
    usable = [x for x in out if x["share"] > 0 and x["tokens"] * x["cap"] > 0]
    most = total if total is not None else min((int(x["tokens"] * x["cap"] / x["share"]) for x in usable), default=0)
    for x in out:
        x["budget"] = min(round(most * x["share"]), x["tokens"] * x["cap"])
    return out


def draw(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, uses): the documents drawn and how often each is used."""
    return _drawn(counted, budgets(counted, targets, total), seed)


def _drawn(counted: DataFrame, per_source: list[dict], seed: int) -> DataFrame:
    plan = counted.sparkSession.createDataFrame([(x["source"], x["budget"], x["tokens"], x["cap"]) for x in per_source if x["budget"] > 0], "source string, budget long, all_tokens long, cap int")
    rows = counted.join(F.broadcast(plan), "source").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    summed = running_total(rows, ["source"], "key", "n_tokens", "upto", tie="doc_id")
    passes = F.expr("budget div all_tokens")
    rest = F.col("budget") - passes * F.col("all_tokens")
    inside = (F.col("upto") - F.col("n_tokens") / 2 < rest) & (passes < F.col("cap"))
    uses = (F.least(passes, F.col("cap")) + F.when(inside, 1).otherwise(0)).cast("int")
    return summed.select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")


def report(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """Per source of targets: target_share, reached_share, budget, drawn tokens and documents, most uses of one, all tokens."""
    per_source = budgets(counted, targets, total)
    drawn = written(_drawn(counted, per_source, seed))
    per = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses"))
    whole = drawn.agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("whole"))
    plan = counted.sparkSession.createDataFrame([(x["source"], x["share"], x["budget"], x["tokens"]) for x in per_source], "source string, target_share double, budget long, source_tokens long")
    return plan.join(per, "source", "left").crossJoin(F.broadcast(whole)).select("source", "target_share", (F.coalesce("drawn", F.lit(0)) / F.nullif("whole", F.lit(0))).alias("reached_share"), "budget", F.coalesce("drawn", F.lit(0)).alias("drawn_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "source_tokens")
