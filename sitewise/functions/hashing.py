"""Seeds, ranks, buckets and digests from SHA-256 of text, as Catalyst expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"
#: Stands for null: a control sign that no name or number holds.
NULL = "\u0001null"


def _text(parts: tuple[Column | str, ...]) -> Column:
    """The parts with NUL between them; a plain string is a literal, and null is a part of its own that no text is."""
    return F.concat_ws(NUL, *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(NULL)) for p in parts))


def rank_hex(*parts: Column | str) -> Column:
    """SHA-256 in hex of the parts: a rank that doesn't depend on order, sizes or outcomes."""
    return F.sha2(_text(parts), 256)


def seed64(*parts: Column | str) -> Column:
    """The first 8 bytes of the digest as an unsigned number, DECIMAL(20,0)."""
    return F.conv(F.substring(rank_hex(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(c: Column, missing: str = "__missing__") -> Column:
    """Two hex digits of the digest; null has the bucket of a sentinel."""
    return F.substring(F.sha2(F.coalesce(c, F.lit(missing)), 256), 1, 2)


def ids_digest(ids: Column) -> Column:
    """Digest of the sorted distinct texts of an array, as a JSON list."""
    sorted_ids = F.array_sort(F.array_distinct(ids))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(sorted_ids, lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))), ","), F.lit("]")), 256)


def digest_by_group(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, digest, n_ids): ids_digest() of each group's distinct items, streamed over sorted rows, so that a group of
    any size is never held. Null groups and items are left out."""
    kind = dict(rows.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha, n, out = None, None, 0, []

        def closed() -> tuple:
            sha.update(b"]")
            return now, sha.hexdigest(), n

        for pdf in batches:
            for g, x in zip(pdf[group], pdf[item], strict=True):
                if sha is None or g != now:
                    if sha is not None:
                        out.append(closed())
                    now, sha, n = g, hashlib.sha256(b"["), 0
                text = x.replace("\\", "\\\\").replace('"', '\\"')
                sha.update(f'{"," if n else ""}"{text}"'.encode())
                n += 1
            yield pd.DataFrame(out, columns=[group, "digest", "n_ids"])
            out = []
        if sha is not None:
            yield pd.DataFrame([closed()], columns=[group, "digest", "n_ids"])

    once = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item).distinct()
    return once.repartition(group).sortWithinPartitions(group, item).mapInPandas(run, f"{group} {kind}, digest string, n_ids long")


def row_digest(**fields: Column) -> Column:
    """Digest of the row as compact JSON with sorted keys, null fields included; a number that isn't finite is an error."""
    whole = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    odd = F.exists(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in fields.values())), lambda v: v.isin("NaN", "Infinity", "-Infinity"))
    return F.sha2(F.when(odd, F.raise_error(F.lit("a number isn't finite")).cast("string")).otherwise(whole), 256)
