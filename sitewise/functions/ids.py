"""Identifier, split and composition spellings brought to one normal form, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dash signs that count as a hyphen, and the signs trimmed around an id.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
BLANKS = " \t\n\r "
EDGE = r"^(.+)_(\d{1,9})_(\d{1,9})_(-?\d{1,9})_(-?\d{1,9})_(-?\d{1,9})$"


def plain_id(c: Column) -> Column:
    """Lower case, plain hyphens, no blanks around; a blank id is null."""
    return F.nullif(F.btrim(F.lower(F.translate(c, DASHES, "-" * len(DASHES))), F.lit(BLANKS)), F.lit(""))


def plain_split(c: Column) -> Column:
    """train, val or test (valid and validation are val); a blank split is null, any other word stays as it is."""
    s = F.nullif(F.btrim(F.lower(c), F.lit(BLANKS)), F.lit(""))
    return F.when(s.isin("valid", "validation"), "val").otherwise(s)


def plain_chemsys(c: Column) -> Column:
    """The distinct element symbols, sorted and joined by '-'; null where there is none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Z][a-z]?)"), 1))), "-"), F.lit(""))


def edge_parts(edge: Column) -> Column:
    """STRUCT<material, source, target, ox, oy, oz> of a plain edge id; every field null where it doesn't parse."""
    part = lambda i: F.nullif(F.regexp_extract(edge, EDGE, i), F.lit(""))
    names = ("source", "target", "ox", "oy", "oz")
    return F.struct(part(1).alias("material"), *(part(i).try_cast("int").alias(n) for i, n in enumerate(names, 2)))


def canonical_hop(source: Column, target: Column, ox: Column, oy: Column, oz: Column) -> Column:
    """One text for a hop and its reverse: the smaller site first, at equal sites the larger offset; null if a part is."""
    there, back = F.struct(ox, oy, oz), F.struct(-ox, -oy, -oz)
    turn = (source > target) | ((source == target) & (back > there))
    text = lambda *cs: F.concat_ws("_", *(x.cast("string") for x in cs))
    whole = source.isNotNull() & target.isNotNull() & ox.isNotNull() & oy.isNotNull() & oz.isNotNull()
    return F.when(whole, F.when(turn, text(target, source, -ox, -oy, -oz)).otherwise(text(source, target, ox, oy, oz)))


def split_of_file(c: Column) -> Column:
    """The split at the end of a file's name, before the extension, in any case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.btrim(c, F.lit(BLANKS)), r"(?i)_(train|val|test)\.[A-Za-z0-9.]+$", 1)), F.lit(""))


def source_of_file(c: Column) -> Column:
    """What precedes the split in a file's name; the whole name if it has no split."""
    return F.regexp_replace(F.btrim(c, F.lit(BLANKS)), r"(?i)_(train|val|test)\.[A-Za-z0-9.]+$", "")
