"""Quantities recorded in different units, brought to the common unit of their quantity.

A multi-pattern automaton holds every spelling of every unit. It runs over a text once; of overlapping hits the
longest counts, and only where it stands by itself. Which field a hit speaks of is settled by context: the field word
before it in the same clause and the quantity the spelling belongs to. A number just before a hit, where values stand
elsewhere, makes it a setting (a cutoff, a tolerance) and no statement on the field. Conversion factors come from the
conversion table by a broadcast join; that table is a fixed list of units, and its size is checked.

Unit columns are resolved by the same spellings, as a broadcast table. The automaton reads the texts of rows whose unit
column says nothing (for all others it gets null); all other work stays in Catalyst expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator  # noqa: TC003 (read by pandas_udf)
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sitewise.shared import ship

#: Spellings of the base units, by their name in the conversion table; folded as fold() does.
ENERGIES = {
    "eV": ["ev", "electronvolt", "electronvolts", "electron volt", "electron volts"],
    "meV": ["mev", "millielectronvolt", "millielectronvolts", "milli-ev", "1e-3 ev", "10^-3 ev"],
    "hartree": ["hartree", "hartrees", "ha", "eh"],
    "rydberg": ["rydberg", "rydbergs", "ry", "ryd"],
    "kJ/mol": ["kj/mol", "kj mol^-1", "kj per mol", "kj mol-1"],
    "kcal/mol": ["kcal/mol", "kcal mol^-1", "kcal per mol", "kcal mol-1"],
}
LENGTHS = {
    "A": ["a", "å", "ang", "angstrom", "angstroms", "ångström", "ångstrom"],
    "nm": ["nm", "nanometre", "nanometer", "nanometres", "nanometers"],
    "pm": ["pm", "picometre", "picometer", "picometres", "picometers"],
    "bohr": ["bohr", "a0", "a_0", "au", "a.u."],
}
FORCES = {"eV/angstrom": ("eV", "A"), "meV/angstrom": ("meV", "A"), "hartree/bohr": ("hartree", "bohr"), "rydberg/bohr": ("rydberg", "bohr"), "eV/nm": ("eV", "nm")}
RATIOS = {"dimensionless": ["dimensionless", "", "-", "1"], "percent": ["percent", "%", "pct", "per cent"]}
#: Unit columns that say nothing.
SILENT = ["", "?", "-", "--", "n/a", "na", "none", "null", "unknown", "see remark", "see text", "unclear", "tbd"]
#: Words that name a field in a remark.
FIELD_WORDS = {"energy": r"\benerg(?:y|ies)\b|(?-i:\bE)(?=\s*[\[(:=])", "force": r"\bforces?\b|(?-i:\bF)(?=\s*[\[(:=])"}
NUMBER = r"[-+−]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][-+−]?\d+)?"
MAX_UNITS = 5000

_RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻−‐‑–", "0123456789-----")


def fold(text: str) -> str:
    """Lower case, one blank for a run of blanks, raised digits as ^n, a plain minus, and · as a blank."""
    text = re.sub(r"[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+", lambda m: "^" + m[0].translate(_RAISED), text).translate(_RAISED)
    return re.sub(r"\s+", " ", re.sub(r"\s*[·*⋅]\s*", " ", text.replace("å", "å").replace("Å", "Å").lower())).strip()


@lru_cache(maxsize=1)
def spellings() -> dict[str, dict[str, str]]:
    """quantity -> folded spelling -> unit; compound units are built from the base spellings by rule."""
    per = ("{0}/{1}", "{0} {1}^-1", "{0} per {1}", "{0} / {1}", "{0} {1}-1")
    raised = ("{0}^3", "{0}3", "cubic {0}")
    dense = ("{0}^-3", "{0}-3", "1/{0}^3", "1/{0}3", "per {0}^3", "per {0}3", "/{0}^3", "per cubic {0}")
    out = {"energy": {s: u for u, ss in ENERGIES.items() for s in ss}, "length": {s: u for u, ss in LENGTHS.items() for s in ss}, "ratio": {s: u for u, ss in RATIOS.items() for s in ss}}
    out["force"] = {p.format(e, x): u for u, (a, b) in FORCES.items() for e in ENERGIES[a] for x in LENGTHS[b] for p in per}
    for quantity, forms, mark in (("volume", raised, "^3"), ("number_density", dense, "^-3")):
        out[quantity] = {p.format(s): u + mark for u in ("A", "nm", "bohr") for s in LENGTHS[u] for p in forms}
    return out


@lru_cache(maxsize=1)
def automaton():  # noqa: ANN201
    """Aho-Corasick automaton over all spellings; a hit gives the spelling and its unit in each quantity that knows it."""
    import ahocorasick

    by: dict[str, dict[str, str]] = {}
    for quantity, known in spellings().items():
        for s, unit in known.items():
            if len(s) and s not in ("-", "1"):
                by.setdefault(s, {})[quantity] = unit
    found = ahocorasick.Automaton()
    for s, units in by.items():
        found.add_word(s, (s, units))
    found.make_automaton()
    return found


def hits(folded: str) -> list[tuple[int, int, dict[str, str]]]:
    """(start, end, unit by quantity) of the spellings that stand by themselves: the longest at each place, left to right."""
    free = lambda k: not (0 <= k < len(folded)) or not (folded[k].isalnum() or folded[k] in "_^")
    whole = []
    for last, (s, units) in automaton().iter(folded):
        a, b = last - len(s) + 1, last + 1
        inner = folded[a].isalnum()
        if (not inner or free(a - 1) or (folded[a - 1].isdigit() and not folded[a].isdigit())) and (not folded[last].isalnum() or free(b)):
            whole.append((a, b, units))
    out: list[tuple[int, int, dict[str, str]]] = []
    for a, b, units in sorted(whole, key=lambda h: (h[0] - h[1], h[0])):  # longest first
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, units))
    return sorted(out, key=lambda h: h[0])


def stated_unit(text: str | None, field: str) -> str | None:
    """The unit that a remark states for a field ('energy' or 'force'), else None; the first statement counts."""
    if not text:
        return None
    for clause in re.split(r";|\.(?=\s|$)|\n", text):
        folded = fold(clause)
        words = sorted((m.start(), m.end(), f) for f, p in FIELD_WORDS.items() for m in re.finditer(p, _keep_case(clause), re.I))
        for a, _, units in hits(folded):
            if field not in units or re.search(rf"{NUMBER}\s*$", folded[:a]):
                continue
            before = [w for w in words if w[1] <= a]
            if before and before[-1][2] == field:
                return units[field]
    return None


def _keep_case(clause: str) -> str:
    """fold() without the lower case, so that places agree with the folded text."""
    out, plain = [], re.sub(r"[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+", lambda m: "^" + m[0].translate(_RAISED), clause).translate(_RAISED)
    plain = re.sub(r"\s+", " ", re.sub(r"\s*[·*⋅]\s*", " ", plain)).strip()
    for ch in plain:
        out.append(ch if len(ch.lower()) == 1 else ch.lower())
    return "".join(out)


def number_and_unit(text: str | None, quantity: str | None) -> tuple[float | None, str | None]:
    """The first number that stands by itself in a text, and the unit of the quantity right after it."""
    if not text:
        return None, None
    folded = fold(text)
    m = re.search(rf"(?<![\w^.,]){NUMBER}", folded)
    if not m:
        return None, None
    try:
        value = float(m[0].replace(",", ".").replace("−", "-"))
    except ValueError:
        return None, None
    for a, _, units in hits(folded):
        if quantity in units and (folded[m.end() : a].strip(" ([") == "" if a >= m.end() else False):
            return value, units[quantity]
    return value, None


def unit_named(quantity: str, said: str | None) -> str | None:
    """The unit that a unit column says for a quantity, None if it says nothing known."""
    if said is None:
        return None
    folded = fold(said)
    if quantity != "ratio" and folded in SILENT:
        return None
    return spellings().get(quantity, {}).get(folded)


def resolve_column(df: DataFrame, quantity: Column, said: Column, into: str) -> DataFrame:
    """df with `into`: the unit that the column says. Spellings are broadcast: their number is fixed by rule."""
    spark = df.sparkSession
    rows = [(q, s, u) for q, known in spellings().items() for s, u in known.items()]
    if len(rows) > MAX_UNITS:
        raise ValueError("too many unit spellings to broadcast")
    q, s, u = (f"{into}_{x}" for x in ("q", "s", "u"))
    known = F.broadcast(spark.createDataFrame(rows, f"{q} string, {s} string, {u} string"))
    folded = F.lower(F.translate(said, "Å−‐‑–·⋅", "Å----··"))
    folded = F.regexp_replace(F.regexp_replace(folded, r"⁻³", "^-3"), r"⁻¹", "^-1")
    folded = F.regexp_replace(F.regexp_replace(folded, "³", "^3"), r"\s*·\s*", " ")
    folded = F.btrim(F.regexp_replace(folded, r"\s+", " "))
    return df.join(known, (quantity == F.col(q)) & (folded == F.col(s)), "left").withColumn(into, F.col(u)).drop(q, s, u)


@F.pandas_udf(StringType())
def _from_text(texts: pd.Series, fields: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(texts), dtype=object)
    for i in np.nonzero(texts.notna().to_numpy())[0]:
        out.iat[i] = stated_unit(texts.iat[i], fields.iat[i])
    return out


@F.pandas_udf(StructType([StructField("value", DoubleType()), StructField("unit", StringType())]))
def _reading(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, quantities in parts:
        yield pd.DataFrame([number_and_unit(t if isinstance(t, str) else None, q if isinstance(q, str) else None) for t, q in zip(texts, quantities, strict=True)], columns=["value", "unit"])


def short(table: DataFrame) -> DataFrame:
    """A table to broadcast; refused beyond MAX_UNITS rows."""
    if table.limit(MAX_UNITS + 1).count() > MAX_UNITS:
        raise ValueError("the table is no short list")
    return F.broadcast(table)


def conversions(table: DataFrame) -> DataFrame:
    """The conversion table ready to broadcast; refused beyond MAX_UNITS rows."""
    if table.limit(MAX_UNITS + 1).count() > MAX_UNITS:
        raise ValueError("the conversion table is no short list of units")
    return F.broadcast(table.select(F.col("quantity").alias("c_quantity"), F.col("source_unit").alias("c_unit"), F.col("canonical_unit").alias("c_canonical"), F.col("factor").alias("c_factor")).dropDuplicates(["c_quantity", "c_unit"]))


def normalise_records(records: DataFrame, conversion: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Energies and forces of inference records in their common units.

    One row for each record and field (energy, forces) with a non-null value: record_table, row_id, field_name,
    source_unit (null if unknown), common_unit, value (energy) or values (forces) in the common unit; an unknown unit
    leaves the converted value null and the given value in given / given_values. NaN values stay NaN. `keep`: further
    columns of the records to carry along.
    """
    ship(records.sparkSession)
    base = records.select("row_id", "energy", "energy_unit", "forces", "force_unit", "remark", *keep)
    e = base.where("energy is not null").select("row_id", F.lit("energy").alias("field_name"), F.lit("energy").alias("quantity"), F.col("energy_unit").alias("said"), "remark", F.col("energy").alias("given"), F.lit(None).cast("array<array<double>>").alias("given_values"), *keep)
    f = base.where("forces is not null").select("row_id", F.lit("forces"), F.lit("force"), "force_unit", "remark", F.lit(None).cast("double"), "forces", *keep)
    rows = resolve_column(e.union(f), F.col("quantity"), F.col("said"), "named")
    needs = F.col("named").isNull() & F.col("remark").isNotNull()
    text = _from_text(F.when(needs, F.col("remark")), F.col("quantity"))
    rows = rows.withColumn("stated", text).withColumn("source_unit", F.coalesce("named", "stated"))
    rows = rows.join(conversions(conversion), (F.col("quantity") == F.col("c_quantity")) & (F.col("source_unit") == F.col("c_unit")), "left")
    factor = F.col("c_factor")
    converted = F.when(factor.isNotNull(), F.transform("given_values", lambda r: F.transform(r, lambda x: x * factor)))
    return rows.select(F.lit("inference_record").alias("record_table"), "row_id", "field_name", "source_unit", F.col("c_canonical").alias("common_unit"), (F.col("given") * factor).alias("value"), converted.alias("values"), "given", "given_values", *keep)


def normalise_readings(readings: DataFrame, manifest: DataFrame, conversion: DataFrame) -> DataFrame:
    """Readings of descriptors in the common unit of their feature, whether they stand in reading or in reading_text.

    Columns as normalise_records(); a feature that the manifest doesn't know has no quantity and so no unit. The
    number in reading_text counts only where reading is null. A text without a number gives no row.
    """
    ship(readings.sparkSession)
    if manifest.limit(MAX_UNITS + 1).count() > MAX_UNITS:
        raise ValueError("the manifest is no short list of features")
    known = F.broadcast(manifest.select(F.col("feature_name").alias("m_feature"), "quantity", F.col("unit").alias("common_unit")).dropDuplicates(["m_feature"]))
    rows = readings.select("row_id", "feature_name", "reading", "reading_text", F.col("unit").alias("said")).join(known, F.col("feature_name") == F.col("m_feature"), "left")
    rows = resolve_column(rows, F.col("quantity"), F.col("said"), "named")
    use = F.when(F.col("reading").isNull() | F.col("named").isNull(), F.col("reading_text"))
    rows = rows.withColumn("read", _reading(use, F.col("quantity")))
    rows = rows.withColumn("given", F.coalesce("reading", "read.value")).withColumn("source_unit", F.coalesce("named", "read.unit")).where("given is not null")
    rows = rows.join(conversions(conversion), (F.col("quantity") == F.col("c_quantity")) & (F.col("source_unit") == F.col("c_unit")) & (F.col("common_unit") == F.col("c_canonical")), "left")
    return rows.select(F.lit("descriptor_value").alias("record_table"), "row_id", F.lit("reading").alias("field_name"), "source_unit", "common_unit", (F.col("given") * F.col("c_factor")).alias("value"), F.lit(None).cast("array<array<double>>").alias("values"), "given", F.lit(None).cast("array<array<double>>").alias("given_values"))


def normalise(records: DataFrame, readings: DataFrame, manifest: DataFrame, conversion: DataFrame) -> DataFrame:
    """normalise_records and normalise_readings together."""
    return normalise_records(records, conversion).unionByName(normalise_readings(readings, manifest, conversion))
