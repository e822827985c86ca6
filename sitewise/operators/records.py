"""Checks of records and of series with units, nested JSON as paths, and composition names, for tables of any size."""

from __future__ import annotations

import json
from collections.abc import Iterator  # noqa: TC003 (read by pandas_udf)

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.elements import SYMBOLS
from sitewise.operators.arrays import finite

INF = float("inf")


def record_problems(frames_known: Column) -> dict[str, Column]:
    """Rules of an inference record, name -> broken: identifiers, split, counts, attempts, and the values of a success."""
    blank = lambda c: F.coalesce(F.btrim(c) == "", F.lit(True))
    ok = F.col("status") == "success"
    shape = F.forall("forces", lambda r: (F.size(r) == 3) & F.forall(r, lambda v: F.coalesce(finite(v), F.lit(False))))
    return {
        "no_key": blank("record_key"),
        "no_frame": blank("frame_id"),
        "unknown_frame": ~blank("frame_id") & ~F.coalesce(frames_known, F.lit(False)),
        "bad_split": ~F.coalesce(F.col("published_split").isin("train", "val", "test"), F.lit(False)),
        "bad_status": ~F.coalesce(F.col("status").isin("success", "failed"), F.lit(False)),
        "bad_count": ~F.coalesce(F.col("n_atoms") > 0, F.lit(False)),
        "bad_attempt": ~F.coalesce(F.col("attempt_number") >= 1, F.lit(False)),
        "no_energy": ok & ~F.coalesce(finite(F.col("energy")), F.lit(False)),
        "no_forces": ok & F.col("forces").isNull(),
        "bad_forces": F.col("forces").isNotNull() & ~F.coalesce(shape, F.lit(False)),
        "more_forces_than_atoms": F.col("forces").isNotNull() & (F.size("forces") > F.col("n_atoms")),
        "values_of_a_failure": (F.col("status") == "failed") & (F.col("energy").isNotNull() | F.col("forces").isNotNull()),
    }


def broken_rules(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, broken): the names of the rules that each row breaks, in their order; rows that break none are left out."""
    named = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))), ";")
    return rows.select(key, named.alias("broken")).where("broken <> ''")


def energy_adds_up(total: Column, per_atom: Column, n: Column, tolerance: float = 1e-9) -> Column:
    """Is the energy of the frame that of an atom times the atoms, within a relative tolerance?"""
    return F.abs(total - per_atom * n) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(total))


def system_problem(c: Column) -> Column:
    """Why a text is no name of a chemical system: 'empty', 'leftover' (letters or signs beside symbols, digits and
    separators), 'unknown' (a symbol that no element has); null if it is one."""
    symbols = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]?)"), 1)
    rest = F.regexp_replace(F.regexp_replace(c, r"[A-Z][a-z]?", ""), r"[\d\s.()\[\]{},_+\-/]+", "")
    known = F.array(*(F.lit(s) for s in SYMBOLS))
    return F.when(c.isNull() | (F.size(symbols) == 0), "empty").when(rest != "", "leftover").when(F.size(F.array_except(symbols, known)) > 0, "unknown")


def temperature_series(values: Column, unit: Column) -> Column:
    """STRUCT<status, kelvin>: 'missing', 'empty', 'unit_unresolved', 'invalid' (a value not finite or not in (0, 1e4] K)
    or 'recoverable', with the values in kelvin. Units: K, kelvin, C, °C, celsius."""
    u = F.lower(F.btrim(unit))
    shift = F.when(u.isin("k", "kelvin"), 0.0).when(u.isin("c", "°c", "celsius", "degc"), 273.15)
    kelvin = F.transform(values, lambda v: v + shift)
    fine = F.forall(kelvin, lambda v: F.coalesce(finite(v) & (v > 0) & (v <= 1e4), F.lit(False)))
    status = F.when(values.isNull(), "missing").when(F.size(values) == 0, "empty").when(shift.isNull(), "unit_unresolved").when(fine, "recoverable").otherwise("invalid")
    return F.struct(status.alias("status"), F.when(status == "recoverable", kelvin).alias("kelvin"))


def displacement_series(values: Column, unit: Column) -> Column:
    """STRUCT<status, angstrom2> of mean squared displacements: as temperature_series(), for finite values of 0 or more
    in Å², nm² or cm²."""
    u = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(unit)), "²", "^2"), r"å|angstrom|ang\b", "a")
    factor = F.when(u.isin("a^2", "a2"), 1.0).when(u.isin("nm^2", "nm2"), 100.0).when(u.isin("cm^2", "cm2"), 1e16)
    scaled = F.transform(values, lambda v: v * factor)
    fine = F.forall(values, lambda v: F.coalesce(finite(v) & (v >= 0), F.lit(False)))
    status = F.when(values.isNull(), "missing").when(F.size(values) == 0, "empty").when(~fine, "invalid").when(factor.isNull(), "unit_unresolved").otherwise("recoverable")
    return F.struct(status.alias("status"), F.when(status == "recoverable", scaled).alias("angstrom2"))


def diffusion_pairs(attributes: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, name, status, si, cgs) of attributes(key, name, value): diffusion coefficients given in m²/s and in cm²/s.

    Names read <what>_si or <what>_m2_s, and <what>_cm2_s. A pair agrees if 1e-4 times the one in cm²/s is the other
    within the relative tolerance; 'agrees', 'contradicts', 'si_only', 'cgs_only' or 'invalid' (negative or not finite).
    """
    d = attributes.where(F.lower("name").rlike("diffus"))
    cgs = F.lower("name").rlike(r"_cm2_?/?s$")
    what = F.regexp_replace(F.lower("name"), r"_(si|m2_?/?s|cm2_?/?s)$", "")
    bad = ~F.coalesce(finite(F.col("value")) & (F.col("value") >= 0), F.lit(False))
    a = d.groupBy(key, what.alias("what")).agg(F.max(F.when(~cgs, F.col("value"))).alias("si"), F.max(F.when(cgs, F.col("value"))).alias("cgs"), F.bool_or(bad).alias("bad"))
    near = F.abs(F.col("cgs") * 1e-4 - F.col("si")) <= F.lit(tolerance) * F.greatest(F.abs(F.col("cgs") * 1e-4), F.abs("si"))
    status = F.when(F.col("bad"), "invalid").when(F.col("cgs").isNull(), "si_only").when(F.col("si").isNull(), "cgs_only").when(near, "agrees").otherwise("contradicts")
    return a.select(key, F.col("what").alias("name"), status.alias("status"), "si", "cgs")


def json_paths(text: Column, heads: int = 20, limit: int = 2_000) -> Column:
    """MAP<path, value as JSON> of the leaves of a JSON text, whatever its depth: keys joined by '.', of lists the first
    `heads` entries under the list's own path (the first value of a path counts), at most `limit` paths. Null for a
    text that doesn't parse."""

    def walk(value: object, path: str, out: dict[str, str]) -> None:
        if len(out) >= limit:
            return
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}" if path else str(k), out)
        elif isinstance(value, list):
            for v in value[:heads]:
                walk(v, path, out)
        elif path:
            out.setdefault(path, json.dumps(value))

    @F.pandas_udf("map<string,string>")
    def paths(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            rows = []
            for s in t:
                found: dict[str, str] = {}
                try:
                    walk(json.loads(s), "", found)
                    rows.append(found)
                except (TypeError, ValueError):
                    rows.append(None)
            yield pd.Series(rows, dtype=object)

    return paths(text)


def coverage(have: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of both, those wanted but not there, and those there but not wanted; null keys are none."""
    whole = " and ".join(f"{k} is not null" for k in keys)
    tag = lambda df, s: df.where(whole).select(*keys, F.lit(s).alias("_side"))
    per = tag(have, "have").unionByName(tag(wanted, "want")).groupBy(*keys).agg(F.max(F.col("_side") == "have").alias("h"), F.max(F.col("_side") == "want").alias("w"))
    return per.agg(F.count_if(F.col("h") & F.col("w")).alias("n_both"), F.count_if(~F.col("h")).alias("n_missing"), F.count_if(~F.col("w")).alias("n_unexpected"))


def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of all parts; a key that occurs twice raises when it is evaluated."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    twice = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*(c for c in whole.columns if c not in keys))).alias("_row"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("a key occurs in two parts")))
    return twice.select(*keys, row.alias("_row")).select(*keys, "_row.*")
