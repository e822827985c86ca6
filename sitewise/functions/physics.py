"""Slopes, residuals, diagnostics, cells and compositions as Catalyst expressions. Undefined results are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



#: Atomic numbers of the anion families, and of the elements that set a population apart.
FAMILIES = {"oxide": (8,), "sulfide": (16,), "halide": (9, 17, 35, 53), "nitride": (7,)}
HUBBARD_SYMBOLS = ("Co", "Cr", "Fe", "Mn", "Mo", "Ni", "V", "W")

def slope(sxy: Column, sxx: Column) -> Column:
    """sxy / sxx, null unless sxx is positive."""
    return F.when(sxx > 0, sxy / sxx)


def residual_fraction(sxy: Column, sxx: Column, syy: Column) -> Column:
    """1 - sxy^2 / (sxx syy), not below 0; null unless both are positive."""
    return F.when((sxx > 0) & (syy > 0), F.greatest(F.lit(0.0), 1 - sxy * sxy / (sxx * syy)))


def misfit(sxy: Column, sxx: Column, syy: Column) -> Column:
    """STRUCT<value, reason>: the root of the residual fraction, or why it is undefined; the first reason counts."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    reason = F.when(bad(sxy) | bad(sxx) | bad(syy), "non_finite_sums").when(sxx <= 0, "zero_reference_norm").when(syy <= 0, "zero_predicted_norm").when(sxy <= 0, "nonpositive_projection")
    return F.struct(F.when(reason.isNull(), F.sqrt(residual_fraction(sxy, sxx, syy))).alias("value"), reason.alias("reason"))


def misfit_tangent(rho: Column) -> Column:
    """rho / sqrt(1 - rho^2); null where rho is null or at least 1."""
    return F.when(rho < 1, rho / F.sqrt(1 - rho * rho))


def log_ratio(a: Column, b: Column) -> Column:
    """|ln(a / b)| of two positive numbers, else null."""
    return F.when((a > 0) & (b > 0), F.abs(F.ln(a / b)))


def scaled(raw: Column, s: Column) -> Column:
    """raw / s; null unless s is positive."""
    return F.when(s > 0, raw / s)


def volume(cell: Column) -> Column:
    """|det| of a 3x3 array of rows."""
    e = lambda i, j: F.get(F.get(cell, F.lit(i)), F.lit(j))
    return F.abs(e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0)))


def family_counts(numbers: Column) -> dict[str, Column]:
    def among(zs: tuple[int, ...]) -> Column:
        return F.size(F.filter(numbers, lambda z: z.isin(*zs)))

    return {f: among(zs) for f, zs in FAMILIES.items()}


def anion_family(numbers: Column) -> Column:
    """The family with strictly most atoms, else 'other'."""
    n = family_counts(numbers)
    best = F.greatest(*n.values())
    tied = sum(((c == best).cast("int") for c in n.values()), F.lit(0))
    out = F.when((best <= 0) | (tied > 1), "other")
    for f, c in n.items():
        out = out.when(c == best, f)
    return out


def mixed_anions(numbers: Column) -> Column:
    """The families present, in fixed order."""
    return F.array_compact(F.array(*(F.when(c > 0, F.lit(f)) for f, c in family_counts(numbers).items())))


def component_sets(z: Column) -> Column:
    """The sets an atom belongs to: all, Li or host, and its own number."""
    return F.array(F.lit("all"), F.when(z == 3, "Li").otherwise("host"), F.concat(F.lit("Z"), z.cast("string")))


def low_barrier_score(side: Column, yhat: Column, y: Column, threshold: float, large: float = 1e6) -> Column:
    """Calibration: yhat + (large if y < threshold else -threshold); test: yhat - threshold."""
    return F.when(side == "calibration", yhat + F.when(y < threshold, F.lit(large)).otherwise(F.lit(-threshold))).otherwise(yhat - threshold)
