"""Column expressions of information theory and of the chi-squared distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logarithm(base: float | str = 2):
    """A function Column -> Column: base 2, 10, 'e', or any other base given as a float."""
    if base == "e":
        return F.ln
    if isinstance(base, int) and base not in (2, 10):
        raise AssertionError(f"no logarithm of integer base {base}: 2 and 10 are supported, others as floats")
    return {2: F.log2, 10: F.log10}.get(base, lambda c: F.log(float(base), c))


def entropy_term(p: Column, base: float | str = "e") -> Column:
    """-p log p, 0 at p = 0."""
    return F.when(p > 0, -p * logarithm(base)(p)).otherwise(0.0)


def mi_term(n: Column, nx: Column, ny: Column, total: Column, base: float | str = 2) -> Column:
    """A cell's share of the mutual information, from its count and the counts of its row and column."""
    n, nx, ny, total = (c.cast("double") for c in (n, nx, ny, total))
    return n / total * logarithm(base)(n * total / (nx * ny))


def cmi_term(n: Column, nxz: Column, nyz: Column, nz: Column, total: Column, base: float | str = "e") -> Column:
    """A cell's share of the conditional mutual information."""
    n, nxz, nyz, nz, total = (c.cast("double") for c in (n, nxz, nyz, nz, total))
    return n / total * logarithm(base)(n * nz / (nxz * nyz))


def chi2_cdf(statistic: Column, dof: Column) -> Column:
    """The chi-squared distribution function. Not to be used inside an aggregation: Spark counts reflect() as not deterministic."""
    p = F.reflect(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("regularizedGammaP"), dof.cast("double") / 2, F.greatest(statistic.cast("double"), F.lit(0.0)) / 2).cast("double")
    return F.when(statistic <= 0, 0.0).otherwise(p)


def sufficient(n: Column, dof: Column) -> Column:
    """The default rule: more than five samples to each degree of freedom."""
    return 5 * dof < n
