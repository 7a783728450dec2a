"""Statistics as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % score interval for a proportion; null when there is nothing to count."""
    n = n.cast("double")
    p = successes / n
    base = 1 + z * z / n
    centre = p + z * z / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.greatest(F.lit(0.0), (centre - margin) / base)
    high = F.least(F.lit(1.0), (centre + margin) / base)
    return F.when(n > 0, low), F.when(n > 0, high)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Chebyshev fit, relative error < 1.2e-7)."""
    t = 1 / (1 + 0.5 * x)
    # --- fixed values: published Chebyshev coefficients ---
    coefficients = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided p-value, continuity-corrected chi-square with one degree of freedom."""
    stat = F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)), 2) / (b + c)
    return F.when(b + c == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(stat / 2)))
