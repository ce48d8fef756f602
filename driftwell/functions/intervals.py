"""Wilson intervals and linear quantiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def z_score(alpha: float) -> float:
    """Fixed values for 0.05 and 0.10; anything else counts as 0.05."""
    return 1.644854 if abs(alpha - 0.10) < 1e-9 else 1.959964


def wilson(hits: Column, n: Column, alpha: float) -> tuple[Column, Column, Column]:
    """(point, low, high) of a proportion, clamped to [0, 1]; zeros where n is not positive."""
    z = z_score(alpha)
    some = n > 0
    n_ = F.when(some, n.cast("double"))
    zz = F.lit(z * z)
    p = hits.cast("double") / n_
    scale = F.lit(1.0) + zz / n_
    centre = p + zz / (F.lit(2.0) * n_)
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n_ + zz / (F.lit(4.0) * (n_ * n_)))
    zero = F.lit(0.0)
    low, high = (centre - half) / scale, (centre + half) / scale
    # greatest() and least() skip nulls, so rows without a count need a case of their own.
    case = lambda x: F.when(some, x).otherwise(zero)
    return case(p), case(F.greatest(zero, low)), case(F.least(F.lit(1.0), high))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation at q (n - 1); 0 for no rows."""
    return F.coalesce(F.percentile(x, F.lit(q)), F.lit(0.0))


def register(spark: SparkSession, alpha: float = 0.05) -> None:
    """SQL functions wilson_low(hits, n) and wilson_high(hits, n) for ad-hoc queries."""
    z = z_score(alpha)
    scale, centre = f"(1 + {z * z} / n)", f"(k / n + {z * z} / (2 * n))"
    half = f"({z} * sqrt((k / n) * (1 - k / n) / n + {z * z} / (4 * (n * n))))"
    for name, body in (("wilson_low", f"greatest(0D, ({centre} - {half}) / {scale})"), ("wilson_high", f"least(1D, ({centre} + {half}) / {scale})")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN {body} ELSE 0D END")
