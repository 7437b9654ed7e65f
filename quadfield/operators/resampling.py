"""Element-wise resampling and modal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadfield.functions import kernels
from quadfield.operators.layout import KEYS


def resample(df: DataFrame, names: list[str], m: int, kind: str = "uniform") -> DataFrame:
    """Geometry and fields on an ``m x m`` grid per element (``uniform``, ``gll``, ``cell_centers``)."""
    keys = [c for c in KEYS if c in df.columns and c != "n"]
    return df.select(*keys, F.lit(m).alias("n"), *[kernels.resample(c, m, kind).alias(c) for c in ["x", "y", *[k for k in names if k not in ("x", "y")]]])


def modal(df: DataFrame, names: list[str]) -> DataFrame:
    """Legendre coefficients of the fields."""
    keys = [c for c in KEYS if c in df.columns]
    return df.select(*keys, *[kernels.modal(c).alias(c) for c in names])


def modal_decay(coeffs: Column | str, n: int) -> Column:
    """Share of the modal energy in the highest mode of either direction (a resolution indicator)."""
    c = F.col(coeffs) if isinstance(coeffs, str) else coeffs
    total = F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    top = F.aggregate(
        F.filter(c, lambda v, p: ((p % n) == n - 1) | (p >= n * (n - 1))), F.lit(0.0), lambda a, v: a + v * v
    )
    return F.when(total > 0, top / total).otherwise(F.lit(0.0))
