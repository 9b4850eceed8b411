"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Micrometres per pixel and per section.
PIXEL_UM = 0.4961
SECTION_UM = 4.5
MARKERS = ("CD31", "GAP43", "NFP", "CD3", "CD163", "CK")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats are NULL inside the engine: NaN would poison averages and sort above every number."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or a ValueError that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, lit(low)), lit(high))


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of all ``keys`` between two aliased frames."""
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return out


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL for a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
