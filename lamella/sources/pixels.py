"""Dense planes and masks as pixel rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixels(planes: DataFrame, width: int, keys: Sequence[str] = ("core", "slice_z"), values: str = "values", out: str = "v") -> DataFrame:
    """(keys, y, x, v) from planes stored as one array each, row after row. Shapes may differ: absent pixels are no rows."""
    long = planes.select(*keys, F.posexplode(values).alias("_i", out))
    return long.select(*keys, F.floor(F.col("_i") / width).alias("y"), (F.col("_i") % width).cast("long").alias("x"), out)


def mask_pixels(masks: DataFrame, width: int, keys: Sequence[str] = ("core", "slice_z"), values: str = "values") -> DataFrame:
    """The same for label masks, without the background 0."""
    return pixels(masks, width, keys, values, "label").filter("label <> 0")
