"""Arrays to rows.

The array is projected once and expanded by an outer generator whose empty rows are then dropped.
With an inner generator the optimizer would add a non-empty test on the array, which repeats the
whole expression (here: every rule over the text) in a second place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEMS = "_items"


def exploded(frame: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per non-null element."""
    listed = frame.withColumn(_ITEMS, array)
    return listed.withColumn(name, F.explode_outer(_ITEMS)).drop(_ITEMS).where(F.col(name).isNotNull())


def numbered(frame: DataFrame, array: Column, position: str, name: str) -> DataFrame:
    """One row per element with its position."""
    listed = frame.withColumn(_ITEMS, array)
    return (
        listed.select("*", F.posexplode_outer(_ITEMS).alias(position, name))
        .drop(_ITEMS)
        .where(F.col(position).isNotNull())
    )
