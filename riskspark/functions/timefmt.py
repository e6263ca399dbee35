"""Durations and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def parse_ttl(value: Column) -> Column:
    """``12h`` or ``7d`` to an interval; anything else is null."""
    amount = F.regexp_extract(value, r"^\s*([+-]?\d+)\s*[hd]$", 1).try_cast("int")
    unit = F.substring(value, -1, 1)
    return F.when(
        amount.isNotNull(),
        F.make_dt_interval(
            days=F.when(unit == "d", amount).otherwise(F.lit(0)),
            hours=F.when(unit == "h", amount).otherwise(F.lit(0)),
        ),
    )


def parse_ts(value: Column) -> Column:
    """RFC 3339 text with a mandatory offset to a UTC timestamp; null when malformed."""
    return F.when(value.rlike(_RFC3339), value.try_cast("timestamp"))
