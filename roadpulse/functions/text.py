"""String column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_lower(c) -> Column:
    """P10: strip every kind of whitespace (tabs, newlines too), lower-case."""
    return F.lower(F.regexp_replace(_c(c), r"^\s+|\s+$", ""))


def blank_to(c, default: str = "unknown") -> Column:
    """NULL or blank -> default."""
    col = _c(c)
    return F.when(col.isNull() | (F.regexp_replace(col, r"\s", "") == ""), F.lit(default)).otherwise(col)


def display_title(c) -> Column:
    """``water_logging`` -> ``Water Logging``."""
    return F.initcap(F.regexp_replace(_c(c), "_", " "))


def hour_label(c) -> Column:
    """``8`` -> ``08:00``."""
    return F.concat(F.lpad(_c(c).cast("string"), 2, "0"), F.lit(":00"))


def percent_label(c) -> Column:
    """Probability -> ``NN%`` (half-even, like Python's format)."""
    return F.concat(F.bround(_c(c) * 100, 0).cast("long").cast("string"), F.lit("%"))


def minutes_label(c) -> Column:
    return F.concat(F.lit("~"), F.bround(_c(c), 0).cast("long").cast("string"), F.lit(" min"))
