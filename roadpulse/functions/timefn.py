"""Date/time column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "Asia/Kolkata"

# The timestamp sub-formats found in the incident export
# (milliseconds, microseconds, none; offset written as +00 or +05:30).
TS_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSSX",
    "yyyy-MM-dd HH:mm:ss.SSSX",
    "yyyy-MM-dd HH:mm:ssX",
    "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c) -> Column:
    """Tolerant parse (P1): any of the known layouts, anything else -> NULL."""
    s = F.trim(_c(c).cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(f)) for f in TS_FORMATS]
    return F.coalesce(*tries, F.try_to_timestamp(s))


def first_non_null(*cols) -> Column:
    """Resolved time if present, else closed time."""
    return F.coalesce(*[_c(c) for c in cols])


def elapsed_minutes(start, end) -> Column:
    """Exact elapsed minutes with sub-second precision (no truncation)."""
    return (F.unix_micros(_c(end).cast("timestamp")) -
            F.unix_micros(_c(start).cast("timestamp"))) / F.lit(6e7)


def to_local(c, tz: str = LOCAL_TZ) -> Column:
    """P5: UTC instant -> local wall-clock."""
    return F.from_utc_timestamp(_c(c), tz)


def hour_of_day(local) -> Column:
    return F.hour(_c(local))


def day_of_week_monday0(local) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(_c(local))


def month_of_year(local) -> Column:
    return F.month(_c(local))


def ts_text(c) -> Column:
    """Microsecond ISO text; used where a timestamp is compared as a value."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def load_stamp() -> Column:
    """Report time of day."""
    return F.date_format(F.current_timestamp(), "HH:mm:ss")
