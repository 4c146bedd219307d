"""Array literals built in one JVM call (a Python loop of ``lit`` is one
Py4J round trip per element)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_sql(v: float) -> str:
    """A SQL text that parses to exactly this double (exponent form is DOUBLE)."""
    r = repr(float(v))
    return r if "e" in r else r + "e0"


def double_array(values) -> Column:
    return F.expr("array(" + ", ".join(double_sql(v) for v in values) + ")")

