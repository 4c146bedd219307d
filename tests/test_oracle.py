"""Every catalogue query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF01

NAMES = sorted(entry.oracle_sql())


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v)
                          else repr(round(float(v), 6)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF01).toPandas()
    exp = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    pd.testing.assert_frame_equal(_norm(got), _norm(exp), check_dtype=False)
