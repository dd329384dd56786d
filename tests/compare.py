"""Order-insensitive comparison of Spark and DuckDB results."""

import numbers

import pandas as pd


def _value(v):
    if pd.isna(v):
        return None
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return float(v)
    return str(v)


def canonical(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_value, row)) for row in frame[columns].itertuples(index=False)), key=repr)


def assert_same(spark_frame, duck_frame):
    a, b = canonical(spark_frame), canonical(duck_frame)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
