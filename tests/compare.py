"""Rows of Spark and DuckDB in one form."""

import datetime
import decimal
import math

import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.7g}")
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (pd.Timestamp, datetime.datetime, datetime.date)):
        return str(pd.Timestamp(v).tz_localize(None))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(spark_df, con, sql: str) -> None:
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
