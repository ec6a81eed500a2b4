"""Rows of a query and of its SQL in a form that can be compared."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def plain(value):  # noqa: ANN001, ANN201
    """Numbers by value, nested values as tuples; doubles to ten significant digits."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, int | float) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.10g}")
    return str(value)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())
