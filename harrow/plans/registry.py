"""Where queries and their SQL are kept, and tables for SQL that is written once for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrow.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, folder) under its name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bound(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL in which ``{name}`` stands for a folder's table; no view is left in the session."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def oracle(text: str) -> str:
    """The same SQL for an engine that has the tables under their names."""
    return text.format_map({t: t for t in TABLES})


def plain(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL that names the folder's tables as they are; no view is left in the session."""
    return bound(spark, sf_dir, re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", text))
