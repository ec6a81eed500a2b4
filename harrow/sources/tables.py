"""The domain's tables, bound to the star-schema parquet tables of a folder.

Every column is a fixed expression that Spark SQL and ANSI SQL read alike, so that the same text defines the
DataFrame and the view that a query's SQL starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = {
    "site_id": "s_suppkey",
    "name": "s_name",
    "municipality": "n_name",
    "climate_class": "r_name",
    "soil_type": "CASE s_suppkey % 4 WHEN 0 THEN 'Calcic Cambisol' WHEN 1 THEN 'Vertisol' WHEN 2 THEN NULL ELSE 'Haplic Luvisol' END",
    "soil_texture": "CASE s_suppkey % 5 WHEN 0 THEN 'clay' WHEN 1 THEN 'loam' WHEN 2 THEN 'sandy_loam' WHEN 3 THEN 'Silty-Clay' ELSE NULL END",
    "soil_ph": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 4.5 + (s_suppkey * 3) % 45 / 10.0 END",
    "rainfall": "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 300 + (s_suppkey * 37) % 900 END",
    "et0": "CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE 600 + (s_suppkey * 53) % 800 END",
    "frost_days": "(s_suppkey * 7) % 90",
    "elevation": "(s_suppkey * 131) % 1800",
    "latitude": "CAST(-60 + (s_suppkey * 17) % 120 AS DOUBLE)",
    "longitude": "CAST(-180 + (s_suppkey * 29) % 360 AS DOUBLE)",
}
TRIAL = {
    "trial_id": "concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS BIGINT) AS STRING))",
    "crop": "p_type",
    "variety": "p_name",
    "variety_norm": "upper(p_name)",
    "year": "CAST(year(l_shipdate) AS INT)",
    "yield_kg_ha": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 100 END",
    "note": "CASE WHEN l_linenumber IN (2, 7) THEN 1 + CAST(l_quantity AS INT) % 9 END",
    "regime": "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_linestatus END",
    "production": "CASE WHEN p_size % 3 = 0 THEN 'organic' ELSE 'conventional' END",
    "derived": "l_returnflag = 'R'",
    "eligible": "CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax > 0.07 THEN FALSE ELSE TRUE END",
    "source_id": "concat('SRC', CAST(l_linenumber AS STRING))",
    "confidence": "CASE WHEN l_discount < 0.03 THEN 'high' WHEN l_discount < 0.07 THEN 'medium' ELSE 'low' END",
    "site_id": "l_suppkey",
    "second_site_id": "CASE WHEN l_linenumber = 3 AND l_suppkey > 1 THEN l_suppkey - 1 END",
}


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


#: Views for a query's SQL: put ``WITH`` and these before it.
SITE_SQL = "trial_site AS (" + _sql(SITE, "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey") + ")"
TRIAL_SQL = "variety_trial AS (" + _sql(TRIAL, "lineitem JOIN part ON l_partkey = p_partkey") + ")"
LINK_SQL = """trial_at AS (
    SELECT DISTINCT trial_id, site_id FROM variety_trial
    UNION SELECT trial_id, second_site_id FROM variety_trial WHERE second_site_id IS NOT NULL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def trial_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return _select(joined, SITE)


def variety_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record; records of one trial may repeat, and a trial may link to two sites."""
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return _select(lineitem.join(part, lineitem.l_partkey == part.p_partkey), TRIAL)


def trial_links(trials: DataFrame) -> DataFrame:
    """The many-to-many edge table (trial_id, site_id), from one scan; it lies by trial, so joins by trial needn't move it again."""
    sites = F.explode(F.array_compact(F.array("site_id", "second_site_id")))
    return trials.select("trial_id", sites.alias("site_id")).repartition("trial_id").distinct()
