"""Catalogue and quality figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def available_crops(trials: DataFrame) -> DataFrame:
    """Per crop: varieties, trials and the span of years."""
    return trials.groupBy("crop").agg(
        F.count_distinct("variety_norm").alias("varieties"), F.count_distinct("trial_id").alias("trials"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def site_summary(sites: DataFrame, links: DataFrame, trials: DataFrame) -> DataFrame:
    """Per site, trials or none: distinct trials and crops, each side aggregated before the join."""
    per_site = links.join(trials.select("trial_id", "crop").distinct(), "trial_id").groupBy("site_id").agg(
        F.count_distinct("trial_id").alias("trials"), F.count_distinct("crop").alias("crops")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return sites.select("site_id", "name", "climate_class").join(per_site, "site_id", "left").select("site_id", "name", "climate_class", zero("trials"), zero("crops"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table with its number of rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows_n")).select(F.lit(n).alias("label"), "rows_n") for n, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def quality(trials: DataFrame, sites: DataFrame, links: DataFrame, name_key: str = "municipality") -> DataFrame:
    """One row: trials, those with yield, orphans, links, sites, repeated names, sites without class, distinct sources."""
    ids = trials.groupBy("trial_id").agg(F.max("yield_kg_ha").alias("y"))
    linked = links.select("trial_id").distinct()
    parts = [
        ids.agg(F.count(F.lit(1)).alias("trials"), F.count("y").alias("with_yield")),
        ids.join(linked, "trial_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans")),
        links.agg(F.count(F.lit(1)).alias("links")),
        sites.agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.col("climate_class").isNull()).alias("unclassified")),
        sites.groupBy(F.lower(F.trim(name_key)).alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("repeated_names")),
        trials.agg(F.count_distinct("source_id").alias("sources")),
    ]
    row = reduce(DataFrame.crossJoin, parts)  # six tables of one row each
    return row.withColumn("yield_pct", F.round(F.lit(100.0) * F.col("with_yield") / F.nullif(F.col("trials"), F.lit(0)), 1))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The non-empty values of a column in order."""
    return df.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def coverage(species: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: species, those that a reference table knows, and their share in percent."""
    marked = species.select(key).distinct().join(known.select(key, F.lit(1).alias("hit")).distinct(), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("known")).withColumn(
        "pct", F.round(F.lit(100.0) * F.col("known") / F.nullif(F.col("total"), F.lit(0)), 1)
    )


def stale(known: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that no module publishes any more."""
    return known.join(published.select(*keys).distinct(), keys, "left_anti")


def resolve_alias(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Canonical name ``slug`` of any identifier: exact match first, then case-insensitive; null if unknown.

    ``aliases`` has alias and slug. Ties go to the smallest slug.
    """
    exact = aliases.groupBy(F.col("alias").alias(column)).agg(F.min("slug").alias("exact_slug"))
    loose = aliases.groupBy(F.lower("alias").alias("__lower")).agg(F.min("slug").alias("loose_slug"))
    return (
        df.join(exact, column, "left")
        .withColumn("__lower", F.lower(column))
        .join(loose, "__lower", "left")
        .withColumn("slug", F.coalesce("exact_slug", "loose_slug"))
        .drop("__lower", "exact_slug", "loose_slug")
    )
