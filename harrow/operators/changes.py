"""Change feeds of a catalogue: what differs between two snapshots, and applying it in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, keys: list[str], version: int, unchanged: bool = False) -> DataFrame:
    """The keys, kind (insert, update, delete, and same if asked for), version, and a struct ``row`` of the new columns, null for a delete.

    Both snapshots have the same columns and each key once. Rows are compared whole, null equal to null; one shuffle by key.
    """
    values = [c for c in new.columns if c not in keys]
    left = old.select(*keys, F.struct(*values).alias("old_row"))
    right = new.select(*keys, F.struct(*values).alias("row"))
    kind = (
        F.when(F.col("old_row").isNull(), "insert").when(F.col("row").isNull(), "delete").when(F.col("old_row").eqNullSafe(F.col("row")), "same").otherwise("update")
    )
    rows = left.join(right, keys, "full_outer").select(*keys, kind.alias("kind"), F.lit(version).cast("long").alias("version"), "row")
    return rows if unchanged else rows.where("kind <> 'same'")


def applied(catalogue: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, ``row``, deleted and version after a feed of one or more versions of :func:`changes`.

    ``catalogue`` has these columns already. Of a key's changes the one of the highest version counts, and only if it is newer
    than what the catalogue has; so a feed may come twice, late, or in parts, and the outcome is the same. A deleted key stays as
    a tombstone without a row, which keeps late changes of lower versions from bringing it back.
    """
    newest = feed.where("kind <> 'same'").groupBy(*keys).agg(F.max_by(F.struct("row", (F.col("kind") == "delete").alias("deleted"), "version"), "version").alias("new"))
    old = catalogue.select(*keys, F.struct("row", "deleted", "version").alias("old"))
    chosen = F.when(F.col("old").isNull() | (F.col("new.version") > F.col("old.version")), F.col("new")).otherwise(F.col("old"))
    return old.join(newest, keys, "full_outer").withColumn("now", chosen).select(*keys, "now.*")


def live(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """The catalogue's rows without tombstones, as columns."""
    return catalogue.where("NOT deleted").select(*keys, "row.*")


def crop_records(entities: DataFrame) -> DataFrame:
    """uri, name, scientific_name, provider, kc_ini, kc_mid, kc_end, kc_source, heat_c, frost_c, thermal_source of crop entities.

    The coefficients of mid and end of the season are those of its start where missing, or zero; a threshold of zero counts as
    unknown; sources have defaults where there is something to have a source.
    """
    nonzero = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    ini = F.col("kc_ini").cast("double")
    thermal = F.col("heat_c").isNotNull() | F.col("frost_c").isNotNull()
    return entities.select(
        "uri", "name", "scientific_name", "provider", ini.alias("kc_ini"), *(F.when(ini.isNotNull(), F.coalesce(nonzero(c), ini)).alias(c) for c in ("kc_mid", "kc_end")),
        F.when(ini.isNotNull(), F.coalesce("kc_source", F.lit("Unknown"))).alias("kc_source"), nonzero("heat_c").alias("heat_c"), nonzero("frost_c").alias("frost_c"),
        F.when(thermal, F.coalesce("thermal_source", F.lit("derived"))).alias("thermal_source"),
    )


def sub_crops(entities: DataFrame) -> DataFrame:
    """uri, variety_uri: each crop's varieties once."""
    return entities.select("uri", F.explode("varieties").alias("variety_uri")).where("variety_uri IS NOT NULL").distinct()
