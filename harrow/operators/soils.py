"""Soil by depth: figures of asked depth ranges from horizons that overlap them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Organic matter for a share of organic carbon (fixed value).
MATTER_OF_CARBON = 1.724


def range_means(horizons: DataFrame, ranges: DataFrame, figures: list[str], nodata: float = -9999.0) -> DataFrame:
    """parcel_id, top, bottom, the figures, covered: means of the horizons that overlap each range, by the thickness that does.

    ``horizons``: parcel_id, depth_from, depth_to and figures; ``ranges``: parcel_id, top, bottom; depths in centimetres. A missing
    upper bound is the surface; a horizon without lower bound, or of no thickness, and a range of none meet nothing. A figure
    that is null or ``nodata`` takes no part in its own mean. Horizons that overlap each other count each. ``covered`` is the
    thickness met by horizons in centimetres, once where several lie over each other; a range that meets none has nulls and 0.

    A join on the parcel, in which only overlapping pairs are kept; sums are made before the shuffle by range.
    """
    layers = horizons.select("parcel_id", F.coalesce("depth_from", F.lit(0.0)).cast("double").alias("depth_from"), F.col("depth_to").cast("double").alias("depth_to"), *figures).where("depth_to > depth_from")
    asked = ranges.select("parcel_id", "top", "bottom").distinct()
    met = asked.join(layers, "parcel_id").where("depth_from < bottom AND depth_to > top AND top < bottom").select(
        "parcel_id", "top", "bottom", *figures, F.greatest("depth_from", F.col("top").cast("double")).alias("lo"), F.least("depth_to", F.col("bottom").cast("double")).alias("hi")
    )
    thick = F.col("hi") - F.col("lo")
    value = {f: F.when(F.col(f) != nodata, F.col(f).cast("double")) for f in figures}
    keys = ["parcel_id", "top", "bottom"]
    means = met.groupBy(*keys).agg(*(F.try_divide(F.sum(v * thick), F.sum(F.when(v.isNotNull(), thick))).alias(f) for f, v in value.items()))
    before = F.max("hi").over(Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    pieces = met.select(*keys, "lo", "hi").distinct().withColumn("from", F.greatest(F.col("lo"), F.coalesce(before, F.col("lo"))))
    covered = pieces.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), F.col("hi") - F.col("from"))).alias("covered"))
    return asked.join(means, keys, "left").join(covered, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def available_water(horizons: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """parcel_id, awc_mm: water between field capacity and wilting point over all horizons; null where none is known or the sum isn't above zero."""
    clean = lambda c: F.when(F.col(c) != nodata, F.col(c).cast("double"))
    held = (clean("field_capacity") - clean("wilting_point")) * (F.col("depth_to") - F.coalesce("depth_from", F.lit(0.0))) * 10
    total = F.round(F.sum(F.coalesce(held, F.lit(0.0))), 1)
    return horizons.groupBy("parcel_id").agg(F.when(total > 0, total).alias("awc_mm"))


def first_horizon(horizons: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """parcel_id, depth_from, depth_to, ph, organic_matter_pct: the uppermost horizon, the deeper one of two that begin together."""
    clean = lambda c: F.when(F.col(c) != nodata, F.col(c).cast("double"))
    row = F.struct(F.coalesce("depth_from", F.lit(0.0)).cast("double").alias("depth_from"), (-F.col("depth_to").cast("double")).alias("up"), F.col("ph"), F.col("organic_carbon"))
    top = horizons.where("depth_to IS NOT NULL").groupBy("parcel_id").agg(F.min(row).alias("h")).select("parcel_id", "h.*")
    return top.select("parcel_id", "depth_from", (-F.col("up")).alias("depth_to"), clean("ph").alias("ph"), F.round(clean("organic_carbon") * MATTER_OF_CARBON, 2).alias("organic_matter_pct"))
