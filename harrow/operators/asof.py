"""What was last known before a moment, per key, without a range join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.sources.scratch import written


def last_before(moments: DataFrame, known: DataFrame, keys: list[str], ts: str, order: str, into: str = "last", span_days: int = 30, hot_rows: int = 1_000_000) -> DataFrame:
    """``moments`` with a struct ``into`` of the row of ``known`` that is last before each by ``ts``; null where there is none.

    Both have ``keys`` and ``ts``; ``order`` tells rows of ``known`` at the same time apart, the largest is last. A row at the very
    time of a moment isn't before it. Rows with a null key or time are never known and know nothing; moments keep all rows.

    Both are put together and dealt by key, and the last row is carried on by a window. Keys with more than ``hot_rows`` rows, of which
    there are few, are dealt by stretches of time too, so a key with a third of all rows is spread; what earlier stretches end
    with is one row each, and is carried on over these rows alone.
    """
    other = lambda df: [c for c in df.columns if c not in (*keys, ts)] or [ts]
    told = known.dropna(subset=[*keys, ts]).select(*keys, F.col(ts).alias("at"), F.col(order).alias("tie"), F.struct(*other(known)).alias("row"))
    told = written(told, "told")
    able = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*keys, ts)))
    rows = moments.where(able).select(*keys, F.col(ts).alias("at"), F.struct(*other(moments)).alias("moment"))
    counts = told.select(*keys).unionByName(rows.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.where(F.col("n") > hot_rows).select(*keys, F.lit(True).alias("hot")), "hot-keys")
    told = told.withColumn("last", F.struct("at", "row"))
    rows = rows.select(*keys, "at", F.lit(0).alias("kind"), F.lit(None).cast(dict(told.dtypes)["tie"]).alias("tie"), "moment", F.lit(None).cast(told.schema["last"].dataType).alias("last"))
    both = rows.unionByName(told.select(*keys, "at", F.lit(1).alias("kind"), "tie", F.lit(None).cast(rows.schema["moment"].dataType).alias("moment"), "last"))
    some_hot = not hot.isEmpty()
    dealt = list(keys)
    if some_hot:
        both = both.join(F.broadcast(hot), keys, "left").withColumn("stretch", F.when(F.col("hot"), F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / (86400 * span_days))))
        dealt.append("stretch")
    inside = Window.partitionBy(*dealt).orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("own", F.last("last", ignorenulls=True).over(inside)).where("kind = 0")
    if some_hot:
        spread = both.where("hot")
        ends = spread.where("kind = 1").groupBy(*dealt).agg(F.max_by("last", F.struct("at", "tie")).alias("end"))
        asked = spread.where("kind = 0").select(*dealt).distinct()
        before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = asked.join(ends, dealt, "full_outer").withColumn("carried", F.last("end", ignorenulls=True).over(before)).select(*dealt, "carried")
        found = found.join(carried, dealt, "left").withColumn("own", F.coalesce("own", "carried"))
    value = lambda c: F.col(c) if c in keys else F.col("own.at") if c == ts else F.col(f"own.row.{c}")
    own = {c: F.col(c) if c in keys else F.col("at") if c == ts else F.col(f"moment.{c}") for c in moments.columns}
    found = found.select(*(v.alias(c) for c, v in own.items()), F.when(F.col("own").isNotNull(), F.struct(*(value(c).alias(c) for c in known.columns))).alias(into))
    return found.unionByName(moments.where(~able).withColumn(into, F.lit(None).cast(found.schema[into].dataType)))


def crop_context(parcels: DataFrame, assessments: DataFrame, crops: DataFrame, span_days: int = 30) -> DataFrame:
    """Each parcel and moment with its crop's reference figures and the last assessment of its soil before that moment.

    ``parcels``: parcel_id, species, variety, management, ts; ``assessments``: assessment_id, parcel_id, species, ts and the four soil figures;
    ``crops``: species and what is known of it, one row each. ``sensors_available`` says whether the last assessment has any
    figure, and ``source`` where the crop's figures come from: the variety under its management, the variety, the species, or a default.
    """
    figures = ["ph", "ec", "moisture", "temperature"]
    known = last_before(parcels, assessments, ["parcel_id", "species"], "ts", "assessment_id", "soil", span_days)
    joined = known.join(crops.withColumn("listed", F.lit(True)), "species", "left")
    parts = F.when(F.col("variety").isNotNull() & F.col("management").isNotNull(), F.concat(F.lit("variety:"), "variety", F.lit(":management:"), "management"))
    source = F.when(F.col("listed"), F.coalesce(parts, F.concat(F.lit("variety:"), "variety"), F.concat(F.lit("species:"), "species"))).otherwise("default")
    any_known = F.coalesce(*(F.col(f"soil.{f}").cast("double") for f in figures)).isNotNull()
    return joined.select(
        "parcel_id", "species", "ts", "variety", "management", *(c for c in crops.columns if c != "species"), source.alias("source"), any_known.alias("sensors_available"),
        F.when(any_known, F.col("soil.ts")).alias("last_reading"), *(F.col(f"soil.{f}").alias(f) for f in figures),
    )
