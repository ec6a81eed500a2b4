"""Streams of phenology notifications: change detection per parcel, rules, idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harrow.operators import rules as R

NOTIFICATION = "tenant string, type string, parcel_id long, stage string, ts timestamp, value double, species string"


def read_notifications(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """JSON notifications as a stream; malformed lines, other types, and rows without parcel or stage are left out."""
    rows = spark.readStream.schema(NOTIFICATION).option("maxFilesPerTrigger", max_files).json(folder)
    return valid(rows)


def valid(rows: DataFrame, kind: str = "CropStatus") -> DataFrame:
    return rows.where((F.col("type") == kind) & F.col("parcel_id").isNotNull() & F.col("stage").isNotNull())


def stage_changes(rows: DataFrame, ttl: str = "400 days", lateness: str = "1 day") -> DataFrame:
    """Rows whose stage differs from the parcel's last one, in event order within a batch; state per tenant and parcel.

    State goes after ``ttl`` without a notification, so it doesn't grow without end.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(batches)  # one key's rows of one micro-batch
        rows_ = pd.concat(frames).sort_values(["ts", "stage"])
        last = state.get[0] if state.exists else None
        before = rows_["stage"].shift(fill_value="" if last is None else last)
        keep = rows_["stage"] != before
        if last is None and len(keep):
            keep.iloc[0] = True
        state.update((rows_["stage"].iloc[-1],))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows_["ts"].max().timestamp() * 1000)) + ttl_ms)
        yield rows_[keep]

    return (
        rows.withWatermark("ts", lateness)
        .groupBy("tenant", "parcel_id")
        .applyInPandasWithState(changed, NOTIFICATION, "stage string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def enriched(rows: DataFrame, crops: DataFrame, today: str | None = None) -> DataFrame:
    """Notifications (a stream or a table) with what is known of their parcel's crop; parcels without a crop keep nulls.

    ``crops``: parcel_id, role, status, termination_method, sowing_start; one row a parcel. Spark reads the static side
    again for each micro-batch. days_until_sowing counts from ``today``, the current date by default.
    """
    now = F.lit(today).cast("date") if today else F.current_date()
    named = crops.select("parcel_id", "role", "status", "termination_method", F.datediff(F.col("sowing_start"), now).alias("days_until_sowing"))
    return rows.join(named, "parcel_id", "left")


def batch_stage_changes(rows: DataFrame, keys: list[str], order: list[str], stage: str = "stage") -> DataFrame:
    """The same over a whole table: rows whose stage differs from the one before."""
    from pyspark.sql import Window

    before = F.lag(stage).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col(stage)))


def upsert_advisories(spark: SparkSession, path: str, rules: list[dict], tenant: str):  # noqa: ANN201
    """A foreachBatch function: rules over a batch of changes, written to a folder per batch so that a replay overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = R.advisories(R.match_rules(batch, rules), tenant, ["stage", "value", "species"])
        found.dropDuplicates(["advisory_id"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_advisories(spark: SparkSession, source: str, sink: str, checkpoint: str, rules: list[dict], tenant: str) -> StreamingQuery:
    """All available notifications -> changes -> advisories; the checkpoint makes a restart go on where it stopped."""
    changes = stage_changes(read_notifications(spark, source))
    writer = changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(upsert_advisories(spark, sink, rules, tenant)).start()


def latest_advisories(spark: SparkSession, path: str) -> DataFrame:
    """One row per advisory id, of the latest batch that wrote it."""
    return spark.read.parquet(path).groupBy("advisory_id").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").drop("batch")


def recent_alerts(events: DataFrame, since: str, limit: int | None = None) -> DataFrame:
    """Newest alerts since a time with the stage that was last reported for their parcel before; other times are left out.

    ``events``: event_id, ts, parcel_id, kind, stage (null unless reported), value.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("parcel_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = events.withColumn("carried_stage", F.last("stage", ignorenulls=True).over(order))
    alerts = carried.where((F.col("kind") == "alert") & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    return alerts.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit) if limit else alerts


def bounded_history(events: DataFrame, keys: list[str], keep: int = 50) -> DataFrame:
    """The newest ``keep`` entries of each key, as a log of bounded length shows them."""
    from pyspark.sql import Window

    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= keep)
