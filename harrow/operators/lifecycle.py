"""Crop plans as a state machine over an event log: the same moves over a table and over a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["parcel_id", "season"]
EVENT = [*KEYS, "seq", "event_id", "ts", "action", "method"]
STATE = "status string, method string, planted timestamp, ended timestamp"
#: ``kind`` is segment (where a segment of a plan stands) or refused (a move that isn't allowed, and why).
OUTCOME = f"kind string, parcel_id long, season string, seq int, event_id long, action string, reason string, {STATE}"
COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]

Segments = dict[int, dict[str, Any]]


def move(segments: Segments, seq: int, action: str, method: str | None, ts: Any) -> str | None:
    """Makes an allowed move in the segments of a parcel's season; why not, if it isn't allowed.

    A segment is planned (again, as long as it isn't sown), sown by advance, which ends whatever else is active there, then
    finished; a planned one may be cleared. An ended segment is harvested if that is its method, else terminated.
    """
    own = segments.get(seq)
    status = own["status"] if own else None
    if action == "plan" and status in (None, "planned", "cleared"):
        segments[seq] = {"status": "planned", "method": method, "planted": None, "ended": None}
    elif action == "advance" and status in ("planned", "active"):
        for other, segment in segments.items():
            if other != seq and segment["status"] == "active":
                _end(segment, ts)
        own.update(status="active", planted=ts)
    elif action == "finish" and status == "active":
        _end(own, ts)
    elif action == "clear" and status == "planned":
        own["status"] = "cleared"
    else:
        return "unknown action" if action not in ("plan", "advance", "finish", "clear") else f"segment is {status or 'missing'}"
    return None


def _end(segment: dict[str, Any], ts: Any) -> None:
    segment.update(status="harvested" if segment["method"] == "harvest" else "terminated", ended=ts)


def _segment(key: tuple, seq: int, s: dict[str, Any]) -> tuple:
    return ("segment", *key, seq, None, None, None, s["status"], s["method"], s["planted"], s["ended"])


def _refused(key: tuple, seq: int | None, event_id: int, action: str, reason: str) -> tuple:
    return ("refused", *key, seq, event_id, action, reason, None, None, None, None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS)
    return frame.astype({"parcel_id": "Int64", "seq": "Int32", "event_id": "Int64", "planted": "datetime64[us]", "ended": "datetime64[us]"})


def _known(value: Any) -> Any:
    return None if pd.isna(value) else value


def plan_outcomes(events: DataFrame) -> DataFrame:
    """Rows of ``OUTCOME``: every segment's state after all events, and every refused move.

    ``events``: parcel_id, season, seq, event_id, ts, action, method. Moves are made in order of ts, then event_id. Events without parcel,
    season, seq or ts are refused as incomplete; an empty log gives no rows; a repeated event is a move of its own.

    Events are dealt by parcel and season, sorted, and read once in that order; a task holds one season's segments and a batch of
    events at a time, so a long log is never gathered.
    """
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ("parcel_id", "season", "seq", "ts"))
    log = events.select(*EVENT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        segments: Segments = {}
        for batch in batches:
            out: list[tuple] = []
            for parcel, season, seq, event_id, ts, action, method in batch.itertuples(index=False):
                if (parcel, season) != key:
                    out += [_segment(key, n, s) for n, s in segments.items()]
                    key, segments = (parcel, season), {}
                if reason := move(segments, seq, _known(action), _known(method), ts):
                    out.append(_refused(key, seq, event_id, _known(action), reason))
            yield _frame(out)
        yield _frame([_segment(key, n, s) for n, s in segments.items()])

    made = log.where(whole).repartition(*KEYS).sortWithinPartitions(*KEYS, "ts", "event_id").mapInPandas(run, OUTCOME)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in STATE.split(", "))]
    lost = log.where(f"NOT ({whole})").select(F.lit("refused").alias("kind"), *KEYS, "seq", "event_id", "action", F.lit("incomplete").alias("reason"), *empty)
    return made.unionByName(lost)


class PlanProcessor(StatefulProcessor):
    """Segments of one parcel's season, kept between micro-batches until ``keep_ms`` after its last event."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.segments = handle.getMapState("segments", "seq int", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # one season's events of one micro-batch
        held: Segments = {k[0]: dict(zip(("status", "method", "planted", "ended"), v, strict=True)) for k, v in self.segments.iterator()}
        before = {n: dict(s) for n, s in held.items()}
        out = []
        for seq, event_id, ts, action, method in batch[["seq", "event_id", "ts", "action", "method"]].itertuples(index=False):
            if reason := move(held, int(seq), _known(action), _known(method), ts):
                out.append(_refused(key, int(seq), event_id, _known(action), reason))
        for seq, s in held.items():
            if before.get(seq) != s:
                self.segments.updateValue((seq,), tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in s.values()))
                out.append(_segment(key, seq, s))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(batch["ts"].max().timestamp() * 1000)) + self.keep_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.segments.clear()
        return iter(())

    def close(self) -> None:
        pass


def plan_stream(events: DataFrame, lateness: str = "7 days", keep: str = "400 days") -> DataFrame:
    """The same over a stream: each changed segment and each refused move of a micro-batch, events in order within it.

    State goes ``keep`` after a season's last event. Events later than the watermark are still moves; in which micro-batch an event comes
    decides the order beyond that. Needs Spark's RocksDB state store.
    """
    whole = events.select(*EVENT).dropna(subset=["parcel_id", "season", "seq", "ts"]).withWatermark("ts", lateness)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return whole.groupBy(*KEYS).transformWithStateInPandas(PlanProcessor(keep_ms), OUTCOME, "Update", "EventTime")


def season_bounds(segments: DataFrame) -> DataFrame:
    """parcel_id, season, starts, ends: the first sowing and the last expected end of a plan's segments."""
    return segments.groupBy(*KEYS).agg(F.min("sowing_start").alias("starts"), F.max("expected_end").alias("ends"))
