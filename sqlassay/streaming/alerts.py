"""Alerts over a live stream of check results.

The state of a check is one small row, kept in the state store and checkpointed, so a
restart goes on where it stopped. Within a batch the rows of a check are taken in order
of ``(ts, event_id)``; what arrives older than the last accepted row is counted as late,
told in the same output and not applied.

Settings come from a table, per check and version, and stay in the state, so that timers know them. With a watermark,
reminders are due without a new row as well, and the state of a check that went quiet is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sqlassay.functions.times import HOUR, SECOND, micros
from sqlassay.operators.alerts import DISABLED, FAILURE, OK, RATE_LIMITED, RECOVERY, REMINDER, CheckSettings, with_settings

# The fields are part of every checkpoint; extend them at the end only.
STATE = (
    "last_at bigint, last_event bigint, next_allowed bigint, message_key string, "
    "onset bigint, last_reminder bigint, late bigint, version bigint, interval bigint, cooldown bigint, remind_after bigint, recover boolean"
)
OUTPUT = "check_id bigint, event_id bigint, at bigint, kind string, status string, message_key string, late_rows bigint"
NAMES = ["check_id", "event_id", "at", "kind", "status", "message_key", "late_rows"]
LATE = "LATE"
NEVER = -(2**62)
MILLI = 1000  # microseconds


class _AlertProcessor(StatefulProcessor):
    """One check: accept or ignore each row, then alert, remind or recover."""

    def __init__(self, timers: bool, forget_after: int | None):
        self.timers, self.forget_after = timers, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("check", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last_at, last_event, allowed, current, onset, reminded, late, known, *setting = self.state.get()
        else:
            last_at, last_event, allowed, current, onset, reminded, late, known, setting = NEVER, -1, NEVER, None, 0, 0, 0, NEVER, None
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        found = []
        columns = ("event_id", "at", "enabled", "status", "message_key", "version", "interval", "cooldown", "remind_after", "recover")
        for event_id, at, enabled, status, message, version, *given in zip(*[batch[c] for c in columns]):
            if version >= known:
                known, setting = version, given
            interval, cooldown, remind_after, recover = setting
            if self.timers and at > last_at:
                # What was due before this row, wherever batches end.
                times, over = self._due(at - 1, last_at, current, reminded, remind_after)
                found += [(key[0], None, t, REMINDER, None, current, late) for t in times]
                reminded = times[-1] if times else reminded
                if over:
                    last_at, last_event, allowed, current, late = NEVER, -1, NEVER, None, 0
            if (at, event_id) <= (last_at, last_event):
                late += 1
                found.append((key[0], event_id, at, LATE, status, None, late))
                continue
            if not enabled:
                last_at, last_event, current, status = at, event_id, None, DISABLED
                continue
            if at < allowed:
                continue
            last_at, last_event = at, event_id
            allowed = at + (max(interval, cooldown) if status == RATE_LIMITED else interval)
            kind = None
            if status == OK:
                if current is not None and recover:
                    kind = RECOVERY
                current, message = None, None
            elif message != current:
                kind, current, onset, reminded = FAILURE, message, at, at
            elif at - reminded >= remind_after:
                kind, reminded = REMINDER, at
            if kind:
                found.append((key[0], event_id, at, kind, status, message, late))
        interval, cooldown, remind_after, recover = setting
        numbers = [int(x) for x in (last_at, last_event, allowed)], [int(x) for x in (onset, reminded, late, known, interval, cooldown, remind_after)]
        self.state.update((*numbers[0], current, *numbers[1], bool(recover)))
        self._set_timers(last_at, current, reminded, remind_after)
        yield pd.DataFrame(found, columns=NAMES)

    def _due(self, upto: int, last_at: int, current: str | None, reminded: int, remind_after: int) -> tuple[list[int], bool]:
        """Times of reminders without a row, up to a time, and whether the check is forgotten by then."""
        end = None if self.forget_after is None or last_at == NEVER else last_at + self.forget_after
        over = end is not None and end <= upto
        last = end if over else upto
        lasting = current is not None and remind_after > 0
        return list(range(int(reminded + remind_after), int(last) + 1, int(remind_after))) if lasting else [], over

    def _set_timers(self, last_at: int, current: str | None, reminded: int, remind_after: int) -> None:
        """For the next reminder that is due without a row, and for the end of the state."""
        if not self.timers:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if current is not None and remind_after > 0:
            self.handle.registerTimer(-(-int(reminded + remind_after) // MILLI))
        if self.forget_after is not None and last_at != NEVER:
            self.handle.registerTimer(-(-int(last_at + self.forget_after) // MILLI))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = []
        if self.state.exists():
            values = list(self.state.get())
            last_at, current, reminded, late, remind_after = values[0], values[3], values[5], values[6], values[10]
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * MILLI
            times, over = self._due(now, last_at, current, reminded, remind_after)
            found = [(key[0], None, t, REMINDER, None, current, late) for t in times]
            if over:
                self.state.clear()
            else:
                values[5] = times[-1] if times else reminded
                self.state.update(tuple(values))
                self._set_timers(last_at, current, values[5], remind_after)
        yield pd.DataFrame(found, columns=NAMES)

    def close(self) -> None:
        pass


def newest(settings: DataFrame) -> DataFrame:
    """The settings of each check with the highest ``version``; without that column all are version 0."""
    if "version" not in settings.columns:
        return settings.withColumn("version", F.lit(0).cast("bigint"))
    others = [c for c in settings.columns if c not in ("check_id", "version")]
    best = settings.groupBy("check_id").agg(F.max_by(F.struct(*others), "version").alias("best"), F.max("version").cast("bigint").alias("version"))
    return best.select("check_id", "version", "best.*")


def stream_events(
    classified: DataFrame,
    default: CheckSettings = CheckSettings(),
    settings: DataFrame | None = None,
    late_after: str | None = None,
    forget_after_hours: float | None = None,
) -> DataFrame:
    """FAILURE, REMINDER, RECOVERY and LATE rows of a classified stream, in one output.

    ``settings`` (check_id, any of the fields of ``CheckSettings``, version) holds for the checks it names. A version
    that a check has seen is not undone by an older one. With ``late_after``, the watermark's delay, an error that lasts is reminded of in event time without
    a row (event_id is then null) and a check without rows for ``forget_after_hours`` is forgotten; rows later than the watermark are
    dropped by Spark and not told.
    """
    if forget_after_hours is not None and late_after is None:
        raise ValueError("state is dropped in event time: late_after is needed too")
    rows = classified.withColumn("at", micros(classified, "ts"))
    if settings is None:
        rows = with_settings(rows, None, default).withColumn("version", F.lit(0).cast("bigint"))
    else:
        settings = newest(settings)
        present = [c for c in settings.columns if c != "check_id" and c != "version"]
        version = settings.select(F.col("check_id").alias("_check"), "version")
        rows = with_settings(rows.drop(*present, "version"), settings, default)
        rows = rows.join(version, rows["check_id"] == version["_check"], "left").withColumn("version", F.coalesce("version", F.lit(0).cast("bigint")))
    slim = rows.select(
        "check_id", "event_id", "at", "enabled", "status", "message_key", "version",
        (F.col("interval_seconds").cast("bigint") * SECOND).alias("interval"),
        (F.col("rate_limit_cooldown_seconds").cast("bigint") * SECOND).alias("cooldown"),
        (F.col("reminder_interval_hours").cast("bigint") * HOUR).alias("remind_after"),
        F.col("send_recovery_email").alias("recover"),
        *([F.timestamp_micros("at").alias("event_time")] if late_after else []),
    )
    if late_after:
        slim = slim.withWatermark("event_time", late_after)
    forget_after = None if forget_after_hours is None else int(forget_after_hours * HOUR)
    return slim.groupBy("check_id").transformWithStateInPandas(
        statefulProcessor=_AlertProcessor(late_after is not None, forget_after),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime" if late_after else "None",
    )


def stream_alerts(classified: DataFrame, default: CheckSettings = CheckSettings(), settings: DataFrame | None = None, **options) -> DataFrame:
    """FAILURE, REMINDER and RECOVERY rows of a classified stream."""
    return stream_events(classified, default, settings, **options).filter(F.col("kind") != LATE)


def late_checks(classified: DataFrame, default: CheckSettings = CheckSettings(), settings: DataFrame | None = None, **options) -> DataFrame:
    """Rows older than their check's last accepted one, with the running count per check."""
    return stream_events(classified, default, settings, **options).filter(F.col("kind") == LATE)
