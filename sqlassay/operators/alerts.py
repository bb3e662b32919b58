"""Health checks to alerts, reminders and recoveries, in batch.

Input rows: ``check_id, event_id, ts, response, expected, error, latency, tokens_in,
tokens_out`` (``http_status`` for HTTP checks). A check's rows are ordered by
``(ts, event_id)``. A check may hold any share of all rows: everything ordered runs in
time chunks (see ``ordered``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.functions.cells import half_even
from sqlassay.functions.times import DAY, HOUR, SECOND, micros
from sqlassay.operators.ordered import measured_span, previous_row, running_sums, spaced
from sqlassay.session import landed

OK, ERROR, RATE_LIMITED, DISABLED = "OK", "ERROR", "RATE_LIMITED", "DISABLED"
FAILURE, REMINDER, RECOVERY = "FAILURE", "REMINDER", "RECOVERY"


@dataclass(frozen=True)
class CheckSettings:
    """Settings of a check where no settings table names others."""

    enabled: bool = True
    interval_seconds: int = 60
    rate_limit_cooldown_seconds: int = 300
    reminder_interval_hours: int = 24
    send_recovery_email: bool = True


# --- status of one check result -----------------------------------------------------


def classify(checks: DataFrame) -> DataFrame:
    """Add ``status``, ``message``, ``message_key`` and ``details``.

    The message tells latency and tokens; the key leaves them out, so that the same fault
    with another latency is still the same fault.
    """
    return checks.withColumns(status_columns())


def status_columns() -> dict[str, Column]:
    response, expected = F.col("response"), F.col("expected")
    raised = F.col("error").isNotNull()
    limited = F.coalesce(F.lower(response).contains("rate limit"), F.lit(False))
    wrong = ~response.eqNullSafe(expected)
    key = (
        F.when(raised, F.concat(F.lit("Exception during check call: "), F.col("error")))
        .when(limited, response)
        .when(
            wrong, F.format_string("Unexpected response. Expected '%s', Got: '%s'", expected, F.coalesce(response, F.lit("")))
        )
    )
    numbers = F.format_string("Latency: %.2fs, InTokens: %d, OutTokens: %d", half_even(F.col("latency"), 2), "tokens_in", "tokens_out")
    measured = wrong & ~raised & ~limited
    return {
        "status": F.when(raised, ERROR).when(limited, RATE_LIMITED).when(wrong, ERROR).otherwise(OK),
        "message": F.when(measured, F.concat(key, F.lit(". "), numbers)).otherwise(key),
        "message_key": key,
        "details": F.when(key.isNull(), F.concat(F.format_string("OK. Response: '%s'. ", response), numbers)),
    }


def classify_http(checks: DataFrame, status: str = "http_status") -> DataFrame:
    code = F.col(status)
    bad = code.isNull() | (code >= 400)
    text = F.coalesce(code.cast("string"), F.lit("N/A"))
    message = F.when(bad, F.concat(F.lit("Error connecting to URL. Status Code: "), text))
    return checks.withColumns(
        {
            "status": F.when(bad, ERROR).otherwise(OK),
            "message": message,
            "message_key": message,
            "details": F.when(~bad, F.concat(F.lit("OK. Status Code: "), text)),
        }
    )


def with_settings(checks: DataFrame, settings: DataFrame | None = None, default: CheckSettings = CheckSettings()) -> DataFrame:
    """Add the settings columns, from the table where it names the check; what a row says itself stays."""
    values = dict(default.__dict__)
    if settings is None:
        return checks.withColumns({n: F.lit(v) for n, v in values.items() if n not in checks.columns})
    present = [n for n in values if n in settings.columns]
    checks = checks.drop(*present)
    joined = checks.join(settings.select("check_id", *present), "check_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) if n in present else F.lit(v) for n, v in values.items() if n in present or n not in checks.columns})


# --- gates --------------------------------------------------------------------------


def _seconds(value: Column) -> Column:
    return value.cast("bigint") * F.lit(SECOND)


def chunk_span(rows: DataFrame) -> int:
    """Chunk width for the checks in ``rows``; measure on plain rows, once, and pass it on."""
    return measured_span(rows, ["check_id"], micros(rows, "ts"))


def _spaced(
    rows: DataFrame, gap: Column, name: str, span: int | None, reset: Column | None = None, widest: int = HOUR
) -> DataFrame:
    # Wide enough for chains to merge, narrow enough for one task.
    span = max(span or chunk_span(rows), min(100 * widest, DAY))
    return spaced(rows, ["check_id"], micros(rows, "ts"), "event_id", gap, name, reset, span)


def interval_gate(checks: DataFrame, span: int | None = None) -> DataFrame:
    """Add ``accepted``: false for a check closer than its interval to the last accepted one."""
    return _spaced(checks, _seconds(F.col("interval_seconds")), "accepted", span)


def _cooldown(status: str = "status") -> Column:
    limited = F.col(status) == RATE_LIMITED
    return _seconds(F.when(limited, F.col("rate_limit_cooldown_seconds")).otherwise(0))


def cooldown_gate(checks: DataFrame, span: int | None = None) -> DataFrame:
    """Add ``accepted``: false for a check inside the cooldown of an accepted RATE_LIMITED one."""
    return _spaced(checks, _cooldown(), "accepted", span)


def disabled(checks: DataFrame) -> DataFrame:
    """Status DISABLED, without an error, for checks that are switched off."""
    off = ~F.col("enabled")
    cleared = {n: F.when(~off, F.col(n)) for n in ("message", "message_key", "details")}
    return checks.withColumns({"status": F.when(off, DISABLED).otherwise(F.col("status")), **cleared})


def accepted_checks(checks: DataFrame, span: int | None = None) -> DataFrame:
    """Classified checks that count: past interval and cooldown, or switched off."""
    gap = F.greatest(_seconds(F.col("interval_seconds")), _cooldown())
    # A switched-off row neither waits nor makes others wait, so it stays out of the chain.
    ready = disabled(checks)
    on = _spaced(ready.filter("enabled"), gap, "accepted", span).filter("accepted").drop("accepted")
    return on.unionByName(ready.filter(~F.col("enabled")))


# --- events -------------------------------------------------------------------------


def _with_previous(rows: DataFrame, span: int | None = None) -> DataFrame:
    chunk = F.floor(micros(rows, "ts") / F.lit(span or chunk_span(rows))).cast("bigint")
    seen = previous_row(rows, ["check_id"], ["ts", "event_id"], chunk, ["message_key", "status"], "before")
    changed = F.col("message_key").isNotNull() & ~F.col("message_key").eqNullSafe(F.col("before.message_key"))
    recovered = (F.col("status") == OK) & F.coalesce(F.col("before.message_key").isNotNull(), F.lit(False))
    return seen.withColumns({"starts": changed, "recovers": recovered}).drop("before")


def new_errors(rows: DataFrame, span: int | None = None) -> DataFrame:
    """Rows whose error differs from the current one, the first error included."""
    return _with_previous(rows, span).filter("starts").drop("starts", "recovers")


def recoveries(rows: DataFrame, span: int | None = None) -> DataFrame:
    """OK rows right after an error."""
    return _with_previous(rows, span).filter("recovers and send_recovery_email").drop("starts", "recovers")


def _with_kind(rows: DataFrame, span: int | None = None) -> DataFrame:
    span = span or chunk_span(rows)
    seen = _with_previous(rows, span)
    failing = F.col("message_key").isNotNull()
    # The chain of reminders starts again wherever an error starts; other rows stand alone.
    gap = F.when(failing, F.col("reminder_interval_hours")).otherwise(0) * F.lit(HOUR)
    due = _spaced(seen, gap, "due", span, reset=F.col("starts") | ~failing, widest=24 * HOUR)
    kind = (
        F.when(F.col("starts"), FAILURE)
        .when(F.col("message_key").isNotNull() & F.col("due"), REMINDER)
        .when(F.col("recovers") & F.col("send_recovery_email"), RECOVERY)
    )
    return due.withColumn("kind", kind).drop("due", "recovers")


def reminders(rows: DataFrame, span: int | None = None) -> DataFrame:
    """Rows of a lasting error at least the reminder interval after its last alert or reminder."""
    return _with_kind(rows, span).filter(F.col("kind") == REMINDER).drop("starts")


def alert_events(rows: DataFrame, span: int | None = None) -> DataFrame:
    """FAILURE, REMINDER and RECOVERY rows of accepted checks."""
    return _with_kind(rows, span).filter(F.col("kind").isNotNull()).drop("starts")


# --- summaries per check ------------------------------------------------------------


def health_events(checks: DataFrame) -> DataFrame:
    """From classified checks with their settings to FAILURE, REMINDER and RECOVERY rows.

    The accepted checks are written down once: the steps after the gates read them
    several times.
    """
    span = chunk_span(checks)
    return alert_events(landed(accepted_checks(checks, span), "accepted"), span)


def episodes(rows: DataFrame, span: int | None = None) -> DataFrame:
    """Runs of one error: start, end, number of checks, seconds, and whether still open."""
    span = span or chunk_span(rows)
    seen = _with_previous(rows, span).withColumn("__at", micros(rows, "ts"))
    boundary = (F.col("starts") | F.col("message_key").isNull()).cast("bigint")
    chunk = F.floor(F.col("__at") / F.lit(span)).cast("bigint")
    numbered = running_sums(seen, ["check_id"], ["ts", "event_id"], chunk, {"run_no": boundary})
    last = numbered.groupBy("check_id").agg(F.max("run_no").alias("last_run"))
    runs = (
        numbered.filter(F.col("message_key").isNotNull())
        .groupBy("check_id", "run_no", "message_key")
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("ended_at"),
            F.count("*").alias("checks"),
            ((F.max("__at") - F.min("__at")) / F.lit(SECOND)).alias("seconds"),
        )
    )
    return runs.join(last, "check_id").select(
        "check_id", "message_key", "started_at", "ended_at", "checks", "seconds", (F.col("run_no") == F.col("last_run")).alias("is_open")
    )


def current_status(rows: DataFrame, span: int | None = None) -> DataFrame:
    """Latest status per check with its message, the start of its error and the last reminder."""
    place = F.struct("ts", "event_id")
    alerted = F.col("kind").isin(FAILURE, REMINDER)
    latest = _with_kind(rows, span).groupBy("check_id").agg(
        F.max_by(F.struct("status", "message_key", "ts"), place).alias("last"),
        F.max(F.when(F.col("kind") == FAILURE, F.col("ts"))).alias("onset"),
        F.max(F.when(alerted, F.col("ts"))).alias("reminded"),
    )
    failing = F.col("last.message_key").isNotNull()
    return latest.select(
        "check_id",
        F.col("last.status").alias("status"),
        F.col("last.message_key").alias("message_key"),
        F.col("last.ts").alias("last_checked_at"),
        F.when(failing, F.col("onset")).alias("error_onset_at"),
        F.when(failing, F.col("reminded")).alias("last_reminder_at"),
    )


def last_metrics(checks: DataFrame) -> DataFrame:
    """Latency and tokens of the last call per check; an exception leaves zeros."""
    raised = F.col("error").isNotNull()
    values = [F.when(raised, 0).otherwise(F.col(c)).alias(c) for c in ("latency", "tokens_in", "tokens_out")]
    last = checks.groupBy("check_id").agg(F.max_by(F.struct(*values), F.struct("ts", "event_id")).alias("last"))
    return last.select("check_id", "last.*")


# --- messages -----------------------------------------------------------------------

SETTING_LINES = ["enabled", "interval_seconds", "send_recovery_email", "reminder_interval_hours", "rate_limit_cooldown_seconds"]


def render(events: DataFrame, name: str = "check_name") -> DataFrame:
    """Subject and body per event; settings columns that are present are listed."""
    what = F.col(name)
    limited = F.col("status") == RATE_LIMITED
    failed = F.when(limited, "Rate Limited").otherwise("Failed")
    subject = (
        F.when(F.col("kind") == RECOVERY, F.format_string("RESOLVED: %s Health Check Recovered", what))
        .when(F.col("kind") == REMINDER, F.format_string("REMINDER: %s Health Check Still %s (Ongoing)", what, failed))
        .otherwise(F.format_string("CRITICAL: %s Health Check %s", what, failed))
    )
    event = F.when(F.col("kind") == REMINDER, "REMINDER: FAILURE").otherwise(F.col("kind"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    detail = F.when(F.col("kind") == RECOVERY, F.col("details")).otherwise(
        F.concat("status", F.lit(": "), "message", F.lit(". Last checked: "), stamp)
    )
    lines = [F.concat(F.lit(f"  {s}: "), F.col(s).cast("string"), F.lit("\n")) for s in SETTING_LINES if s in events.columns]
    settings = [F.lit("Configuration at time of event:\n"), *lines] if lines else []
    closing = (
        F.when(F.col("kind") == RECOVERY, "\nThe service has recovered.")
        .when(
            F.col("kind") == REMINDER,
            "\nThis is a reminder that the issue is still ongoing. Please investigate if not already actioned.",
        )
        .otherwise("\nPlease investigate.")
    )
    head = F.format_string("Health Check Event: %s for %s.\n\nTimestamp: %s Z\nDetails: %s\n\n", event, what, stamp, detail)
    return events.withColumns({"subject": subject, "body": F.concat(head, *settings, closing)})
