from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sqlassay.operators import alerts as al
from sqlassay.session import fresh_path
from sqlassay.sources.stream import check_stream, drain
from sqlassay.streaming import alerts as st

SCHEMA = (
    "check_id bigint, event_id bigint, ts timestamp_ntz, expected string, response string, error string, "
    "latency double, tokens_in int, tokens_out int, enabled boolean"
)
START = datetime.datetime(2024, 1, 1)
SETTINGS = al.CheckSettings(interval_seconds=60, rate_limit_cooldown_seconds=300, reminder_interval_hours=1)


def make_rows(seed=7, n=1500):
    rng = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.choice([0, 5, 20, 61, 400])
        check = 0 if i % 3 == 0 else rng.randrange(1, 6)
        state = rng.choices(["Hi", "Rate limit hit", "bad", "worse"], [6, 1, 6, 2])[0] if i % 400 > 150 else "bad"
        error = "boom" if rng.random() < 0.03 else None
        enabled = not (700 < i < 720)
        rows.append((check, i, START + datetime.timedelta(seconds=clock), "Hi", state, error, round(rng.random(), 3), 3, 1, enabled))
    return rows


def expected_events(rows, settings):
    """One check result at a time, as a single process would do it."""
    out, states = [], {}
    for check, event, ts, want, response, error, *_, enabled in sorted(rows, key=lambda r: (r[2], r[1])):
        s = states.setdefault(check, {"allowed": None, "key": None, "reminded": None})
        if not enabled:
            s["key"] = None
            continue
        if s["allowed"] and ts < s["allowed"]:
            continue
        wait, key = settings.interval_seconds, None
        if error:
            key = error
        elif "rate limit" in response.lower():
            key, wait = response, max(wait, settings.rate_limit_cooldown_seconds)
        elif response != want:
            key = response
        s["allowed"] = ts + datetime.timedelta(seconds=wait)
        if key is None:
            if s["key"] is not None:
                out.append((check, event, al.RECOVERY))
            s["key"] = None
        elif key != s["key"]:
            out.append((check, event, al.FAILURE))
            s["key"], s["reminded"] = key, ts
        elif ts - s["reminded"] >= datetime.timedelta(hours=settings.reminder_interval_hours):
            out.append((check, event, al.REMINDER))
            s["reminded"] = ts
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    return make_rows()


def events_of(df):
    return sorted((r["check_id"], r["event_id"], r["kind"]) for r in df.collect())


def classified(spark, rows):
    return al.classify(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("target", [20, 1_000_000])
def test_batch_equals_one_by_one(spark, rows, monkeypatch, target):
    from sqlassay.operators import ordered

    monkeypatch.setattr(al, "measured_span", lambda df, keys, at: ordered.measured_span(df, keys, at, target))
    checks = al.with_settings(classified(spark, rows), None, SETTINGS)
    expected = expected_events(rows, SETTINGS)
    assert {k for _, _, k in expected} == {al.FAILURE, al.REMINDER, al.RECOVERY}
    assert events_of(al.health_events(checks)) == expected


@pytest.mark.parametrize("files", [1, 6])
def test_stream_equals_batch(spark, rows, files):
    path = fresh_path(spark, "stream")
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    step = -(-len(ordered) // files)
    for i in range(files):
        part = spark.createDataFrame(ordered[i * step : (i + 1) * step], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)
    stream = al.classify(check_stream(spark, path, SCHEMA, files_per_batch=1))
    assert events_of(drain(st.stream_alerts(stream, SETTINGS), "alerts")) == expected_events(rows, SETTINGS)


def test_late_rows_are_counted_not_applied(spark):
    path = fresh_path(spark, "late")

    def row(event, minute, response):
        return (1, event, START + datetime.timedelta(minutes=minute), "Hi", response, None, 0.1, 1, 1, True)

    for batch in ([row(1, 0, "bad"), row(2, 10, "Hi")], [row(3, 5, "worse"), row(4, 20, "Hi")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = al.classify(check_stream(spark, path, SCHEMA, files_per_batch=1))
    found = events_of(drain(st.stream_alerts(stream, SETTINGS), "alerts"))
    assert found == [(1, 1, al.FAILURE), (1, 2, al.RECOVERY)]
    late = drain(st.late_checks(al.classify(check_stream(spark, path, SCHEMA, files_per_batch=1)), SETTINGS), "late")
    assert [(r["event_id"], r["late_rows"]) for r in late.collect()] == [(3, 1)]


def test_same_fault_with_other_latency_is_the_same_fault(spark):
    rows = [(1, i, START + datetime.timedelta(minutes=i), "Hi", "bad", None, 0.1 * i, i, 1, True) for i in range(5)]
    checks = al.with_settings(classified(spark, rows), None, SETTINGS)
    assert [r["event_id"] for r in al.new_errors(checks).collect()] == [0]
    assert checks.select("message").distinct().count() == 5


def test_settings_table_wins_over_defaults(spark, rows):
    settings = spark.createDataFrame([(0, False, 5)], "check_id bigint, enabled boolean, interval_seconds int")
    checks = al.with_settings(classified(spark, rows).drop("enabled"), settings, SETTINGS)
    found = {r["check_id"]: (r["enabled"], r["interval_seconds"]) for r in checks.select("check_id", "enabled", "interval_seconds").distinct().collect()}
    assert found[0] == (False, 5) and found[1] == (True, 60)
    statuses = al.disabled(checks).filter("check_id = 0").select("status").distinct().collect()
    assert [r["status"] for r in statuses] == [al.DISABLED]


def test_exception_leaves_zero_metrics(spark):
    rows = [(1, 1, START, "Hi", "Hi", None, 0.5, 3, 1, True), (1, 2, START + datetime.timedelta(hours=1), "Hi", None, "boom", 0.9, 9, 9, True)]
    found = al.last_metrics(spark.createDataFrame(rows, SCHEMA)).first()
    assert (found["latency"], found["tokens_in"], found["tokens_out"]) == (0.0, 0, 0)


def test_time_zone_does_not_matter(spark, rows):
    checks = al.with_settings(classified(spark, rows), None, SETTINGS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert events_of(al.health_events(checks)) == expected_events(rows, SETTINGS)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rendered_text(spark):
    rows = [(1, 1, START, "Hi", "Rate limit hit", None, 0.5, 3, 1, True)]
    checks = al.with_settings(classified(spark, rows), None, SETTINGS).withColumn("check_name", F.lit("Model"))
    text = al.render(al.health_events(checks)).first()
    assert text["subject"] == "CRITICAL: Model Health Check Rate Limited"
    assert "  interval_seconds: 60\n" in text["body"] and text["body"].endswith("\nPlease investigate.")


def streamed(spark, batches, name):
    path = fresh_path(spark, name)
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return al.classify(check_stream(spark, path, SCHEMA, files_per_batch=1))


@pytest.mark.parametrize("files", [1, 4])
def test_settings_per_check_in_one_stream(spark, rows, files):
    other = al.CheckSettings(interval_seconds=600, rate_limit_cooldown_seconds=30, reminder_interval_hours=3, send_recovery_email=False)
    table = spark.createDataFrame([(0, 1, 5, 5, 1, True), (0, 2, 600, 30, 3, False), (99, 7, 1, 1, 1, True)], "check_id bigint, version bigint, interval_seconds int, rate_limit_cooldown_seconds int, reminder_interval_hours int, send_recovery_email boolean")
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    step = -(-len(ordered) // files)
    stream = streamed(spark, [ordered[i * step : (i + 1) * step] for i in range(files)], "per_check")
    silent = [e for e in expected_events([r for r in rows if r[0] == 0], other) if e[2] != al.RECOVERY]
    want = sorted(silent + expected_events([r for r in rows if r[0] != 0], SETTINGS))
    assert sorted(events_of(drain(st.stream_alerts(stream, SETTINGS, table), "alerts"))) == want
    # The batch, with the same table.
    checks = al.with_settings(classified(spark, rows), st.newest(table).drop("version"), SETTINGS)
    assert sorted(events_of(al.health_events(checks))) == want


def at_minute(event, minute, response, check=1):
    return (check, event, START + datetime.timedelta(minutes=minute), "Hi", response, None, 0.1, 1, 1, True)


def test_reminders_without_a_row_and_forgotten_checks(spark):
    # Check 1 fails and goes quiet; check 2 keeps the watermark moving.
    batches = [[at_minute(1, 0, "bad"), at_minute(2, 1, "Hi", 2)], [at_minute(3, 150, "Hi", 2)], [at_minute(4, 400, "Hi", 2)], [at_minute(5, 401, "bad"), at_minute(6, 402, "Hi", 2)]]
    stream = streamed(spark, batches, "quiet")
    found = drain(st.stream_events(stream, SETTINGS, late_after="1 minute", forget_after_hours=5), "events").collect()
    minute = lambda r: (r["at"] - int(START.replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**6) / 6e7
    got = sorted((minute(r), r["event_id"] or 0, r["kind"]) for r in found if r["check_id"] == 1)
    # Reminders are due every hour until the state ends after five hours; then the same fault is a new one.
    assert got == [(0, 1, al.FAILURE), (60, 0, al.REMINDER), (120, 0, al.REMINDER), (180, 0, al.REMINDER), (240, 0, al.REMINDER), (300, 0, al.REMINDER), (401, 5, al.FAILURE)]
    with pytest.raises(ValueError):
        st.stream_events(stream, forget_after_hours=5)


def test_alerts_and_late_rows_in_one_run(spark):
    stream = streamed(spark, [[at_minute(1, 0, "bad"), at_minute(2, 10, "Hi")], [at_minute(3, 5, "worse"), at_minute(4, 20, "worse")]], "both")
    found = {(r["event_id"], r["kind"], r["late_rows"]) for r in drain(st.stream_events(stream, SETTINGS), "events").collect()}
    assert found == {(1, al.FAILURE, 0), (2, al.RECOVERY, 0), (3, st.LATE, 1), (4, al.FAILURE, 1)}
