"""Health checks and alerts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.operators import alerts as al
from sqlassay.plans.fixtures import DERIVED, derived, expand, oracle, table
from sqlassay.sources.stream import check_stream, drain
from sqlassay.streaming import alerts as st

# A user's events lie hours apart, so the waits here are hours too.
GATES = al.CheckSettings(interval_seconds=6 * 3600, rate_limit_cooldown_seconds=12 * 3600)
REMINDING = al.CheckSettings(reminder_interval_hours=6)
WHOLE = al.CheckSettings(interval_seconds=3600, rate_limit_cooldown_seconds=3 * 3600, reminder_interval_hours=12)

_SETTINGS = """SELECT user_id AS check_id, user_id % 7 <> 0 AS enabled, CAST(3600 * (1 + user_id % 3) AS INT) AS interval_seconds
  FROM {events} GROUP BY user_id"""


def _classified(spark: SparkSession, d: str, settings: al.CheckSettings) -> DataFrame:
    return al.with_settings(al.classify(derived(spark, d, "checks")), None, settings)


def h1(spark: SparkSession, d: str) -> DataFrame:
    return al.classify(derived(spark, d, "checks")).select("event_id", "status", "message", "message_key", "details")


def h2(spark: SparkSession, d: str) -> DataFrame:
    return al.classify_http(derived(spark, d, "checks")).select("event_id", "status", "message", "details")


def h3(spark: SparkSession, d: str) -> DataFrame:
    return al.interval_gate(_classified(spark, d, GATES)).select("event_id", "accepted")


def h4(spark: SparkSession, d: str) -> DataFrame:
    return al.cooldown_gate(_classified(spark, d, GATES)).select("event_id", "accepted")


def h5(spark: SparkSession, d: str) -> DataFrame:
    return al.new_errors(_classified(spark, d, REMINDING)).select("event_id", "check_id", "message_key")


def h6(spark: SparkSession, d: str) -> DataFrame:
    return al.reminders(_classified(spark, d, REMINDING)).select("event_id", "check_id", "message_key")


def h7(spark: SparkSession, d: str) -> DataFrame:
    return al.recoveries(_classified(spark, d, REMINDING)).select("event_id", "check_id", "details")


def h8(spark: SparkSession, d: str) -> DataFrame:
    settings = spark.sql(expand(_SETTINGS, lambda t: f"parquet.`{d}/{t}.parquet`"))
    rows = al.with_settings(al.classify(derived(spark, d, "checks")), settings)
    return al.disabled(rows).select("event_id", "status", "message_key", "interval_seconds")


def h9(spark: SparkSession, d: str) -> DataFrame:
    return al.episodes(_classified(spark, d, REMINDING))


def h10(spark: SparkSession, d: str) -> DataFrame:
    return al.current_status(_classified(spark, d, REMINDING))


def h11(spark: SparkSession, d: str) -> DataFrame:
    return al.last_metrics(derived(spark, d, "checks"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return al.health_events(_classified(spark, d, WHOLE))


def h12(spark: SparkSession, d: str) -> DataFrame:
    named = _events(spark, d).withColumn("check_name", F.concat(F.lit("Check "), F.col("check_id").cast("string")))
    return al.render(named).select("event_id", "kind", "subject", "body")


def _events_path(d: str) -> str:
    # A glob, because a stream takes a lone file by pattern only.
    return f"{d}/events.parque[t]"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The checks as a stream, by the same statement the batch input comes from."""
    schema = table(spark, d, "events").schema
    check_stream(spark, _events_path(d), schema).createOrReplaceTempView("sqlassay_event_stream")
    return al.classify(spark.sql(expand(DERIVED["checks"], lambda _: "sqlassay_event_stream")))


def _with_state_store(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def h13(spark: SparkSession, d: str) -> DataFrame:
    _with_state_store(spark)
    found = drain(st.stream_alerts(_stream(spark, d), WHOLE), "alerts")
    return found.select("check_id", "event_id", "kind", "status", "message_key")


def h14(spark: SparkSession, d: str) -> DataFrame:
    """The stream is fed twice in one batch, so the second copy of every accepted row is late."""
    _with_state_store(spark)
    schema = table(spark, d, "events").schema
    once = check_stream(spark, _events_path(d), schema)
    once.unionByName(check_stream(spark, _events_path(d), schema)).createOrReplaceTempView("sqlassay_late_stream")
    rows = al.classify(spark.sql(expand(DERIVED["checks"], lambda _: "sqlassay_late_stream")))
    late = drain(st.late_checks(rows, WHOLE), "late")
    return late.groupBy("check_id").agg(F.max("late_rows").alias("late_rows"))


def s8(spark: SparkSession, d: str) -> DataFrame:
    return drain(_stream(spark, d).select("check_id", "event_id", "status"), "checks")


QUERIES = {
    "H1_classify": h1, "H2_classify_http": h2, "H3_interval_gate": h3, "H4_cooldown_gate": h4,
    "H5_new_error_alert": h5, "H6_reminder": h6, "H7_recovery": h7, "H8_disabled": h8, "H9_episodes": h9,
    "H10_current_status": h10, "H11_last_metrics": h11, "H12_alert_text": h12, "H13_stream_alerts": h13,
    "H14_late_checks": h14, "S8_check_stream": s8,
}

_NUMBERS = "printf('Latency: %.2fs, InTokens: %d, OutTokens: %d', round_even(latency, 2), tokens_in, tokens_out)"
_CLASSED = f"""classed AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY check_id ORDER BY ts, event_id) AS rn,
  CASE WHEN message_key IS NULL THEN NULL WHEN status = 'ERROR' THEN concat(message_key, '. ', {_NUMBERS}) ELSE message_key END AS message,
  CASE WHEN message_key IS NULL THEN concat('OK. Response: ''', response, '''. ', {_NUMBERS}) END AS details FROM (
  SELECT *, CASE WHEN lower(response) LIKE '%rate limit%' THEN 'RATE_LIMITED' WHEN response <> expected THEN 'ERROR' ELSE 'OK' END AS status,
    CASE WHEN lower(response) LIKE '%rate limit%' THEN response
      WHEN response <> expected THEN concat('Unexpected response. Expected ''', expected, ''', Got: ''', response, '''') END AS message_key
  FROM {{checks}} c) s)"""


def _walk(name: str, source: str, gap: str, start: str = "false") -> str:
    """Accept a row at least ``gap`` after the last accepted one, row by row."""
    return f"""{name} AS (
  SELECT check_id, rn, event_id, us, true AS accepted, us + {gap} AS allowed FROM {source} r WHERE rn = 1
  UNION ALL
  SELECT r.check_id, r.rn, r.event_id, r.us, r.us >= w.allowed OR {start},
    CASE WHEN r.us >= w.allowed OR {start} THEN r.us + {gap} ELSE w.allowed END
  FROM {name} w JOIN {source} r ON r.check_id = w.check_id AND r.rn = w.rn + 1)"""


def _kinds(source: str, hours: int) -> str:
    """Alerts, reminders and recoveries of numbered rows."""
    return f"""seen AS (SELECT *, lag(message_key) OVER (PARTITION BY check_id ORDER BY rn) AS before FROM {source}),
marked AS (SELECT *, message_key IS NOT NULL AND message_key IS DISTINCT FROM before AS starts,
  status = 'OK' AND before IS NOT NULL AS recovers FROM seen),
{_walk('due', 'marked', f'(CASE WHEN r.message_key IS NOT NULL THEN {hours} ELSE 0 END) * 3600000000', 'r.starts OR r.message_key IS NULL')},
kinds AS (SELECT m.*, CASE WHEN starts THEN 'FAILURE' WHEN message_key IS NOT NULL AND accepted THEN 'REMINDER'
  WHEN recovers THEN 'RECOVERY' END AS kind FROM marked m JOIN due d ON m.check_id = d.check_id AND m.rn = d.rn)"""


_RAW = f"WITH RECURSIVE {_CLASSED}, {_kinds('classed', 6)}"
_LIMITED = "(CASE WHEN r.status = 'RATE_LIMITED' THEN {0} ELSE {1} END) * 3600000000"
_WHOLE = f"""WITH RECURSIVE {_CLASSED}, {_walk('gated', 'classed', _LIMITED.format(3, 1))},
taken AS (SELECT c.* REPLACE (row_number() OVER (PARTITION BY c.check_id ORDER BY c.rn) AS rn)
  FROM classed c JOIN gated g ON c.check_id = g.check_id AND c.rn = g.rn WHERE g.accepted), {_kinds('taken', 12)}"""
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"

ORACLES = {
    "H1_classify": f"WITH {_CLASSED} SELECT event_id, status, message, message_key, details FROM classed",
    "H2_classify_http": """SELECT event_id, CASE WHEN coalesce(http_status, 999) >= 400 THEN 'ERROR' ELSE 'OK' END AS status,
        CASE WHEN coalesce(http_status, 999) >= 400 THEN concat('Error connecting to URL. Status Code: ', coalesce(CAST(http_status AS VARCHAR), 'N/A')) END AS message,
        CASE WHEN http_status < 400 THEN concat('OK. Status Code: ', http_status) END AS details FROM {checks} c""",
    "H3_interval_gate": f"WITH RECURSIVE {_CLASSED}, {_walk('gated', 'classed', '6 * 3600000000')} SELECT event_id, accepted FROM gated",
    "H4_cooldown_gate": f"WITH RECURSIVE {_CLASSED}, {_walk('gated', 'classed', _LIMITED.format(12, 0))} SELECT event_id, accepted FROM gated",
    "H5_new_error_alert": f"{_RAW} SELECT event_id, check_id, message_key FROM marked WHERE starts",
    "H6_reminder": f"{_RAW} SELECT event_id, check_id, message_key FROM kinds WHERE kind = 'REMINDER'",
    "H7_recovery": f"{_RAW} SELECT event_id, check_id, details FROM marked WHERE recovers",
    "H8_disabled": f"""WITH {_CLASSED} SELECT event_id, CASE WHEN check_id % 7 = 0 THEN 'DISABLED' ELSE status END AS status,
        CASE WHEN check_id % 7 <> 0 THEN message_key END AS message_key, CAST(3600 * (1 + check_id % 3) AS INT) AS interval_seconds FROM classed""",
    "H9_episodes": f"""{_RAW}, numbered AS (SELECT *, sum(CASE WHEN starts OR message_key IS NULL THEN 1 ELSE 0 END)
          OVER (PARTITION BY check_id ORDER BY rn) AS run, max(rn) OVER (PARTITION BY check_id) AS last FROM marked)
        SELECT check_id, message_key, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS checks,
          (max(us) - min(us)) / 1000000 AS seconds, max(rn) = max(last) AS is_open
        FROM numbered WHERE message_key IS NOT NULL GROUP BY check_id, run, message_key""",
    "H10_current_status": f"""{_RAW}, lasts AS (SELECT check_id, arg_max(status, rn) AS status, arg_max(message_key, rn) FILTER (true) AS any_key,
          max(ts) AS last_checked_at, max(ts) FILTER (kind = 'FAILURE') AS onset, max(ts) FILTER (kind IN ('FAILURE', 'REMINDER')) AS reminded,
          max(rn) AS rn FROM kinds GROUP BY check_id)
        SELECT l.check_id, l.status, k.message_key, last_checked_at, CASE WHEN k.message_key IS NOT NULL THEN onset END AS error_onset_at,
          CASE WHEN k.message_key IS NOT NULL THEN reminded END AS last_reminder_at
        FROM lasts l JOIN kinds k ON l.check_id = k.check_id AND l.rn = k.rn""",
    "H11_last_metrics": """SELECT check_id, arg_max(latency, (ts, event_id)) AS latency, arg_max(tokens_in, (ts, event_id)) AS tokens_in,
        arg_max(tokens_out, (ts, event_id)) AS tokens_out FROM {checks} c GROUP BY check_id""",
    "H12_alert_text": f"""{_WHOLE} SELECT event_id, kind, CASE kind WHEN 'RECOVERY' THEN concat('RESOLVED: Check ', check_id, ' Health Check Recovered')
          WHEN 'REMINDER' THEN concat('REMINDER: Check ', check_id, ' Health Check Still ', CASE status WHEN 'ERROR' THEN 'Failed' ELSE 'Rate Limited' END, ' (Ongoing)')
          ELSE concat('CRITICAL: Check ', check_id, ' Health Check ', CASE status WHEN 'ERROR' THEN 'Failed' ELSE 'Rate Limited' END) END AS subject,
        concat('Health Check Event: ', CASE kind WHEN 'REMINDER' THEN 'REMINDER: FAILURE' ELSE kind END, ' for Check ', check_id, '.', chr(10), chr(10),
          'Timestamp: ', {_STAMP}, ' Z', chr(10), 'Details: ', CASE kind WHEN 'RECOVERY' THEN details
            ELSE concat(status, ': ', message, '. Last checked: ', {_STAMP}) END, chr(10), chr(10), 'Configuration at time of event:', chr(10),
          '  enabled: true', chr(10), '  interval_seconds: 3600', chr(10), '  send_recovery_email: true', chr(10), '  reminder_interval_hours: 12', chr(10),
          '  rate_limit_cooldown_seconds: 10800', chr(10), chr(10), CASE kind WHEN 'RECOVERY' THEN 'The service has recovered.'
            WHEN 'REMINDER' THEN 'This is a reminder that the issue is still ongoing. Please investigate if not already actioned.'
            ELSE 'Please investigate.' END) AS body FROM kinds WHERE kind IS NOT NULL""",
    "H13_stream_alerts": f"{_WHOLE} SELECT check_id, event_id, kind, status, message_key FROM kinds WHERE kind IS NOT NULL",
    "H14_late_checks": f"""WITH RECURSIVE {_CLASSED}, {_walk('gated', 'classed', _LIMITED.format(3, 1))}
        SELECT check_id, count(*) FILTER (accepted) AS late_rows FROM gated GROUP BY check_id""",
    "S8_check_stream": f"WITH {_CLASSED} SELECT check_id, event_id, status FROM classed",
}
ORACLES = {name: oracle(text) for name, text in ORACLES.items()}
