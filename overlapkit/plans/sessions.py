"""Queries of the session operators over ``events`` (a key a user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from overlapkit.operators import sessions
from overlapkit.plans import read

K, ORDER = "user_id", ["ts", "event_id"]
KINDS = {"signup": "SessionStarted", "view": "PartialTranscript", "click": "Activity", "purchase": "SessionCompleted", "error": "Error"}
COMMANDS = {"signup": "Start", "error": "Stop", "click": "Toggle"}
OUTCOMES = ["Inserted", "ClipboardOnly", "Failed", "NothingToInject"]


def _case(column, table):
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def session_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        K, "ts", "event_id", _case(F.col("event_type"), KINDS).alias("event_type"), (F.col("value") < 50).alias("recoverable"), outcome.alias("outcome"),
        F.floor("value").cast("long").alias("chars"), F.concat(F.lit("c"), "event_id").alias("confirmed"), F.concat(F.lit("u"), "event_id").alias("unconfirmed"),
    )


def _commands(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.withColumn("command", _case(F.col("event_type"), COMMANDS)).where("command is not null").select(K, "ts", "event_id", "command")


def _phases(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(K).orderBy(*ORDER))
    e = read(spark, sf_dir, "events").withColumn("n", n).where("n in (1, 3, 6)")
    return e.select(K, "ts", F.when(F.col("n") == 1, "NeedsModel").when(F.col("n") == 3, "Downloading").otherwise("Ready").alias("phase"))


def f1_level_edges(spark, sf_dir):
    c = _commands(spark, sf_dir).where("command != 'Toggle'").withColumn("level", F.col("command") == "Start").drop("command")
    return sessions.level_edges(c, K, ORDER, "level").select(K, "event_id", "command")


def f1_momentary_toggles(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(K, "event_id", (F.col("event_id") % 16).alias("modifiers"), (F.col("event_id") % 5 == 0).alias("repeated"))
    return sessions.momentary_toggles(e, "modifiers", 5, 7, "repeated").select(K, "event_id", "command")


def f2_dispatch_commands(spark, sf_dir):
    return sessions.dispatch_commands(_commands(spark, sf_dir), K, ORDER).select(K, "event_id", "command", "recording", "action")


def f3_discard_not_ready(spark, sf_dir):
    c = sessions.discard_not_ready(_commands(spark, sf_dir), _phases(spark, sf_dir), K, "ts")
    return c.groupBy(K, "phase", "accepted").agg(F.count("*").alias("n"))


def f4_sessionize(spark, sf_dir):
    s = sessions.sessionize(session_events(spark, sf_dir), K, ORDER)
    return s.select(K, "session_no", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), "end_reason", "duration_s", "partials", "activities", "outcome", "chars")


def f5_drop_stale_completions(spark, sf_dir):
    return sessions.drop_stale_completions(session_events(spark, sf_dir), K, ORDER).where("event_type = 'SessionCompleted'").select(K, "event_id", "stale")


def f6_classify_errors(spark, sf_dir):
    e = session_events(spark, sf_dir)
    return sessions.classify_errors(e, sessions.sessionize(e, K, ORDER), K, ORDER).select(K, "event_id", "session_no", "effect")


def f7_outcome_deadlines(spark, sf_dir):
    return sessions.outcome_deadlines(session_events(spark, sf_dir), K, ORDER).select(K, "event_id", "event_type", "deadline_us", "cancelled")


def f8_session_rollup(spark, sf_dir):
    r = sessions.session_rollup(sessions.sessionize(session_events(spark, sf_dir), K, ORDER), K)
    return r.withColumn("day", F.col("day").cast("string"))


def f9_view_state(spark, sf_dir):
    return sessions.view_state(session_events(spark, sf_dir), K, ORDER).select(K, "event_id", "recording", "confirmed", "unconfirmed")


def status_columns(a):
    """The status of attributes that stand in for the reference's, from latest values of 0 to 100."""
    model = F.when(F.col("view") < 20, "Missing").when(F.col("view") < 60, "Downloading").when(F.col("view") < 70, "Verifying").otherwise("Ready")
    engine = F.when(F.col("signup") < 20, "Failed").when(F.col("signup") < 40, "Loading").otherwise("Ready")
    return sessions.status_of(F.coalesce(F.col("click") > 90, F.lit(False)), F.coalesce(F.col("purchase") > 80, F.lit(False)), F.coalesce(F.col("error") > 80, F.lit(False)), model, F.col("view") / 100, engine)


def f10_composite_status(spark, sf_dir):
    a = sessions.latest_attributes(read(spark, sf_dir, "events"), K, "event_type", "value", ORDER, list(KINDS))
    return a.select(K, status_columns(a).alias("status"))


def f11_stop_to_result_latency(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return sessions.stop_to_result_latency(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), K)


def f11_latency_percentiles(spark, sf_dir):
    return sessions.latency_percentiles(f11_stop_to_result_latency(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        f1_level_edges, f1_momentary_toggles, f2_dispatch_commands, f3_discard_not_ready, f4_sessionize, f5_drop_stale_completions, f6_classify_errors,
        f7_outcome_deadlines, f8_session_rollup, f9_view_state, f10_composite_status, f11_stop_to_result_latency, f11_latency_percentiles,
    )
}


def _sql_case(table):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_EV = f"""SELECT user_id, ts, event_id, {_sql_case(KINDS)} AS kind, value < 50 AS recoverable, {OUTCOMES!r}[event_id % 4 + 1] AS outcome, floor(value)::BIGINT AS chars FROM events"""
_CMD = f"SELECT user_id, ts, event_id, {_sql_case(COMMANDS)} AS command FROM events WHERE event_type IN ('signup', 'error', 'click')"
_W = "PARTITION BY user_id ORDER BY ts, event_id"
_NUM = f"SELECT *, (sum(CASE WHEN kind = 'SessionStarted' THEN 1 ELSE 0 END) OVER ({_W}))::BIGINT AS no, CASE WHEN kind = 'SessionCompleted' THEN 'completed' WHEN kind = 'Error' AND NOT recoverable THEN 'error' END AS fin FROM ({_EV})"
_SESS = f"""SELECT user_id, no, min(ts) FILTER (kind = 'SessionStarted') AS started, max(ts) FILTER (fin IS NOT NULL) AS ended, coalesce(max(fin), CASE WHEN no = top THEN 'open' ELSE 'superseded' END) AS end_reason,
 count(*) FILTER (kind = 'PartialTranscript') AS partials, count(*) FILTER (kind = 'Activity') AS activities, max(outcome) FILTER (fin = 'completed') AS outcome, max(chars) FILTER (fin = 'completed') AS chars
 FROM (SELECT *, max(no) OVER (PARTITION BY user_id) AS top, coalesce(count(fin) OVER (PARTITION BY user_id, no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past
 FROM ({_NUM})) WHERE no > 0 AND past = 0 GROUP BY user_id, no, top"""
_GROUPS = f"SELECT *, sum(CASE WHEN kind IN ('SessionStarted', 'SessionCompleted', 'Error') THEN 1 ELSE 0 END) OVER ({_W}) AS g FROM ({_EV})"
ORACLE = {
    "f1_level_edges": f"""SELECT user_id, event_id, command FROM (SELECT *, coalesce(lag(command) OVER ({_W}), 'Stop') AS prev FROM ({_CMD}) WHERE command <> 'Toggle') WHERE command <> prev""",
    "f1_momentary_toggles": "SELECT user_id, event_id, 'Toggle' AS command FROM events WHERE (event_id % 16) & 7 = 5 AND event_id % 5 <> 0",
    "f2_dispatch_commands": f"""WITH t AS (SELECT *, sum((command = 'Toggle')::INT) OVER ({_W}) AS tg FROM ({_CMD})),
 u AS (SELECT *, last_value(CASE command WHEN 'Start' THEN 1 + tg WHEN 'Stop' THEN tg END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS base FROM t),
 v AS (SELECT *, (tg + coalesce(base, 0)) % 2 = 1 AS recording FROM u)
 SELECT user_id, event_id, command, recording, CASE WHEN recording AND NOT prev THEN 'SessionStarted' WHEN NOT recording AND prev THEN 'SessionEnded' ELSE 'Continue' END AS action
 FROM (SELECT *, coalesce(lag(recording) OVER ({_W}), false) AS prev FROM v)""",
    "f3_discard_not_ready": f"""WITH p AS (SELECT user_id, ts, CASE n WHEN 1 THEN 'NeedsModel' WHEN 3 THEN 'Downloading' ELSE 'Ready' END AS phase FROM (SELECT *, row_number() OVER ({_W}) AS n FROM events) WHERE n IN (1, 3, 6))
 SELECT c.user_id, p.phase, coalesce(p.phase = 'Ready', false) AS accepted, count(*) AS n FROM ({_CMD}) c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts GROUP BY ALL""",
    "f4_sessionize": f"SELECT user_id, no AS session_no, epoch_us(started) AS started_us, end_reason, round((epoch_us(ended) - epoch_us(started)) / 1e6, 6) AS duration_s, partials, activities, outcome, chars FROM ({_SESS})",
    "f5_drop_stale_completions": f"""SELECT user_id, event_id, coalesce(prev, 'x') <> 'SessionStarted' AS stale FROM (SELECT *, last_value(CASE WHEN kind IN ('SessionStarted', 'SessionCompleted', 'Error') THEN kind END IGNORE NULLS)
 OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ({_EV})) WHERE kind = 'SessionCompleted'""",
    "f6_classify_errors": f"""SELECT e.user_id, e.event_id, e.no AS session_no, CASE WHEN s.end_reason IS NULL OR e.ts > s.ended THEN 'no session' WHEN e.recoverable THEN 'continues' ELSE 'aborts' END AS effect
 FROM ({_NUM}) e LEFT JOIN ({_SESS}) s ON e.user_id = s.user_id AND e.no = s.no WHERE e.kind = 'Error'""",
    "f7_outcome_deadlines": f"""WITH t AS (SELECT *, min(CASE WHEN kind = 'SessionStarted' THEN epoch_us(ts) END) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
 epoch_us(ts) + (100 + CASE WHEN kind = 'Error' THEN 900 ELSE CASE outcome WHEN 'Inserted' THEN 1800 WHEN 'ClipboardOnly' THEN 3000 WHEN 'NothingToInject' THEN 800 END END) * 1000 AS deadline_us FROM ({_EV}))
 SELECT user_id, event_id, kind AS event_type, deadline_us, coalesce(nxt < deadline_us, false) AS cancelled FROM t WHERE kind = 'SessionCompleted' OR (kind = 'Error' AND recoverable)""",
    "f8_session_rollup": f"""SELECT user_id, started::DATE::VARCHAR AS day, count(*) AS sessions, count(*) FILTER (end_reason = 'completed') AS completed, count(*) FILTER (end_reason = 'error') AS aborted,
 count(*) FILTER (outcome = 'Inserted') AS inserted, count(*) FILTER (outcome = 'ClipboardOnly') AS clipboardonly, count(*) FILTER (outcome = 'Failed') AS failed, count(*) FILTER (outcome = 'NothingToInject') AS nothingtoinject,
 coalesce(sum(chars) FILTER (outcome IN ('Inserted', 'ClipboardOnly')), 0)::BIGINT AS delivered_chars, round(avg(CASE WHEN end_reason = 'completed' THEN (outcome = 'NothingToInject')::INT::DOUBLE END), 6) AS blank_rate
 FROM ({_SESS}) GROUP BY 1, 2""",
    "f9_view_state": f"""SELECT user_id, event_id, coalesce(first_value(kind) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) = 'SessionStarted', false) AS recording,
 coalesce(last_value(CASE WHEN kind = 'PartialTranscript' THEN 'c' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS confirmed,
 coalesce(last_value(CASE WHEN kind = 'PartialTranscript' THEN 'u' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS unconfirmed FROM ({_GROUPS})""",
    "f10_composite_status": """WITH a AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL),
 p AS (SELECT user_id, max(v) FILTER (event_type = 'view') AS vw, max(v) FILTER (event_type = 'click') AS ck, max(v) FILTER (event_type = 'purchase') AS pu, max(v) FILTER (event_type = 'error') AS er, max(v) FILTER (event_type = 'signup') AS su FROM a GROUP BY 1)
 SELECT user_id, CASE WHEN ck > 90 THEN 'Recording' WHEN pu > 80 THEN 'PermissionsMissing' WHEN er > 80 THEN 'RelaunchRequired' WHEN vw < 20 THEN 'ModelMissing'
 WHEN vw < 60 THEN 'Downloading(' || floor(least(greatest(vw / 100, 0), 1) * 100 + 0.5)::INT || ')' WHEN vw < 70 THEN 'Verifying' WHEN su < 20 THEN 'EngineFailed' WHEN su < 40 THEN 'EngineLoading' ELSE 'Ready' END AS status FROM p""",
    "f11_stop_to_result_latency": f"""SELECT user_id, epoch_us(ts) AS stop_us, round((epoch_us(nts) - epoch_us(ts)) / 1e6, 6) AS latency_s FROM (SELECT *, lead(event_type) OVER w AS nk, lead(ts) OVER w AS nts
 FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'purchase')) WHERE event_type = 'click' AND nk = 'purchase'""",
}
ORACLE["f11_latency_percentiles"] = f"SELECT count(*) AS n, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.9), 6) AS p90, round(quantile_cont(latency_s, 0.99), 6) AS p99 FROM ({ORACLE['f11_stop_to_result_latency']})"
