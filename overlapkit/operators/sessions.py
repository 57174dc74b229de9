"""Sessions and state from command and event logs, by window functions over (key, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapkit.functions import micros
from overlapkit.operators.scan import RANGE_ROWS, Scan, State
from overlapkit.sources import scratch_dir

# How long an outcome is shown, in ms, and the margin after it.
SHOW_MS = {"Inserted": 1800, "ClipboardOnly": 3000, "NothingToInject": 800}
RECOVERABLE_MS, MARGIN_MS = 900, 100


def _so_far(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def level_edges(df: DataFrame, key: str, order: list[str], level: str, seed: bool = False) -> DataFrame:
    """Rows at which a held trigger changes against the row before (``seed`` at first): command Start or Stop."""
    before = F.coalesce(F.lag(level).over(Window.partitionBy(key).orderBy(*order)), F.lit(seed))
    t = df.withColumn("_edge", F.col(level) != before)
    return t.where("_edge").drop("_edge").withColumn("command", F.when(F.col(level), "Start").otherwise("Stop"))


def momentary_toggles(df: DataFrame, modifiers: str, required: int, mask: int, repeat: str) -> DataFrame:
    """Presses with exactly the ``required`` modifiers (of those in ``mask``), repeats dropped: command Toggle."""
    exact = F.col(modifiers).bitwiseAND(F.lit(mask)) == required
    return df.where(exact & ~F.col(repeat)).withColumn("command", F.lit("Toggle"))


def dispatch_commands(df: DataFrame, key: str, order: list[str], command: str = "command", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``recording`` after each command, and ``action``: SessionStarted, SessionEnded or Continue.

    Start records, Stop idles, Toggle flips; a command that changes nothing continues. The state is
    that of the last Start or Stop, flipped by the parity of the toggles since. A key above
    ``range_rows`` rows is scanned by ranges, here and below (``scan``).
    """
    c = F.col(command)
    s = Scan(df, [key], order, range_rows).with_states(_toggles=State("sum", (c == "Toggle").cast("long"), default=F.lit(0)))
    on = F.when(c == "Start", 1).when(c == "Stop", 0)
    s = s.with_states(_set=State("last", F.when(on.isNotNull(), F.struct(on.alias("on"), F.col("_toggles").alias("at")))))
    state = (F.coalesce(F.col("_set.on"), F.lit(0)) + F.col("_toggles") - F.coalesce(F.col("_set.at"), F.lit(0))) % 2 == 1
    s = s.with_columns({"recording": state}).with_states(_was=State("lag", F.col("recording"), default=F.lit(False)))
    action = F.when(F.col("recording") & ~F.col("_was"), "SessionStarted").when(~F.col("recording") & F.col("_was"), "SessionEnded").otherwise("Continue")
    return s.rows().withColumn("action", action).drop("_toggles", "_set", "_was")


def discard_not_ready(commands: DataFrame, phases: DataFrame, key: str, ts: str) -> DataFrame:
    """``commands`` with ``phase``, the one in force at ``ts``, and ``accepted``: only those that meet Ready.

    A phase lasts from its ``ts`` to the key's next one; the latest at or before a command is found by
    an as-of union.
    """
    from overlapkit.operators.series import as_of

    return as_of(commands, phases, key, ts, ["phase"]).withColumn("accepted", F.coalesce(F.col("phase") == "Ready", F.lit(False)))


def sessionize(events: DataFrame, key: str, order: list[str], ts: str = "ts") -> DataFrame:
    """(key, session_no, started, ended, end_reason, duration_s, partials, activities), a row a session.

    A session begins at SessionStarted and ends at the first SessionCompleted, or fatal Error, after
    it ("completed", "error"), at the next start ("superseded"), or not ("open").
    """
    t = events.withColumn("session_no", F.sum((F.col("event_type") == "SessionStarted").cast("long")).over(_so_far(key, order))).where("session_no > 0")
    fatal = (F.col("event_type") == "Error") & ~F.coalesce(F.col("recoverable"), F.lit(False))
    end = F.when(F.col("event_type") == "SessionCompleted", "completed").when(fatal, "error")
    t = t.withColumn("_end", end)
    w = Window.partitionBy(key, "session_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_over", F.coalesce(F.max(F.col("_end").isNotNull()).over(w), F.lit(False))).where("not _over")
    g = t.groupBy(key, "session_no").agg(
        F.min(F.when(F.col("event_type") == "SessionStarted", F.col(ts))).alias("started"),
        F.max(F.when(F.col("_end").isNotNull(), F.col(ts))).alias("ended"), F.max("_end").alias("_reason"),
        F.sum((F.col("event_type") == "PartialTranscript").cast("long")).alias("partials"), F.sum((F.col("event_type") == "Activity").cast("long")).alias("activities"),
        F.max_by("outcome", F.struct(F.col("_end").isNotNull(), ts)).alias("_outcome"), F.max_by("chars", F.struct(F.col("_end").isNotNull(), ts)).alias("_chars"),
    )
    last = F.lead("session_no").over(Window.partitionBy(key).orderBy("session_no")).isNull()
    reason = F.coalesce("_reason", F.when(last, "open").otherwise("superseded"))
    seconds = F.round((micros("ended") - micros("started")) / 1e6, 6)
    done = F.col("_reason") == "completed"
    return g.select(key, "session_no", "started", "ended", reason.alias("end_reason"), seconds.alias("duration_s"), "partials", "activities",
                    F.when(done, F.col("_outcome")).alias("outcome"), F.when(done, F.col("_chars")).alias("chars"))


def drop_stale_completions(events: DataFrame, key: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``events`` with ``stale``: a completion while no session is tracked. Starts track; completions and errors end it."""
    kind = F.col("event_type")
    flag = F.when(kind == "SessionStarted", True).when(kind.isin("SessionCompleted", "Error"), False)
    t = Scan(events, [key], order, range_rows).with_states(_tracked=State("last", flag, before=True, default=F.lit(False))).rows()
    return t.withColumn("stale", (kind == "SessionCompleted") & ~F.col("_tracked")).drop("_tracked")


def classify_errors(events: DataFrame, sessions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Errors with ``effect``: "aborts" its session if fatal, else "continues"; "no session" outside one; and that session's end."""
    t = events.withColumn("session_no", F.sum((F.col("event_type") == "SessionStarted").cast("long")).over(_so_far(key, order)))
    errors = t.where("event_type = 'Error'")
    j = errors.join(sessions.select(key, "session_no", "ended", "end_reason"), [key, "session_no"], "left")
    inside = F.col("end_reason").isNotNull() & (F.col("ended").isNull() | (F.col("ts") <= F.col("ended")))
    effect = F.when(~inside, "no session").when(F.col("recoverable"), "continues").otherwise("aborts")
    return j.select(*events.columns, "session_no", "end_reason", effect.alias("effect"))


def outcome_deadlines(events: DataFrame, key: str, order: list[str], ts: str = "ts") -> DataFrame:
    """Completions and recoverable errors with ``deadline``: when their display ends, null for never.

    By outcome, plus a margin; Failed stays. ``cancelled`` says that a start comes before the deadline.
    """
    kind = F.col("event_type")
    ms: Column = F.when((kind == "Error") & F.col("recoverable"), RECOVERABLE_MS)
    for name, show in SHOW_MS.items():
        ms = ms.when((kind == "SessionCompleted") & (F.col("outcome") == name), show)
    following = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    t = events.withColumn("next_start", F.min(F.when(kind == "SessionStarted", F.col(ts))).over(following))
    t = t.where((kind == "SessionCompleted") | ((kind == "Error") & F.col("recoverable"))).withColumn("_ms", ms + MARGIN_MS)
    t = t.withColumn("deadline_us", (micros(ts) + F.col("_ms") * 1000).cast("long"))
    return t.withColumn("cancelled", F.coalesce(micros("next_start") < F.col("deadline_us"), F.lit(False))).drop("_ms")


def session_rollup(sessions: DataFrame, key: str) -> DataFrame:
    """Per key and day: sessions, outcomes by class, characters delivered, and the share of blank results."""
    done = F.col("end_reason") == "completed"
    return sessions.groupBy(key, F.to_date("started").alias("day")).agg(
        F.count("*").alias("sessions"), F.sum(done.cast("long")).alias("completed"), F.sum((F.col("end_reason") == "error").cast("long")).alias("aborted"),
        *[F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o.lower()) for o in ("Inserted", "ClipboardOnly", "Failed", "NothingToInject")],
        F.coalesce(F.sum(F.when(F.col("outcome").isin("Inserted", "ClipboardOnly"), F.col("chars"))), F.lit(0)).cast("long").alias("delivered_chars"),
        F.round(F.avg(F.when(done, (F.col("outcome") == "NothingToInject").cast("double"))), 6).alias("blank_rate"),
    )


def view_state(events: DataFrame, key: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """What is shown after each event: ``recording``, ``confirmed`` and ``unconfirmed`` text since the last reset.

    Starts, completions and errors reset; a partial sets both texts, but for null ones.
    """
    kind = F.col("event_type")
    reset = kind.isin("SessionStarted", "SessionCompleted", "Error")
    text = lambda c: F.when(reset, F.lit("")).when(kind == "PartialTranscript", F.col(c))
    s = Scan(events.withColumnsRenamed({"confirmed": "_c", "unconfirmed": "_u"}), [key], order, range_rows).with_states(
        recording=State("last", F.when(reset, kind == "SessionStarted"), default=F.lit(False)),
        confirmed=State("last", text("_c"), default=F.lit("")), unconfirmed=State("last", text("_u"), default=F.lit("")),
    )
    return s.rows().select(*events.columns, "recording")


def status_of(recording: Column, permissions_missing: Column, launch_blocked: Column, model: Column, percent: Column, engine: Column) -> Column:
    """One status by strict priority from the latest value of each attribute."""
    return (
        F.when(recording, "Recording").when(permissions_missing, "PermissionsMissing").when(launch_blocked, "RelaunchRequired")
        .when(model.isin("Missing", "Failed"), "ModelMissing")
        .when(model == "Downloading", F.concat(F.lit("Downloading("), F.floor(F.least(F.greatest(F.coalesce(percent, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 100 + 0.5).cast("int"), F.lit(")")))
        .when(model == "Verifying", "Verifying").when(engine == "Failed", "EngineFailed").when(engine == "Loading", "EngineLoading").otherwise("Ready")
    )


def latest_attributes(attrs: DataFrame, key: str, attr: str, value: str, order: list[str], names: list[str]) -> DataFrame:
    """(key, a column per name): each attribute's latest value; two aggregations, no window."""
    last = attrs.groupBy(key, attr).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    return last.groupBy(key).pivot(attr, names).agg(F.first("_v"))


def stop_to_result_latency(commands: DataFrame, results: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """(key, stop_us, latency_s): each stop paired with the key's first result after it, if before the next stop."""
    both = commands.select(key, ts, F.lit(0).alias("_kind")).unionByName(results.select(key, ts, F.lit(1).alias("_kind")))
    w = Window.partitionBy(key).orderBy(ts, "_kind")
    t = both.withColumn("_next", F.lead("_kind").over(w)).withColumn("_at", F.lead(ts).over(w)).where("_kind = 0 and _next = 1")
    return t.select(key, micros(ts).alias("stop_us"), F.round((micros("_at") - micros(ts)) / 1e6, 6).alias("latency_s"))


def latency_percentiles(latencies: DataFrame) -> DataFrame:
    """(n, p50, p90, p99), exact, between ranks by straight lines; one row, null without latencies.

    Values are counted, dealt by ranges, and ranked by sums within and before their range, so that no
    task holds them all.
    """
    spark, at = latencies.sparkSession, scratch_dir(latencies.sparkSession)
    counts = latencies.where("latency_s is not null").groupBy("latency_s").agg(F.count("*").alias("n"))
    counts.repartitionByRange("latency_s").withColumn("_part", F.spark_partition_id()).write.parquet(at)  # the ranges stay as they are
    ranged = spark.read.schema("latency_s double, n long, _part int").parquet(at)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy("_part").agg(F.sum("n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy("latency_s")
    last = F.col("_start") + F.sum("n").over(own) - 1
    total = ranged.agg(F.sum("n").alias("_all"))
    r = ranged.join(starts, "_part").withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("n") + 1).crossJoin(F.broadcast(total))  # one row
    out = [F.coalesce(F.max("_all"), F.lit(0)).alias("n")]
    for q in (50, 90, 99):
        place = F.col("_all").cast("double") * (q / 100) - q / 100
        value = lambda rank: F.max(F.when(rank.between(F.col("_first"), F.col("_last")), F.col("latency_s")))
        low, part = value(F.floor(place)), F.max(place - F.floor(place))
        out.append(F.round(low + (value(F.ceil(place)) - low) * part, 6).alias(f"p{q}"))
    return r.agg(*out)
