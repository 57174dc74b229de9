"""Queries of the streaming operators: ``events`` as a stream, drained, against the batch twins' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from overlapkit import streaming as st
from overlapkit.functions import micros
from overlapkit.operators import windows
from overlapkit.plans import fixtures as fx
from overlapkit.plans import inventory, read, seams, sessions
from overlapkit.sources import delete, read_frames, scratch_dir


KEY = "series_id"
FILES, FILE_ROWS = 2, 5_000  # least number of files in a part and a micro-batch, and of rows in a file of a larger one


def _in_parts(spark, rows, parts, closing=None, counted=None, at=None, dealt=None):
    """``rows`` as a stream, a micro-batch a condition of ``parts``, written to a folder one after the other (``at``: one that only this stream reads).

    Every part has as many files, which grow with the smallest one (``counted``: rows that are counted in
    their place) up to the number of shuffle partitions. ``closing``: days after the last ``ts`` at which rows
    without any other value come as a part of their own, and once more after as many: they move the
    watermark past all that waits. ``dealt``: rows lie in as many partitions already, and are written from there
    without a shuffle (of a part that leaves a partition empty there is a file less, and its batch takes one of the next part).
    """
    once, at = bool(at), at or scratch_dir(spark)
    found = (rows if counted is None else counted).agg(*[F.count_if(part) for part in parts]).first()
    files = max(FILES, min(min(found) // FILE_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = min(files, dealt or files)
    for part in parts:
        own = rows.where(part)
        (own.coalesce(files) if dealt else own.repartition(files)).write.mode("append").option("compression", "zstd").parquet(at)
    if closing:
        last = rows.schema["ts"].dataType
        end = spark.read.schema(rows.schema).parquet(at).agg(F.max("ts").alias("ts"))  # one row
    for k in (1, 2) if closing else ():
        copies = spark.range(0, files, 1, files).crossJoin(F.broadcast(end.select((F.col("ts") + F.expr(f"interval {k * closing} days")).alias("ts"))))
        copies = copies.select(*[F.col("ts").cast(last) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
        copies.write.mode("append").parquet(at)
    return read_frames(spark, at, rows.schema, streaming=True, files=files, once=once).withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, sf_dir, closing=None, late=False):
    """``events`` as a stream of three micro-batches by time; the parts' bounds are two percentiles of the time column.

    ``late``: every fifth event up to half a day later comes a micro-batch after its own, out of order.
    """
    e = read(spark, sf_dir, "events").withColumn("_us", micros("ts"))
    first, second = e.agg(F.percentile_approx("_us", [0.33, 0.66])).first()[0] or (0, 0)
    us = F.col("_us")
    if late:
        us = us + F.when(F.coalesce(F.col("event_id") % 5 == 0, F.lit(False)), 43_200_000_000).otherwise(0)
    parts = (us <= first, (us > first) & (us <= second), F.coalesce(us > second, F.lit(True)))
    return _in_parts(spark, e, parts, closing).drop("_us")


class _Source:
    """Reads ``events`` as a stream where a batch plan would read the table."""

    def __init__(self, spark):
        self.read, self._spark = self, spark

    def parquet(self, path):
        return _stream(self._spark, path.rsplit("/", 1)[0], closing=30, late=True)


def _session_events(spark, sf_dir):
    return sessions.session_events(_Source(spark), sf_dir)


def st1_stream_activity(spark, sf_dir):
    s = st.stream_activity(_stream(spark, sf_dir), "user_id", "ts", "value", "1 day", full_scale=1000.0)
    s = s.select("user_id", F.unix_micros("window.start").alias("start_us"), "n", F.round("rms", 6).alias("rms"), F.round("level", 6).alias("level"))
    return st.newest(st.run_available(s, "update"), ["user_id", "start_us"])


def st1_stream_sliding(spark, sf_dir):
    """Days that begin every six hours, from panes of six hours; in append mode."""
    s = st.stream_activity(_stream(spark, sf_dir, closing=30), "user_id", "ts", "value", "1 day", "6 hours", full_scale=1000.0)
    s = s.select("user_id", F.unix_micros("window.start").alias("start_us"), "n", F.round("rms", 6).alias("rms"), F.round("level", 6).alias("level"))
    return st.run_available(s, "append").where("user_id is not null").drop("batch")


def st2_stream_utterances(spark, sf_dir):
    """In append mode: a closing row moves the watermark past all utterances."""
    e = _stream(spark, sf_dir, closing=30).withColumn("active", F.coalesce(F.col("value") > 35, F.lit(False)))
    s = st.stream_utterances(e, "user_id", "ts", gap="12 hours")
    s = s.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")
    return st.run_available(s, "append").drop("batch")


def st3_stream_transcript(spark, sf_dir):
    e = _session_events(spark, sf_dir).withColumn("token", F.when(F.col("event_type") == "PartialTranscript", F.col("confirmed")))
    return st.run_available(st.stream_transcript(e), "append").drop("batch")


def st3_stream_splice(spark, sf_dir):
    """The windows of every document, scored apart, as a stream in which every third one comes late; spliced in state."""
    at, parts, cores = scratch_dir(spark), read(spark, sf_dir, "documents").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    w = fx.window_arrays(spark, sf_dir, dealt=parts < cores)  # texts of few splits are shuffled, windows never
    w = w.select(KEY, F.timestamp_seconds((F.col("window_no") + 1) * 60).alias("ts"), "window_no", "toks")
    late = F.col("window_no") % 3 == 1
    plan = windows.plan_windows(fx.lengths(spark, sf_dir), KEY, "n", fx.W, fx.OVERLAP, 1).where("len > 0")
    dealt = parts if parts >= cores else int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = _in_parts(spark, w, (~late, late), closing=30, counted=plan, at=at, dealt=dealt)
    rows = st.run_available(st.stream_splice(stream, KEY, fx.OVERLAP, 0), "append")
    delete(spark, at)
    return st.spliced_text(rows, KEY)


def st4_stream_drop_stale(spark, sf_dir):
    return st.run_available(st.stream_drop_stale(_session_events(spark, sf_dir)), "append").drop("batch")


def st5_stream_progress(spark, sf_dir):
    return st.run_available(st.stream_progress(inventory.progress(_Source(spark), sf_dir)), "append").drop("batch")


def st6_stream_terminal_latch(spark, sf_dir):
    return st.run_available(st.stream_terminal_latch(inventory.phase_events(_Source(spark), sf_dir)), "append").drop("batch")


def st7_stream_status(spark, sf_dir):
    latest = st.newest(st.run_available(st.stream_status(_stream(spark, sf_dir)), "update"), ["user_id", "attr"])
    a = latest.groupBy("user_id").pivot("attr", list(sessions.KINDS)).agg(F.first("value"))
    return a.select("user_id", sessions.status_columns(a).alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        st1_stream_activity, st1_stream_sliding, st2_stream_utterances, st3_stream_transcript, st3_stream_splice, st4_stream_drop_stale,
        st5_stream_progress, st6_stream_terminal_latch, st7_stream_status,
    )
}

ORACLE = {
    "st1_stream_activity": """SELECT user_id, epoch_us(day) AS start_us, n, round(rms, 6) AS rms, round(CASE WHEN rms > 0 THEN least(greatest((20 * log10(rms / 1000) + 50) / 50, 0.0), 1.0) ELSE 0.0 END, 6) AS level
 FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, sqrt(avg(value * value)) AS rms FROM events GROUP BY ALL)""",
    "st1_stream_sliding": """SELECT user_id, start_us, n, round(rms, 6) AS rms, round(CASE WHEN rms > 0 THEN least(greatest((20 * log10(rms / 1000) + 50) / 50, 0.0), 1.0) ELSE 0.0 END, 6) AS level
 FROM (SELECT user_id, (epoch_us(ts) // 21600000000 - k) * 21600000000 AS start_us, count(*) AS n, sqrt(avg(value * value)) AS rms FROM events, (SELECT unnest(range(0, 4)) AS k) GROUP BY ALL)""",
    "st2_stream_utterances": """WITH t AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS new FROM events WHERE value > 35),
 u AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM t) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS end_us, count(*) AS n FROM u GROUP BY user_id, g""",
    "st3_stream_splice": seams.ORACLE["entry_merge_round_trip"],
    "st4_stream_drop_stale": sessions.ORACLE["f5_drop_stale_completions"],
    "st5_stream_progress": f"SELECT user_id, event_id, received FROM ({inventory.ORACLE['g10_progress_rollup']})",
    "st6_stream_terminal_latch": inventory.ORACLE["g11_live_ticks"],
    "st7_stream_status": sessions.ORACLE["f10_composite_status"],
}
