"""Queries of the series operators over ``events`` (a series a user) and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from overlapkit.functions import activity_level, micros, normalize_samples
from overlapkit.operators import series
from overlapkit.plans import fixtures as fx
from overlapkit.plans import read

K, ORDER, PAUSE = "series_id", ["ts", "event_id"], 96


def _gated(spark, sf_dir):
    return series.hysteresis_gate(fx.frames(spark, sf_dir), K, ORDER, "prob")


def _silent(spark, sf_dir):
    return series.trailing_silence(_gated(spark, sf_dir), K, ORDER)


def s1_read_frames(spark, sf_dir):
    from overlapkit.sources import read_frames

    e = read_frames(spark, f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def a1_normalize_samples(spark, sf_dir):
    s = fx.series(spark, sf_dir).withColumn("raw", F.floor("value").cast("int"))
    return s.groupBy(K).agg(F.round(F.sum(normalize_samples(F.col("raw"), "i16")), 8).alias("i16"), F.round(F.sum(normalize_samples(F.col("raw"), "u16")), 6).alias("u16"))


def a2_downmix(spark, sf_dir):
    return series.downmix(fx.series(spark, sf_dir), K, "idx", "value", 3).withColumn("value", F.round("value", 6))


def a3_resample_grid(spark, sf_dir):
    return series.resample_grid(fx.series(spark, sf_dir), K, "ts", "value", 86_400, fill=True).withColumn("value", F.round("value", 6))


def a4_block_rms(spark, sf_dir):
    r = series.block_rms(fx.series(spark, sf_dir), K, "idx", "value", 8)
    return r.select(K, "block_no", F.round("rms", 6).alias("rms"), F.round(activity_level(F.col("rms") / 1000), 6).alias("level"))


def a6_frame_chunks(spark, sf_dir):
    f = series.frame_chunks(fx.series(spark, sf_dir), K, ORDER, "event_id", 5)
    return f.select(K, "frame_no", F.array_join("values", ",").alias("ids"))


def a7_hysteresis_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select(K, "frame_no", "active")


def a8_trailing_silence(spark, sf_dir):
    return _silent(spark, sf_dir).select(K, "frame_no", "silence_ms")


def a9_utterances(spark, sf_dir):
    return series.utterances(_gated(spark, sf_dir), K, ORDER, PAUSE)


def a10_endpoints(spark, sf_dir):
    return series.endpoints(_silent(spark, sf_dir), K, ORDER, PAUSE).select(K, "frame_no", "silence_ms")


def a11_cadence_thin(spark, sf_dir):
    g = _gated(spark, sf_dir).withColumn("at", micros("ts"))
    return series.cadence_thin(g, K, ORDER, "at", 86_400_000_000).select(K, "frame_no", "at")


def a12_zero_crossings(spark, sf_dir):
    s = fx.series(spark, sf_dir).withColumn("value", F.col("value") - 50)
    return series.zero_crossings(s, K, ORDER, "value")


def a13_gap_audit(spark, sf_dir):
    return series.gap_audit(fx.series(spark, sf_dir).where("event_id % 17 != 0"), K, "idx")


def a14_decayed_activity(spark, sf_dir):
    s = fx.series(spark, sf_dir).withColumn("level", F.least(F.col("value") / 100, F.lit(1.0)))
    span = s.groupBy(K).agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("lo"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("hi"))
    ticks = span.select(K, F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("ts"))
    return series.decayed_activity(s, ticks, K, "ts", "level").withColumn("activity", F.round("activity", 6))


def a15_frame_argmax(spark, sf_dir):
    e = series.frame_argmax(read(spark, sf_dir, "embeddings"), "embedding").withColumnRenamed("argmax", "low")
    return series.frame_argmax(e, "embedding", "high").select("vec_id", "low", F.col("argmax").alias("high"))


QUERIES = {
    f.__name__: f
    for f in (
        s1_read_frames, a1_normalize_samples, a2_downmix, a3_resample_grid, a4_block_rms, a6_frame_chunks, a7_hysteresis_gate, a8_trailing_silence,
        a9_utterances, a10_endpoints, a11_cadence_thin, a12_zero_crossings, a13_gap_audit, a14_decayed_activity, a15_frame_argmax,
    )
}

S, FR = fx.SERIES, fx.FRAMES
_GATE = f"""SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING), false) AS active
 FROM (SELECT *, CASE WHEN prob > 0.35 THEN true WHEN prob < 0.20 THEN false END AS mark FROM ({FR}))"""
_SIL = f"""SELECT *, (frame_no - coalesce(max(CASE WHEN active THEN frame_no END) OVER (PARTITION BY series_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING), -1)) * 32 AS silence_ms FROM ({_GATE})"""
ORACLE = {
    "s1_read_frames": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "a1_normalize_samples": f"SELECT series_id, round(sum(floor(value)::INT / 32767.0::DOUBLE), 8) AS i16, round(sum((floor(value)::INT - 32768) / 32768.0::DOUBLE), 6) AS u16 FROM ({S}) GROUP BY 1",
    "a2_downmix": f"SELECT series_id, idx // 3 AS idx, round(avg(value), 6) AS value FROM ({S}) GROUP BY ALL",
    "a3_resample_grid": f"""WITH b AS (SELECT series_id, floor(epoch_us(ts) / 86400000000)::BIGINT AS bucket, avg(value) AS v FROM ({S}) GROUP BY ALL),
 g AS (SELECT series_id, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM b GROUP BY 1)
 SELECT series_id, bucket, round(last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), 6) AS value FROM g LEFT JOIN b USING (series_id, bucket)""",
    "a4_block_rms": f"""SELECT series_id, block_no, round(rms, 6) AS rms, round(CASE WHEN rms > 0 THEN least(greatest((20 * log10(rms / 1000) + 50) / 50, 0.0), 1.0) ELSE 0.0 END, 6) AS level
 FROM (SELECT series_id, idx // 8 AS block_no, sqrt(avg(value * value)) AS rms FROM ({S}) GROUP BY ALL)""",
    "a6_frame_chunks": f"SELECT series_id, idx // 5 AS frame_no, string_agg(event_id::VARCHAR, ',' ORDER BY idx) AS ids FROM ({S}) GROUP BY ALL HAVING count(*) = 5",
    "a7_hysteresis_gate": f"SELECT series_id, frame_no, active FROM ({_GATE})",
    "a8_trailing_silence": f"SELECT series_id, frame_no, silence_ms FROM ({_SIL})",
    "a9_utterances": f"""SELECT series_id, u - 1 AS utterance_no, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS frames, (max(frame_no) - min(frame_no) + 1) * 32 AS duration_ms FROM
 (SELECT *, sum(new)::BIGINT OVER (PARTITION BY series_id ORDER BY frame_no) AS u FROM (SELECT *, CASE WHEN (frame_no - lag(frame_no) OVER (PARTITION BY series_id ORDER BY frame_no) - 1) * 32 < {PAUSE} THEN 0 ELSE 1 END AS new
 FROM ({_GATE}) WHERE active)) GROUP BY ALL""".replace("sum(new)::BIGINT OVER (PARTITION BY series_id ORDER BY frame_no)", "(sum(new) OVER (PARTITION BY series_id ORDER BY frame_no))::BIGINT"),
    "a10_endpoints": f"""SELECT series_id, frame_no, silence_ms FROM (SELECT *, sum(active::INT) OVER (PARTITION BY series_id ORDER BY frame_no) AS spoke, lag(silence_ms) OVER (PARTITION BY series_id ORDER BY frame_no) AS prev
 FROM ({_SIL})) WHERE spoke > 0 AND silence_ms >= {PAUSE} AND coalesce(prev, 0) < {PAUSE}""",
    "a11_cadence_thin": f"""WITH RECURSIVE g AS (SELECT series_id, frame_no, active, epoch_us(ts) AS us, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) AS k FROM ({_GATE})),
 r AS (SELECT series_id, 0::BIGINT AS k, NULL::BIGINT AS frame_no, NULL::BIGINT AS us, false AS kept, NULL::BIGINT AS last, false AS spoke FROM (SELECT DISTINCT series_id FROM g)
  UNION ALL SELECT series_id, k, frame_no, us, take, CASE WHEN take THEN us ELSE last END, speech AND NOT take FROM
   (SELECT g.*, r.last, r.spoke OR g.active AS speech, (r.spoke OR g.active) AND (r.last IS NULL OR g.us - r.last >= 86400000000) AS take FROM r JOIN g ON g.series_id = r.series_id AND g.k = r.k + 1))
 SELECT series_id, frame_no, us AS "at" FROM r WHERE kept""",
    "a12_zero_crossings": f"""SELECT series_id, count(*) AS n, coalesce(sum(CASE WHEN up <> prev THEN 1 ELSE 0 END), 0)::BIGINT AS crossings FROM
 (SELECT series_id, value - 50 >= 0 AS up, lag(value - 50 >= 0) OVER (PARTITION BY series_id ORDER BY idx) AS prev FROM ({S})) GROUP BY 1""",
    "a13_gap_audit": f"""SELECT series_id, prev AS after, idx - prev - 1 AS missing FROM (SELECT series_id, idx, lag(idx) OVER (PARTITION BY series_id ORDER BY idx) AS prev FROM ({S}) WHERE event_id % 17 <> 0) WHERE idx - prev > 1""",
    "a14_decayed_activity": f"""WITH s AS (SELECT series_id, ts, max(least(value / 100, 1.0)) AS level FROM ({S}) GROUP BY ALL),
 k AS (SELECT series_id, unnest(range(date_trunc('day', min(ts))::TIMESTAMP, date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS ts FROM s GROUP BY 1)
 SELECT k.series_id, k.ts, round(least(greatest(coalesce(s.level * pow(0.95, (epoch_us(k.ts) - epoch_us(s.ts)) / 1e6 * 10), 0.0) + 0.05, 0.02), 1.0), 6) AS activity
 FROM k ASOF LEFT JOIN s ON k.series_id = s.series_id AND k.ts >= s.ts""",
    "a15_frame_argmax": """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS low, len(embedding) - list_position(list_reverse(embedding), list_max(embedding)) AS high FROM embeddings""",
}
