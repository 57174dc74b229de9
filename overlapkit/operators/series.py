"""Operators on signal series: long tables of (key, order, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapkit.functions import fold_rows, micros
from overlapkit.operators.scan import RANGE_ROWS, Scan, State


def _running(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def downmix(df: DataFrame, key: str, idx: str, value: str, channels: int) -> DataFrame:
    """Mean over each ``channels`` interleaved values; a short last group by its own length."""
    if channels < 1:
        raise ValueError("channels is positive")
    g = F.floor(F.col(idx) / channels).cast("long")
    return df.groupBy(key, g.alias(idx)).agg(F.avg(value).alias(value))


def resample_grid(df: DataFrame, key: str, ts: str, value: str, step: int, fill: bool = False) -> DataFrame:
    """(key, bucket, value): the mean of each ``step`` seconds; the last, short bucket is kept.

    With ``fill`` every bucket from a key's first to its last has a row, empty ones with the value
    before them.
    """
    b = df.groupBy(key, F.floor(micros(ts) / (step * 1_000_000)).cast("long").alias("bucket")).agg(F.avg(value).alias(value))
    if not fill:
        return b
    span = b.groupBy(key).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = span.select(key, F.explode(F.sequence("lo", "hi")).alias("bucket"))
    g = grid.join(b, [key, "bucket"], "left")
    return g.select(key, "bucket", F.last(value, ignorenulls=True).over(_running(key, "bucket")).alias(value))


def block_rms(df: DataFrame, key: str, idx: str, value: str, block: int) -> DataFrame:
    """(key, block_no, rms): root of the mean square; a block of nulls alone has 0."""
    no = F.floor(F.col(idx) / block).cast("long")
    return df.groupBy(key, no.alias("block_no")).agg(F.coalesce(F.sqrt(F.avg(F.col(value) * F.col(value))), F.lit(0.0)).alias("rms"))


def frame_chunks(df: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """(key, frame_no, values): full frames of ``size`` values; what is left at the end has no frame."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    t = df.withColumn("_n", n).withColumn("frame_no", F.floor(F.col("_n") / size).cast("long"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("_v")))), lambda x: x["_v"])
    return t.groupBy(key, "frame_no").agg(values.alias("values")).where(F.size("values") == size)


def hysteresis_gate(df: DataFrame, key: str, order: list[str], p: str, enter: float = 0.35, leave: float = 0.20, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``active``: on above ``enter``, off below ``leave``, else as before; off at first.

    A key above ``range_rows`` rows is scanned by ranges, here and in the operators below (``scan``).
    """
    return _gated(Scan(df, [key], order, range_rows), p, enter, leave).rows()


def _gated(s: Scan, p: str, enter: float, leave: float) -> Scan:
    if enter < leave:
        raise ValueError("enter is not below leave")
    mark = F.when(F.col(p) > enter, True).when(F.col(p) < leave, False)
    return s.with_states(active=State("last", mark, default=F.lit(False)))


def _silent(s: Scan, frame_ms: int) -> Scan:
    """With silence_ms: frames since the last active one, or since the start."""
    s = s.with_states(_n=State("sum", F.lit(1)))
    s = s.with_states(_on=State("max", F.when(F.col("active"), F.col("_n")), default=F.lit(0)))
    return s.with_columns({"silence_ms": ((F.col("_n") - F.col("_on")) * frame_ms).cast("long")})


def trailing_silence(df: DataFrame, key: str, order: list[str], frame_ms: int = 32, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``silence_ms`` up to and with each frame of ``df`` (with ``active``): 0 on active frames."""
    return _silent(Scan(df, [key], order, range_rows), frame_ms).rows().drop("_n", "_on")


def utterances(df: DataFrame, key: str, order: list[str], min_silence_ms: int = 800, frame_ms: int = 32, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, utterance_no, first_frame, last_frame, frames, duration_ms) of active islands.

    A pause shorter than ``min_silence_ms`` does not end an utterance.
    """
    s = Scan(df.select(key, *order, "active"), [key], order, range_rows).with_states(_n=State("sum", F.lit(1), before=True, default=F.lit(0)))
    s = s.where("active").with_states(_last=State("lag", F.col("_n")))
    new = F.coalesce(((F.col("_n") - F.col("_last") - 1) * frame_ms >= min_silence_ms).cast("long"), F.lit(1))
    t = s.with_states(_no=State("sum", new)).rows().withColumn("utterance_no", F.col("_no") - 1)
    u = t.groupBy(key, "utterance_no").agg(F.min("_n").cast("long").alias("first_frame"), F.max("_n").cast("long").alias("last_frame"), F.count("*").alias("frames"))
    return u.withColumn("duration_ms", (F.col("last_frame") - F.col("first_frame") + 1) * frame_ms)


def endpoints(df: DataFrame, key: str, order: list[str], min_silence_ms: int = 800, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of ``df`` (with active and silence_ms) that end a pause's wait: one for each pause.

    The first frame at which silence reaches the threshold after speech; silence before any never does.
    """
    s = Scan(df, [key], order, range_rows).with_states(_spoke=State("max", F.col("active")), _before=State("lag", F.col("silence_ms"), default=F.lit(0)))
    end = F.coalesce(F.col("_spoke"), F.lit(False)) & (F.col("silence_ms") >= min_silence_ms) & (F.col("_before") < min_silence_ms)
    return s.where(end).rows().drop("_spoke", "_before")


def cadence_thin(df: DataFrame, key: str, order: list[str], at: str, interval: int) -> DataFrame:
    """The rows kept: ``interval`` or more after the last kept one, with speech (``active``) since it.

    ``at`` is a long column; the first speech passes at once. A true recurrence, so a sorted fold.
    """

    def step(state: dict, row: dict) -> list[dict]:
        state["spoke"] = state["spoke"] or bool(row["active"])
        if state["spoke"] and row[at] is not None and (state["last"] is None or row[at] - state["last"] >= interval):
            state.update(last=row[at], spoke=False)
            return [row]
        return []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return fold_rows(df, [key], order, lambda: {"last": None, "spoke": False}, step, schema)


def zero_crossings(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n, crossings): neighbours of which one is below zero and the other is not."""
    up = F.col(value) >= 0
    t = df.withColumn("_flip", (up != F.lag(up).over(Window.partitionBy(key).orderBy(*order))).cast("long"))
    return t.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum("_flip"), F.lit(0)).alias("crossings"))


def gap_audit(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, after, missing): where numbers are lost from a sequence, and how many."""
    t = df.select(key, seq).distinct().withColumn("after", F.lag(seq).over(Window.partitionBy(key).orderBy(seq)))
    return t.select(key, "after", (F.col(seq) - F.col("after") - 1).cast("long").alias("missing")).where("missing > 0")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """``left`` with the latest ``values`` of ``right`` at or before its ``ts``: a union and a running last."""
    right_rows = right.select(key, ts, F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, ts)], F.struct(*values).alias("_v"))
    v_type = right_rows.schema["_v"].dataType
    left_rows = left.select(key, ts, F.lit(1).alias("_side"), *[c for c in left.columns if c not in (key, ts)], F.lit(None).cast(v_type).alias("_v"))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = right_rows.unionByName(left_rows).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def decayed_activity(events: DataFrame, ticks: DataFrame, key: str, ts: str, level: str) -> DataFrame:
    """``ticks`` with ``activity``: the last level x 0.95 ^ (10 x seconds since) + 0.05, within 0.02 and 1."""
    e = events.groupBy(key, ts).agg(F.max(level).alias("_level")).withColumn("_at", F.col(ts))
    t = as_of(ticks, e, key, ts, ["_level", "_at"])
    seconds = (micros(ts) - micros("_at")) / 1e6
    faded = F.coalesce(F.col("_level") * F.pow(F.lit(0.95), seconds * 10), F.lit(0.0)) + 0.05
    return t.withColumn("activity", F.least(F.greatest(faded, F.lit(0.02)), F.lit(1.0))).drop("_level", "_at")


def frame_argmax(df: DataFrame, column: str, ties: str = "low") -> DataFrame:
    """``argmax``: the place (from 0) of the largest value, the first or the last of equals."""
    if ties not in ("low", "high"):
        raise ValueError("ties is low or high")
    arr, top = F.col(column), F.array_max(column)
    found: Column = F.array_position(arr, top) - 1
    if ties == "high":
        found = F.size(arr) - F.array_position(F.reverse(arr), top)
    return df.withColumn("argmax", F.when(F.size(arr) > 0, found).cast("long"))
