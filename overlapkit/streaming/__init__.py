"""Streaming twins of the batch operators: decisions by event time only, in the order of event time.

State that Spark's own aggregations can't hold is kept by ``transformWithStateInPandas`` in RocksDB. Rows
may come late by up to ``delay``: they wait in a list until the watermark has passed them, then an
event-time timer releases them in order, so a row is never applied after a newer one. (Rows that come
later than that are dropped by Spark, and counted in its metrics.) A key that was silent for ``idle``
is forgotten, also by a timer. Windowed aggregations drop their state by the watermark.
``stream_status`` keeps a row a key and attribute: its answer is that table.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from overlapkit.functions import activity_level
from overlapkit.sources import delete, scratch_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A batch's checkpoint holds what it changed; without this every file that compaction makes anew is copied there again.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for the data now there: (batch, rows), written to the shared folder and read back.

    The stream's state ends with it: its checkpoint is deleted. What a batch shuffled would stay on the executors'
    disks until the driver collects its garbage (the first batch's until the stream ends); it goes once the batch is written.
    """
    spark, at = stream.sparkSession, scratch_dir(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/out/{number:06d}")
        batch._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    delete(spark, f"{at}/state")
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key: an aggregation over the batches' numbers."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def stream_activity(df: DataFrame, key: str, ts: str, value: str, size: str, slide: str | None = None, delay: str = "1 day", full_scale: float = 1.0) -> DataFrame:
    """(key, window, n, rms, level) over tumbling or sliding event-time windows.

    Sliding windows are put together from panes: rows are summed once, in tumbling windows of ``slide``,
    and each pane counts in the size / slide windows over it, so no row is copied. ``slide`` divides
    ``size``. Two aggregations in a row run in append mode.
    """
    power = F.col(value) * F.col(value)
    panes = df.withWatermark(ts, delay).groupBy(key, F.window(ts, slide or size)).agg(F.count("*").alias("n"), F.sum(power).alias("_power"), F.count(power).alias("_m"))
    if slide:
        span = lambda x: f"unix_micros(timestamp_seconds(0) + interval {x})"
        if df.sparkSession.range(1).select(F.expr(f"{span(size)} % {span(slide)}")).first()[0]:
            raise ValueError("slide divides size")
        over = F.window(F.window_time("window"), size, slide)
        panes = panes.groupBy(key, over).agg(*[F.sum(c).alias(c) for c in ("n", "_power", "_m")])
    rms = F.sqrt(F.col("_power") / F.nullif(F.col("_m"), F.lit(0)))
    return panes.select(key, "window", "n", rms.alias("rms"), activity_level(rms / full_scale).alias("level"))


def stream_utterances(df: DataFrame, key: str, ts: str, active: str = "active", gap: str = "800 milliseconds", delay: str = "1 day") -> DataFrame:
    """(key, session_window, n) of active rows; a pause of ``gap`` closes an utterance.

    Every row moves the watermark, so in append mode silence closes utterances as well.
    """
    # a predicate that reads ``ts`` stays above the watermark, which then sees rows of silence too
    on = F.when(F.col(ts).isNotNull(), F.col(active))
    return df.withWatermark(ts, delay).where(on).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def _rows(blob: bytes) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(blob).read_all().columns), strict=True)


GROUPS = 512  # of keys, which share calls to the state store


class _InOrder(StatefulProcessor):
    """Rows of each key in the order of (us, event_id), each once the watermark is past it.

    Keys are dealt to groups; a group's waiting rows of a micro-batch are one value in the state store, as
    Arrow, and its keys' states are another: calls to the store and values in it are few. ``columns`` are those of a waiting row
    after key, us and event_id. Subclasses say what a run of released rows gives and what they make of a
    key's state (``fold``; a state is whatever JSON holds, None at first), and how a silent key ends
    (``expire``). One timer a group is enough: the earliest waiting row's, or the first that ends a silence.
    """

    def __init__(self, schema: str, out: list[str], idle_ms: int):
        self.out, self.idle = out, idle_ms
        self.names = ["key", *(f.strip().split(" ")[0] for f in schema.split(","))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "rows binary")
        self.clock = handle.getValueState("clock", "timer long")

    def fold(self, key, state, rows: list[tuple]) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def expire(self, key, state) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if len(part):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(part[self.names], preserve_index=False)),))
                least = int(part["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            timer, at = self.clock.get()[0] if self.clock.exists() else None, -(-first // 1000)
            if timer is None or at < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
                self.clock.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, due, later = timerValues.getCurrentWatermarkInMs() * 1000, {}, []
        for (blob,) in self.waiting.get() if self.waiting.exists() else ():
            for r in _rows(blob):
                due.setdefault(r[0], []).append(r[1:]) if r[1] <= passed else later.append(r)
        before = {r[0]: r[1:] for r in (_rows(self.kept.get()[0]) if self.kept.exists() else ())}
        out, kept, waits = [], [], {r[0] for r in later}
        wake = [-(-r[1] // 1000) for r in later]
        for k in dict.fromkeys([*before, *due]):
            last, held = before.get(k, (None, None))
            state = json.loads(held) if held is not None else None
            if k in due:
                rows = sorted(due[k], key=lambda r: (r[:2], [(x is not None, x) for x in r[2:]]))
                state, made = self.fold(k, state, rows)
                out += made
                last, held = rows[-1][0] if last is None else max(last, rows[-1][0]), json.dumps(state)
            if k not in waits and passed >= last + self.idle * 1000:
                out += self.expire(k, state)
                continue
            kept.append((k, last, held))
            if k not in waits:
                wake.append(-(-last // 1000) + self.idle)
        if due:
            self.waiting.put([(_packed(_table(later, self.names)),)]) if later else self.waiting.clear()
        self.kept.update((_packed(_table(kept, ["key", "last", "state"])),)) if kept else self.kept.clear()
        if wake:  # the timer that fired is gone
            self.handle.registerTimer(min(wake))
            self.clock.update((min(wake),))
        else:
            self.clock.clear()
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def _in_order(processor: type[_InOrder], events: DataFrame, key: str, columns: dict[str, str], out: str, delay: str, idle_days: float, *args, need: str = "event_id") -> DataFrame:
    """``events`` (with ts and event_id) through a processor; rows without a time, a number or ``need`` take no part."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # a predicate that reads ``ts`` stays above the watermark, which all rows move
    real = F.when(F.col("ts").isNotNull(), F.col("event_id").isNotNull() & F.col(need).isNotNull())
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where(real)
    # rows without a key are a group of their own, so that whole numbers stay whole in pandas
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS))).cast("int")
    rows = rows.select(group.alias("_group"), "ts", F.col(key).alias("key"), us.alias("us"), F.col("event_id").cast("long").alias("event_id"), *[F.col(c).cast(t).alias(c) for c, t in columns.items()])
    waiting = ", ".join(["us long", "event_id long", *(f"{c} {t}" for c, t in columns.items())])
    made = processor(waiting, [f.strip().split(" ")[0] for f in out.split(",")], int(idle_days * 86_400_000), *args)
    return rows.groupBy("_group").transformWithStateInPandas(made, out, "Append", "EventTime")


class _Stale(_InOrder):
    def fold(self, key, state, rows):
        tracking, out = bool(state), []
        for _, event_id, kind in rows:
            if kind == "SessionCompleted":
                out.append((key, event_id, not tracking))
            tracking = True if kind == "SessionStarted" else False if kind in ("SessionCompleted", "Error") else tracking
        return tracking, out


def stream_drop_stale(events: DataFrame, delay: str = "1 day", idle_days: float = 30) -> DataFrame:
    """(user_id, event_id, stale) of completions; a session silent for ``idle_days`` is tracked no longer."""
    return _in_order(_Stale, events, "user_id", {"event_type": "string"}, "user_id long, event_id long, stale boolean", delay, idle_days)


class _Latch(_InOrder):
    def fold(self, key, state, rows):
        live, out = bool(state), []
        for _, event_id, kind in rows:
            live = True if kind == "start" else False if kind in ("done", "failed") else live
            if kind == "progress":
                out.append((key, event_id, live))
        return live, out


def stream_terminal_latch(events: DataFrame, delay: str = "1 day", idle_days: float = 30) -> DataFrame:
    """(user_id, event_id, live) of progress rows: late progress after an end is not live."""
    return _in_order(_Latch, events, "user_id", {"kind": "string"}, "user_id long, event_id long, live boolean", delay, idle_days)


class _Progress(_InOrder):
    """Latest bytes of each file, and their running sum, so that no event sums anew."""

    def fold(self, key, state, rows):
        received, files = state or (0, {})
        out = []
        for _, event_id, file, size in rows:
            if size is not None:
                received += int(size) - files.get(file, 0)
                files[file] = int(size)
            out.append((key, event_id, received))
        return (received, files), out


def stream_progress(deltas: DataFrame, delay: str = "1 day", idle_days: float = 30) -> DataFrame:
    """(user_id, event_id, received): the running total of the files' latest values."""
    columns = {"file": "string", "bytes": "long"}
    return _in_order(_Progress, deltas, "user_id", columns, "user_id long, event_id long, received long", delay, idle_days, need="file")


def stream_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, attr, value): each attribute's latest value, for the status; update mode."""
    return events.groupBy(key, F.col("event_type").alias("attr")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


class _Transcript(_InOrder):
    """Incremental transcript of a key: see ``stream_transcript``."""

    def __init__(self, schema: str, out: list[str], idle_ms: int, window: int, overlap: int, interval_us: int, pause_us: int):
        super().__init__(schema, out, idle_ms)
        self.window, self.overlap, self.interval, self.pause = window, overlap, interval_us, pause_us

    def fold(self, key, state, rows):
        # shown: tokens at the tail's start that a pause has promoted; flushed: no speech since the last promotion
        fresh = (False, 0, 0, None, None, False, True)
        (is_open, committed, shown, ran, spoke_at, spoke, flushed), _, tail = state or (fresh, None, [])
        out = []

        def emit(event_id: int, kind: str, confirmed: list[str]) -> None:
            out.append((key, event_id, kind, committed, " ".join(confirmed), " ".join(tail[shown:])))

        for now, event_id, event_type, recoverable, token in rows:
            if event_type == "SessionStarted":
                is_open, committed, shown, ran, spoke_at, spoke, flushed = (True, *fresh[1:])
                tail = []
                continue
            if not is_open:
                continue
            if event_type == "Error":
                emit(event_id, "error", [])
                is_open = bool(recoverable)
                continue
            if event_type == "SessionCompleted":
                new, is_open = tail[shown:], False
                committed, shown = committed + len(new), len(tail)
                emit(event_id, "final", new)
                tail, shown = [], 0
                continue
            if token:
                tail, spoke_at, spoke, flushed = [*tail, *token.split(" ")], now, True, False
            if not flushed and now - spoke_at >= self.pause:  # shown once more, then promoted, once a pause
                emit(event_id, "partial", [])
                new = tail[shown:]
                committed, shown = committed + len(new), len(tail)
                emit(event_id, "promote", new)
                ran, spoke, flushed = now, False, True
            in_this_block = False
            while len(tail) >= self.window:  # a long block may fill several windows
                step = self.window - self.overlap
                new = tail[min(shown, step) : step]
                committed += len(new)
                tail, shown = tail[step:], max(0, shown - step)
                emit(event_id, "commit", new)
                ran, spoke, in_this_block = now, False, True
            if not in_this_block and spoke and (ran is None or now - ran >= self.interval):
                emit(event_id, "partial", [])
                ran, spoke = now, False
        return ((is_open, committed, shown, ran, spoke_at, spoke, flushed), rows[-1][1], tail), out

    def expire(self, key, state):
        (is_open, committed, shown, *_), event_id, tail = state
        return [(key, event_id, "unexpected end", committed, "", " ".join(tail[shown:]))] if is_open else []


def stream_transcript(
    events: DataFrame, window: int = 4, overlap: int = 1, interval_us: int = 86_400_000_000, pause_us: int = 43_200_000_000, delay: str = "1 day", idle_days: float = 30
) -> DataFrame:
    """(user_id, event_id, kind, committed, confirmed, unconfirmed) of an event stream with ``token``.

    A start opens a transcript and forgets what was before; tokens gather in a tail, the open window,
    which is the only text in state. A block without speech ``pause_us`` or more after the last speech
    shows the tail once more and promotes it: confirmed, while the window stays open. Each full window
    commits all but its overlap, as often as the tail holds one. A partial shows what is not confirmed,
    at most once per ``interval_us``, only after new speech, and not in a block that committed; commits
    and promotions count as partials for the interval. Completion confirms the rest as final; an error
    gives a row, and closes unless recoverable. A transcript still open after ``idle_days`` of silence
    gives a row "unexpected end" with its last event and what was not confirmed, and is forgotten.
    ``confirmed`` is what a row adds: its rows put together are the transcript. Every token comes once,
    so windows need no splicing here (``stream_splice`` does that for windows that were scored apart).
    """
    schema = "user_id long, event_id long, kind string, committed long, confirmed string, unconfirmed string"
    columns = {"event_type": "string", "recoverable": "boolean", "token": "string"}
    return _in_order(_Transcript, events, "user_id", columns, schema, delay, idle_days, window, overlap, interval_us, pause_us)


Token = tuple[str, bool, int]  # piece, whether it begins a word, position


def splice(left: list[Token], right: list[Token], search: int, tolerance: int) -> tuple[int, int]:
    """(tokens of ``left`` that stay, tokens of ``right`` that go): one seam, as ``seams.splice_pairs`` decides it."""
    boundary = left[-1][2]
    lo = next((k + 1 for k in range(len(left) - 1, -1, -1) if left[k][2] + search < boundary), 0)
    limit = max(boundary, right[0][2]) + search
    end = next((k for k, t in enumerate(right) if t[2] > limit), len(right))
    a, b = _words(left, lo, len(left)), _words(right, 0, end)
    best, row, places = (0, 0, 0), {}, {}
    for j, (_, _, core) in enumerate(b):
        if core:
            places.setdefault(core, []).append(j)
    for i, (_, p, core) in enumerate(a):
        above, row = row, {}  # the length of the common run that ends at i and j
        for j in places.get(core, ()):
            if abs(p - b[j][1]) <= tolerance:
                n = row[j] = above.get(j - 1, 0) + 1
                if n >= best[0]:
                    best = max(best, (n, n - i - 1, n - j - 1))
    if best[0] >= 2:
        return a[-best[1]][0], b[-best[2]][0]
    return len(left), next((k for k, t in enumerate(right) if t[2] > boundary), len(right))


def _words(tokens: list[Token], start: int, end: int) -> list[tuple[int, int, str]]:
    """(index, position, core) of the words of a slice; a word begins at every initial token and at the first."""
    own = tokens[start:end]
    if all(t[1] for t in own):
        return [(k, t[2], _core(t[0] or "")) for k, t in enumerate(own, start)]
    out: list[list] = []
    for k, (piece, initial, pos) in enumerate(own, start):
        if initial or not out:
            out.append([k, pos, ""])
        out[-1][2] += piece or ""
    return [(k, p, _core(w)) for k, p, w in out]


@functools.lru_cache(1 << 16)
def _core(word: str) -> str:
    kept = [k for k, c in enumerate(word) if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Mn", "Mc")]
    return word[kept[0] : kept[-1] + 1].lower() if kept else ""


class _Splice(_InOrder):
    """The committed tokens that a seam can still reach, and how many lie before them."""

    def __init__(self, schema: str, out: list[str], idle_ms: int, search: int, tolerance: int):
        super().__init__(schema, out, idle_ms)
        self.search, self.tolerance = search, tolerance

    def fold(self, key, state, rows):
        before, tail = state or (0, [])
        out = []
        for _, window_no, toks in rows:
            fresh = _tokens(toks) if toks else []
            keep, start = splice(tail, fresh, self.search, self.tolerance) if tail and fresh else (len(tail), 0)
            out.append((key, window_no, start, before + keep, [t[0] for t in fresh[start:]]))
            tail = tail[:keep] + fresh[start:]
            # a seam reaches ``search`` back from the end, which a run may have put back by as much and the tolerance
            far = 4 * (self.search + self.tolerance)
            reach = next((k for k in range(len(tail) - 1, -1, -1) if tail[k][2] + far < tail[-1][2]), 0)
            before, tail = before + reach, tail[reach:]
        return (before, tail), out


def stream_splice(windows: DataFrame, key: str, search: int, tolerance: int, delay: str = "1 day", idle_days: float = 30) -> DataFrame:
    """(key, window_no, append_from, start, fresh) of a stream of scored windows (key, ts, window_no, toks).

    Each window meets the committed tail in the order of ``ts``: the longest common run of words decides
    what stays of the tail and from where the window's tokens follow; both happen as one row. ``start``
    tokens of the merged sequence stay, then ``fresh`` comes: rows applied in order are ``seams``' fold.
    State holds the tokens that later seams can reach, not the text: those within four times ``search``
    and ``tolerance`` of the end (windows that step further back than that are spliced at what is held).
    """
    kind = windows.schema[key].dataType.simpleString()
    rows = windows.withColumnRenamed("window_no", "event_id").withColumn("toks", _packed_tokens(F.col("toks")))
    out = f"{key} {kind}, window_no long, append_from long, start long, fresh array<string>"
    return _in_order(_Splice, rows, key, {"toks": "string"}, out, delay, idle_days, search, tolerance)


BETWEEN, AFTER = "\x1f", "\x1e"  # two pieces, and the parts before them


def _packed_tokens(toks: Column) -> Column:
    """Tokens as a text: first position, what is unusual about positions, beginnings and pieces (JSON, empty if nothing is), pieces.

    Most windows' positions follow each other and all their tokens begin words; then only the pieces take
    room. Pieces that are null or hold the mark between them are JSON. Null and no tokens are null.
    """
    text = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    piece, initial, pos, n = F.col("toks.piece"), F.col("toks.initial"), F.col("toks.pos"), F.size(toks)
    first = F.get(pos, F.lit(0))
    along = F.when((first >= 0) & (first < 1 << 62), pos == F.sequence(first, first + n - 1))
    joined = F.array_join(piece, BETWEEN)
    marks = F.length(joined) - F.length(F.replace(joined, F.lit(BETWEEN), F.lit("")))
    plain = (F.size(F.array_compact(piece)) == n) & (marks == n - 1)
    sure = lambda x: F.coalesce(x, F.lit(False))
    begins = F.transform(toks, lambda t: sure(t["initial"]).cast("int"))
    parts = [
        F.coalesce(first, F.lit(0)).cast("string"), F.when(sure(along), "").otherwise(text(pos)),
        F.when(sure(~F.array_contains(initial, False)), "").otherwise(text(begins)), F.when(sure(plain), "").otherwise(text(piece)), F.when(sure(plain), joined).otherwise(""),
    ]
    return F.when(n > 0, F.concat_ws(AFTER, *parts))


def _tokens(packed: str) -> list[Token]:
    first, pos, begins, strange, joined = packed.split(AFTER, 4)
    pieces = json.loads(strange) if strange else joined.split(BETWEEN)
    start = int(first)
    return list(zip(pieces, json.loads(begins) if begins else [1] * len(pieces), json.loads(pos) if pos else range(start, start + len(pieces)), strict=True))


def spliced_text(rows: DataFrame, key: str, separator: str = " ") -> DataFrame:
    """(key, n_tokens, text) of ``stream_splice`` rows: what each window added, less what a later one's start cuts off."""
    # pieces go through the shuffle as one text, but where one is null or holds the mark between them
    joined = F.array_join("fresh", BETWEEN)
    marks = F.length(joined) - F.length(F.replace(joined, F.lit(BETWEEN), F.lit("")))
    plain = (F.size(F.array_compact("fresh")) == F.size("fresh")) & (marks == F.size("fresh") - 1)
    rows = rows.select(key, "window_no", "start", F.size("fresh").alias("_n"), F.when(plain, joined).alias("_text"), F.when(~plain, F.col("fresh")).alias("_list"))
    later = Window.partitionBy(key).orderBy(F.desc("window_no")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.greatest(F.min("start").over(later), F.col("start")) - F.col("start")
    end = F.when(F.min("start").over(later).isNull(), F.col("_n")).otherwise(F.least("_n", cut)).cast("int")
    pieces = F.when(F.col("_text").isNull(), F.col("_list")).otherwise(F.split("_text", BETWEEN))
    left = rows.select(key, "window_no", "_text", "_list", end.alias("_end")).where("_end > 0").select(key, "window_no", F.slice(pieces, F.lit(1), F.col("_end")).alias("left"))
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window_no", "left"))), lambda x: x["left"])), separator)
    return left.groupBy(key).agg(F.sum(F.size("left")).alias("n_tokens"), text.alias("text"))
