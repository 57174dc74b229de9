"""Overlapping windows over long sequences: plan, assign, pad, score, stamp."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME, SIZE, OVERLAP = 1280, 240_000, 32_000  # samples in a frame, a window, and an overlap


def plan_windows(
    lengths: DataFrame, key: str, n: str, size: int = SIZE, overlap: int = OVERLAP, align: int = FRAME, cover_tail: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, window_no, start, len, frame_offset) of every window over a sequence of ``n`` elements, and columns to ``keep``.

    Full windows every ``size - overlap``; if they leave an end uncovered, one more that is aligned
    to the end, its start floored to ``align`` and its length at most ``size`` (with ``cover_tail``
    it reaches the end even so). A sequence shorter than a window has one, from 0; an empty one has
    one of length 0.
    """
    if not 0 <= overlap < size or align < 1:
        raise ValueError("overlap lies below size, align is positive")
    advance = size - overlap
    n_col = F.col(n).cast("long")
    full = F.when(n_col < size, F.lit(0)).otherwise(F.floor((n_col - size) / advance) + 1).cast("long")
    base = lengths.select(F.col(key), *keep, n_col.alias("_n"), full.alias("_full")).where("_n is not null")
    covered = F.when(F.col("_full") > 0, (F.col("_full") - 1) * advance + size).otherwise(-1)
    tail = covered < F.col("_n")
    base = base.withColumn("_tail", tail).withColumn("_count", F.col("_full") + F.col("_tail").cast("long"))
    rows = base.withColumn("window_no", F.explode(F.expr("sequence(0L, _count - 1)")))
    is_tail = F.col("_tail") & (F.col("window_no") == F.col("_count") - 1)
    end_start = F.greatest(F.col("_n") - size, F.lit(0))
    end_start = end_start - end_start % align
    start = F.when(is_tail, end_start).otherwise(F.col("window_no") * advance)
    reach = F.col("_n") - F.col("start")
    length = F.when(is_tail, reach if cover_tail else F.least(F.lit(size), reach)).otherwise(F.lit(size))
    rows = rows.withColumn("start", start.cast("long")).withColumn("_is_tail", is_tail)
    return rows.select(key, "window_no", "start", length.cast("long").alias("len"), F.floor(F.col("start") / align).cast("long").alias("frame_offset"), *keep)


LEVEL, STEP = 7, 4  # windows of up to 2^7 elements share bins of that width, longer ones bins of 2^11, 2^15 and so on


def assign_windows(elements: DataFrame, windows: DataFrame, key: str, idx: str = "idx", stride: int | None = None, size: int | None = None) -> DataFrame:
    """Every element with every window that holds it: start <= idx < start + len.

    Elements are dealt to bins by their place, each once, and windows to every bin they reach into; both
    meet on (key, bin), and the bounds decide. With ``size`` and ``stride`` (the plan's advance) a bin is four
    strides, so an element meets the few windows that follow from its place. Windows of any places and
    lengths lie in one or two bins of 2^7 elements, or of 2^11, 2^15 and so on for longer ones; an element is
    copied only for each further width that some window has (16 at most).
    """
    w = windows.select(F.col(key).alias("_key"), F.col("window_no").alias("_no"), "start", "len").where("start is not null and len > 0")
    inside = (F.col(idx) >= F.col("start")) & (F.col(idx) < F.col("start") + F.col("len"))
    e = elements.where(F.col(idx).isNotNull())
    at = f"cast(floor(`{idx}`) as bigint)"
    if stride is None or size is None:
        over = F.greatest(F.length(F.bin(F.col("len") - 1)) - LEVEL, F.lit(0))
        w = w.withColumn("_level", (F.ceil(over / STEP) * STEP + LEVEL).cast("int"))
        w = w.withColumn("_level", F.least("_level", F.lit(63)))
        levels = sorted(r["_level"] for r in w.select("_level").distinct().collect()) or [LEVEL]  # 16 at most
        place = lambda x, level: F.expr(f"shiftright({x}, {level})")
        w = w.withColumn("_bin", F.explode(F.array_distinct(F.array(place("start", "_level"), place("start + len - 1", "_level")))))
        e = e.withColumn("_l", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels))))
        e = e.withColumn("_b", place(at, "_l"))
        on = (F.col(key) == F.col("_key")) & (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bin"))
        return e.join(w, on & inside).withColumnRenamed("_no", "window_no").drop("_key", "_level", "_bin", "_l", "_b")
    place = lambda x: F.expr(f"({x} - pmod({x}, {4 * stride}L)) div {4 * stride}L")
    w = w.withColumn("_bin", F.explode(F.sequence(place("start"), place("(start + len - 1)"))))
    e = e.withColumn("_b", place(at))
    return e.join(w, (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_bin")) & inside).withColumnRenamed("_no", "window_no").drop("_key", "_bin", "_b")


def pad_windows(df: DataFrame, values: str, size: int) -> DataFrame:
    """``values`` filled with zeros to ``size``, and ``valid_len``, its length before."""
    kind = df.schema[values].dataType.elementType
    n = F.coalesce(F.size(values), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    zeros = F.array_repeat(F.lit(0).cast(kind), F.greatest(F.lit(size) - n, F.lit(0)).cast("int"))
    return df.withColumn("valid_len", n.cast("long")).withColumn(values, F.concat(F.coalesce(F.col(values), F.array().cast(df.schema[values].dataType)), zeros))


def score_windows(df: DataFrame, fn: Callable, key: str, offset: str = "frame_offset", batched: bool = False) -> DataFrame:
    """Tokens of every window by a user's function, windows independent of each other.

    ``fn(row)`` gives (token_id, position in the window) pairs; positions are moved by the window's
    ``offset``. With ``batched``, ``fn(batch)`` takes an Arrow batch of windows and gives a list of such
    lists, one a window, so a model scores many at once; a batch that fails is scored window by window.
    A window whose function fails gives one row with ``error`` and no token; the others go on. Returns
    (key, window_no, ord, token_id, pos, error).
    """
    kind = df.schema[key].dataType.simpleString()

    def alone(row: dict) -> list | Exception:
        try:
            return [(str(t), int(p)) for t, p in fn(row)]
        except Exception as e:  # as below
            return e

    def made(batch: pa.RecordBatch) -> list:
        """Pairs of each window, or what was raised."""
        if not batched:
            return [alone(row) for row in batch.to_pylist()]
        try:
            found = list(fn(batch))
            if len(found) != batch.num_rows:
                raise ValueError(f"{len(found)} results for {batch.num_rows} windows")
            return [[(str(t), int(p)) for t, p in pairs] for pairs in found]
        except Exception as e:  # the user's function may raise anything; the window's row says so
            if batch.num_rows == 1:
                return [e]
        return [x for k in range(batch.num_rows) for x in made(batch.slice(k, 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 1_000):
                batch = big.slice(a, 1_000)
                found = made(batch)
                bad = np.array([isinstance(x, Exception) for x in found], dtype=bool)
                n = np.array([0 if isinstance(x, Exception) else len(x) for x in found], dtype=np.int64)
                rows = np.maximum(n, bad)  # a window that failed has one row
                at = np.repeat(np.arange(len(found)), rows)
                none = bad[at]
                ids, places = [], []
                for pairs in found:
                    if isinstance(pairs, Exception):
                        ids.append(None)
                        places.append(0)
                    else:
                        ids += [t for t, _ in pairs]
                        places += [p for _, p in pairs]
                order = np.arange(len(at)) - np.repeat(np.cumsum(rows) - rows, rows)
                own = batch.column(offset).take(pa.array(at)).cast(pa.int64())
                pos = pc.if_else(pa.array(none), None, pc.add(pa.array(places, pa.int64()), own))
                errors = pa.array([f"{type(x).__name__}: {x}" if isinstance(x, Exception) else None for x in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(at)), batch.column("window_no").take(pa.array(at)).cast(pa.int64()), pa.array(order, mask=none), pa.array(ids, pa.string()), pos, errors.take(pa.array(at))],
                    names=[key, "window_no", "ord", "token_id", "pos", "error"],
                )

    return df.mapInArrow(run, f"`{key}` {kind}, window_no long, ord long, token_id string, pos long, error string")


def stamp_positions(tokens: DataFrame, keys: list[str], ord_col: str = "ord", offset: str = "frame_offset", valid: str = "valid_frames", stride_cap: int = 4) -> DataFrame:
    """``pos`` of the i-th of a window's m tokens: offset + min(i * valid // m, i * cap), early on purpose."""
    ordered = Window.partitionBy(*keys).orderBy(ord_col)
    i = (F.row_number().over(ordered) - 1).cast("long")
    m = F.count("*").over(Window.partitionBy(*keys))
    pos = F.col(offset) + F.least(F.floor(i * F.col(valid) / m), i * stride_cap)
    return tokens.withColumn("pos", pos.cast("long"))
