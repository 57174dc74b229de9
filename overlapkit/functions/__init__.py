"""Column helpers that the operators share: signal levels, words, spacing, and ordered folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"

# Characters that no space may precede.
PUNCTUATION = r".,!?:;\x{2010}-\x{201F}\x{2030}-\x{205F}\x{3001}-\x{3003}\x{3008}-\x{3011}\x{3014}-\x{3017}\x{301D}-\x{302F}\x{FF01}-\x{FF60}"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (the session's zone for the latter)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def normalize_samples(value: Column, fmt: str) -> Column:
    """Samples of an integer format as -1..1: i16 by 32767, u16 around 32768, f32 as they are."""
    if fmt == "i16":
        return value / F.lit(32767.0)
    if fmt == "u16":
        return (value - F.lit(32768)) / F.lit(32768.0)
    if fmt == "f32":
        return value
    raise ValueError(f"unsupported sample format: {fmt}")


def activity_level(rms: Column) -> Column:
    """Loudness from -50 to 0 dB as 0..1; silence is 0 (the logarithm of zero is null in Spark)."""
    level = (F.log10(rms) * 20 + 50) / 50
    return F.when(rms > 0, F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def position_to_ms(pos: Column, frame_ms: int = 80) -> Column:
    return pos * frame_ms


def word_initial(piece: Column) -> Column:
    """Whether a piece begins a word: with the marker or white space. Null without a piece."""
    return piece.rlike(f"^(?:{MARK}|[\\s\\u0085\\p{{Z}}])")


def word_core(word: Column) -> Column:
    """The word without what isn't a letter or number at its ends, in lower case; null is empty."""
    ends = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"
    return F.lower(F.regexp_replace(F.coalesce(word, F.lit("")), ends, ""))


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def normalize_spaces(text: Column) -> Column:
    """Runs of spaces become one, none stays before punctuation or at the end."""
    one = F.regexp_replace(text, " +", " ")
    return F.regexp_replace(F.regexp_replace(one, f" ([{PUNCTUATION}])", "$1"), r" \z", "")


def trim_unicode(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z", "")


def fold_rows(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], list[dict]], schema: str) -> DataFrame:
    """A recurrence over each key's rows in order, for what window functions can't say.

    Rows are sorted within partitions and streamed: a task holds one batch and the state that
    ``start`` makes for a key, not a key's rows. ``step(state, row)`` returns output rows.
    """
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema, at, state = to_arrow_schema(fields), None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, start()
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return sorted_rows.mapInArrow(run, fields)
