"""Chat formatting by rotating perspectives.

For every participant of a conversation (each role but ``system``) the dialogue is rendered with that
speaker as the assistant and every other one as a user under their own name; the loss mask covers
what the assistant says, so each participant's words are learnt in their own rendering.

    <|system|>text<|end|>
    <|user|name>text<|end|>
    <|assistant|>text<|end|>

A dialogue is rendered in parts of ``part_turns`` turns, each a row, so that no conversation, however
long, and no turn number, however often it occurs, is gathered into one row or task; a part's spans
count from its own start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

PART_TURNS = 256


def render_perspectives(turns: DataFrame, *, part_turns: int = PART_TURNS, conv_col: str = "conv_id") -> DataFrame:
    """(conv, perspective, part, n_turns, n_own, text, mask): mask is an array of (first, last) places.

    ``turns`` has the conversation's id, turn, role and text. A span covers the assistant's text and
    its end mark, in characters, last exclusive. Turns are ordered by turn, then role, then text.

    Cases: a null role is a participant of its own, whose perspective is null and whose name is
    ``&null;``; a null text is empty; null turns, roles and texts go first; rows of a null
    conversation form one of their own; repeated rows are rendered as often as they occur; a
    conversation with only system turns has no participant and no row; a part in which the assistant
    is silent has an empty mask; other columns are dropped; an empty table gives no rows. Markers
    inside texts are broken up (``<|`` becomes ``< |``), and in names ``&`` and ``>`` are written
    ``&amp;`` and ``&gt;`` as well, so that neither can pose as a turn and no two names are alike.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = F.replace(F.replace(safe(F.col("role")), F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;"))
    t = turns.select(
        F.col(conv_col).alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"),
        F.monotonically_increasing_id().alias("row"), F.lit(1).alias("one"),
    )
    t = S.ordered_sums(t, [F.col(c) for c in ("turn", "role", "text", "row")], {"place": "one"}, ("conv",))
    t = t.select("conv", "place", "role", F.coalesce(name, F.lit("&null;")).alias("name"), safe(F.coalesce("text", F.lit(""))).alias("said"))
    t = t.withColumn("part", F.floor(F.col("place") / part_turns))
    speakers = t.where(~F.col("role").eqNullSafe("system")).select(F.col("conv").alias("own"), F.col("role").alias("perspective")).distinct()
    views = t.join(speakers, F.col("conv").eqNullSafe(F.col("own"))).drop("own")
    mine = F.col("role").eqNullSafe(F.col("perspective"))
    head = F.when(mine, "<|assistant|>").when(F.col("role") == "system", "<|system|>").otherwise(F.concat(F.lit("<|user|"), "name", F.lit(">")))
    lines = views.groupBy("conv", "perspective", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "said", head.alias("head"), mine.alias("mine")))).alias("lines")
    )
    end = F.lit("<|end|>\n")
    body = F.concat_ws("", F.transform("lines", lambda x: F.concat(x["head"], x["said"], end)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<first: long, last: long>>)").alias("spans"))

    def step(acc, x):
        first = acc["at"] + F.length(x["head"])
        last = first + F.length(x["said"]) + 8
        span = F.array(F.struct(first.cast("long").alias("first"), (last - 1).cast("long").alias("last")))
        return F.struct(last.cast("long").alias("at"), F.when(x["mine"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return lines.select(
        F.col("conv").alias(conv_col), "perspective", F.col("part").cast("long").alias("part"),
        F.size("lines").cast("long").alias("n_turns"), F.size(F.filter("lines", lambda x: x["mine"])).cast("long").alias("n_own"),
        body.alias("text"), F.aggregate("lines", zero, step)["spans"].alias("mask"),
    )
