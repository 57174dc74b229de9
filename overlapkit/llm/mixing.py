"""Mixing sources to target weights, in DataFrame operations only.

1. Targets. Sources share ``budget`` by weight; none is asked for more than ``max_repeat`` times what
   it has, and what it can't give is reshared by weight until no target is above (water filling).
   A source's quota is its target in blocks.
2. Blocks. Each source's documents, in order of their ids, are one stream of words, cut into blocks
   of ``block`` words; a document meets the blocks that its words fall in.
3. Draws. The output has shards of ``shard_blocks`` slots. Every slot of a shard draws a source with
   the probability of its quota, so a shard's source counts are multinomial. Independent draws would
   leave a source's total off its target by the square root of its slots, and above ``max_repeat``
   where that binds. So each source's counts are raked: multiplied by quota over total drawn, and
   rounded on their running sum, which spreads the correction over all shards alike.
4. Permutation. Slot ``j`` of a source (numbered through its shards) takes block ``perm(j mod
   blocks)``, where ``perm`` is a swap-or-not shuffle keyed by source: a bijection on
   ``0..blocks-1``, computed row by row. So a source repeats none of its blocks before all have been
   taken, and takes none more than ``max_repeat`` times.
5. Blocks and slots meet by (source, block index), an equi-join.

Running sums over documents and shards are sums within ranges plus sums of whole ranges
(``ordered_sums``), so a source may hold most rows. Draws are MD5 digests of their numbers: any SQL
engine can repeat them, and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

WORD = r"[^\x20\x09-\x0D]+"
PRIME = 2_147_483_647  # 2**31 - 1: products of two residues stay within 63 bits
ROUNDS = 16
CELLS = 4096  # parts of the range of draws; each holds the sources that it meets
TASK_SLOTS = 65_536  # slots made from nothing in a task


def draw(*parts: Column | int) -> Column:
    """A number below 2**60 from integers: the first 15 hex digits of an MD5."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """(source_no, source, source_size, target) from (source, source_size), one row per source.

    Weights repeat over the sources in code-point order, null last. The list is already one short row
    per source, so its windows sort it in one task (a million sources are some 50 MB).
    """
    every = Window.partitionBy(F.lit(0))
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("source_no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(table, (F.col("source_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    # Sources reach their cap in the order of cap / weight; a level leaves those before it capped.
    order = every.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left)
    s = s.withColumn("rank", F.row_number().over(order))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return s.select("source_no", "source", "source_size", target.alias("target"))


def round_keys(source_no: Column, blocks: Column) -> Column:
    """Per round of the shuffle: the reflection point, and a multiplier and shift for its coin."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        lambda r: F.struct(
            (draw(source_no, r, 1) % blocks).alias("k"), (draw(source_no, r, 2) % PRIME).alias("m"), (draw(source_no, r, 3) % PRIME).alias("c")
        ),
    )


def permute(index: Column, size: Column, rounds: Column) -> Column:
    """Swap-or-not shuffle (Hoang, Morris, Rogaway 2012) of ``index`` in ``0..size-1``.

    A round pairs x with k - x and swaps the two or not, by a coin that both of them see alike.
    """

    def one(x: Column, t: Column) -> Column:
        mate = F.pmod(t["k"] - x, size)
        coin = F.floor((F.greatest(x, mate) % PRIME * t["m"] + t["c"]) % PRIME / 1024) % 2
        return F.when(coin == 1, mate).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), one)


def shard_counts(sources: DataFrame, total: int, n_sources: int, shard_blocks: int) -> DataFrame:
    """(source_no, shard, first, last): the source's slots first..last-1 go to the shard.

    ``sources`` has source_no, slots and ``lo``, the slots of sources before it; ``total`` of them.
    """
    spark = sources.sparkSession
    shards = max(1, -(-total // shard_blocks))
    tasks = max(1, min(10_000, -(-total // TASK_SLOTS)))
    left = F.least(F.lit(shard_blocks).cast("long"), F.lit(total) - F.col("id") * shard_blocks)
    slots = spark.range(0, shards if total else 0, 1, tasks).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), left - 1)).alias("i"))
    slots = slots.withColumn("x", draw(F.col("shard"), F.col("i"), 4) % max(total, 1))
    width = max(1, -(-total // max(CELLS, n_sources)))
    slots = slots.withColumn("cell", F.floor(F.col("x") / width))
    used = sources.where("slots > 0")
    cells = used.select("source_no", "lo", (F.col("lo") + F.col("slots")).alias("hi"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    drawn = slots.hint("merge").join(cells, "cell").where("x >= lo and x < hi")
    counts = drawn.groupBy("source_no", "shard").agg(F.count("*").alias("n"))
    # one more at a shard of its own, so that a source with a quota has a count
    seeded = used.select("source_no", (draw(F.col("source_no"), 0, 5) % shards).alias("shard"), F.lit(1).cast("long").alias("n"))
    counts = counts.unionByName(seeded).groupBy("source_no", "shard").agg(F.sum("n").alias("n"))
    counts = S.ordered_sums(counts, [F.col("shard")], {"before": "n"}, ("source_no",))
    totals = counts.groupBy("source_no").agg(F.sum("n").alias("drawn")).join(used.select("source_no", "slots"), "source_no")
    ratio = F.col("slots") / F.col("drawn")
    raked = lambda c: F.floor(c * ratio + 0.5).cast("long")
    rows = counts.hint("merge").join(totals, "source_no")
    return rows.select("source_no", "shard", raked(F.col("before")).alias("first"), raked(F.col("before") + F.col("n")).alias("last")).where("last > first")


@dataclass
class MixPlan:
    """documents: row, id, source, size, source_no, source_size, target, at (the place of its first word
    in its source's stream), and with ``carry`` ``whole``, a struct of all given columns; slots:
    source_no, block_no, shard, epoch, one row per block of the output; sources: one row per source."""

    documents: DataFrame
    slots: DataFrame
    sources: DataFrame
    table: DataFrame


def mix_plan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    share: float = 1.0,
    max_repeat: int = 3,
    block: int = 128,
    shard_blocks: int = 1024,
    carry: bool = False,
) -> MixPlan:
    """What each document holds, and which blocks go to which shard of the mix."""
    table = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("tie"),
        *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")] * carry,
    )
    table = S.materialize(table)  # the texts' one pass; below only numbers are read
    d = table.select("row", "id", "source", "size", "tie")
    s = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    wanted = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)
    s = s.withColumn("slots", F.when(F.col("blocks") > 0, F.least(F.col("blocks") * max_repeat, wanted)).otherwise(0).cast("long"))
    lo = F.sum("slots").over(Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1))
    s = S.materialize(s.withColumn("lo", F.coalesce(lo, F.lit(0))))
    total, n_sources = s.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    counts = shard_counts(s, total, n_sources, shard_blocks)
    keyed = s.where("slots > 0").select("source_no", "blocks", round_keys(F.col("source_no"), F.col("blocks")).alias("rounds"))
    tasks = max(1, min(10_000, -(-total // TASK_SLOTS)))
    slots = counts.hint("merge").join(keyed, "source_no").repartition(tasks, "source_no", "shard").withColumn("j", F.explode(F.expr("sequence(first, last - 1)")))
    slots = slots.select(
        "source_no", permute(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("rounds")).alias("block_no"), "shard",
        F.floor(F.col("j") / F.col("blocks")).cast("int").alias("epoch"),
    )
    d = S.ordered_sums(d, [F.col("id"), F.col("size"), F.col("tie"), F.col("row")], {"at": "size"}, ("source",)).drop("tie")
    named = s.select(F.col("source").alias("named"), "source_no", "source_size", "target")
    d = d.hint("merge").join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    return MixPlan(d, slots, s, table)


def block_pieces(documents: DataFrame, block: int = 128) -> DataFrame:
    """Each document's words by block: row, source_no, block_no, first (place in the document), words."""
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    p = documents.where("size > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    first = F.greatest(F.col("block_no") * block - F.col("at"), F.lit(0))
    end = F.least((F.col("block_no") + 1) * block - F.col("at"), F.col("size"))
    return p.select("row", "source_no", "block_no", first.alias("first"), (end - first).alias("words"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", block: int = 128, **options) -> DataFrame:
    """(id, size, source, source_size, target, taken, first_shard, last_shard), one row per document.

    taken: how many words of it the mix takes, repeats counted; the shards are the first and last that
    words of it go to, null where nothing is taken.

    Cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its
    own, last in order; repeated and null ids are documents side by side, in order of size and text; a
    source without words has target 0; extra columns have no effect; an empty table gives no rows.
    """
    plan = mix_plan(docs, id_col=id_col, block=block, **options)
    times = plan.slots.groupBy("source_no", "block_no").agg(F.count("*").alias("times"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    pieces = block_pieces(plan.documents, block).hint("merge")
    taken = pieces.join(times, ["source_no", "block_no"]).groupBy("row").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("lo").alias("first_shard"), F.max("hi").alias("last_shard")
    )
    out = plan.documents.hint("merge").join(taken, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard"
    )


def mixed_documents(docs: DataFrame, *, text_col: str = "text", block: int = 128, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each pass over a document's source
    in which words of it were taken, dealt out by the shard that the first of these words go to.

    A document whose words were all taken in a pass keeps its text; of another the taken words stay,
    in order, with single spaces. ``n_chars``, if there, is the new text's length. Documents of which
    nothing is taken, and those without words, have no row. Other cases as in ``mix_sources``; a given
    column keeps its value whatever its name.
    """
    plan = mix_plan(docs, text_col=text_col, block=block, carry=True, **options)
    pieces = block_pieces(plan.documents, block).hint("merge").join(plan.slots, ["source_no", "block_no"])
    taken = pieces.groupBy("row", "epoch").agg(
        F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("first", "words", "shard"))).alias("spans")
    )
    rows = plan.table.select("row", "size", "whole").hint("merge").join(taken, "row")
    rows = rows.withColumn("shard", F.col("spans")[0]["shard"])
    text = F.col(f"whole.`{text_col}`")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["first"] + 1).cast("int"), s["words"].cast("int")))), " ")
    every = F.col("taken") == F.col("size")
    rows = rows.withColumn("new", F.when(every, text).otherwise(part))
    out = {c: F.col(f"whole.`{c}`") for c in docs.columns} | {text_col: F.col("new")}
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(every, out["n_chars"]).otherwise(F.length("new").cast(kind))
    return rows.select("shard", F.struct(*[v.alias(c) for c, v in out.items()]).alias("made")).repartition("shard").select("made.*")
