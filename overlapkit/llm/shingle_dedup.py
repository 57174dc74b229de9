"""Near copies by exact Jaccard similarity of word shingles, without missing a pair.

Candidates come from two sources. Golay keys of the sets' SimHash fingerprints (``simhash``) give those
within 4 bits, and tie most families of near copies together. At a similarity of 0.8 pairs differ in 5 to
14 of 64 bits, beyond what the keys reach, so prefixes give the rest: with the shingles of all documents in one
fixed order, two sets of sizes n and m whose Jaccard similarity is at least ``t`` share a shingle among the first
``n - ceil(t n) + 1`` and ``m - ceil(t m) + 1`` of theirs. An equi-join on those finds every pair.
Any order will do; here shingles that many documents hold come last, so that a common line is rarely
a key. How common they are is read off a bounded sample, which changes the work, never the result.

Documents of equal shingle sets are one node, a copy of a text adds none. Families of near copies are
contracted before their members meet: first by the Golay links, then in rounds, in each of which the nodes
under a key meet one head (at first the same for most keys, then another one for every key); what is
similar becomes one group, and keys that one group holds alone are dropped. Only then do nodes of *different* groups under a key meet, those of
like sizes, and the join tells most of them apart by sketches folded to 512 bits. A pair is made where the shared shingle can
be the first one of both (nothing before it overlaps), parity sketches (made once for a node, about a bit
a shingle) bound the difference, and a candidate that passes both is verified on the two whole sets.

Spark sizes a table by its files, which are far smaller than the rows in memory, and what an Arrow map or an
explode makes by what it reads: tables of keys are never left to it to broadcast (``merge``).

Texts are read in place for names and keys; they are shuffled once, when the rows that stay are picked,
and the few texts to verify are fetched by name. Shingles are 64-bit hashes, a set's name one of 128
bits, of which nodes carry the first half; two sets that share it are an error, not one document.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from overlapkit.llm import _shared as S
from overlapkit.llm import simhash

SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)
SAMPLE, COMMON, MOST = 20_000, 10, 1 << 18  # texts read for the order, how many of them hold a common shingle, and common shingles at most
BUCKETS = 1 << 20  # of row names
SHARE = 64  # pairs of one node that meet in a task
ROUNDS = 2  # after the Golay links, in which nodes meet one head a key, before groups meet
FOLDS = [f"f{k}" for k in range(8)]  # 64 bits each
PLACE = ["node", "grp", "pos", "n"]
MEET = 1024  # rows of a key and band that others meet in a task
EPS = 1e-9


def shingles(text: bytes, words_in_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a lower-cased text's shingles; a shorter text is one, a blank one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width, digest = min(words_in_shingle, len(words)), xxhash.xxh64_intdigest
    w = np.array([digest(x, SEED) for x in words], dtype=np.uint64)
    n = len(w) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _sets(docs: DataFrame, text: str, keep: list[str], make, more: str, words_in_shingle: int) -> DataFrame:
    """``keep`` columns and what ``make`` gives for the batch's shingle sets: (owner or None, columns)."""
    fields = docs.sparkSession.createDataFrame([], more).schema.fields
    schema = StructType([*S.schema_of(docs, keep).fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, text, 1_000_000):
            owner, columns = make([shingles(t, words_in_shingle) for t in S.utf8(batch.column(text))])
            if owner is not None:
                batch = batch.select(keep).take(pa.array(owner))
            yield S.with_columns(batch, keep, **columns)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _names(sets: list[np.ndarray], seed: int = SEED) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], dtype=np.uint64).view(np.int64)


def _described(sets: list[np.ndarray]):
    """Name, second half of the name, size, SimHash fingerprint and sketch of each set."""
    return None, {
        "node": pa.array(_names(sets)), "twin": pa.array(_names(sets, SEED + 1)), "n": pa.array([len(s) for s in sets], pa.int32()),
        "fp": pa.array(np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)), "s": pa.array([sketch(s) for s in sets], pa.binary()),
    }


def _flat(sets: list[np.ndarray]):
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), {"key": pa.array(np.concatenate(sets).view(np.int64))}


def _prefixes(similarity: float, order):
    """Keys of each set with their positions in the fixed order (count in the sample, hash), its name and size.

    ``order`` is a broadcast of (common shingles, sorted; their counts). A set comes once in a batch.
    """

    def make(sets: list[np.ndarray]):
        common, counts = order.value
        names = _names(sets)
        keys, at, size, fresh = [], [], [], np.sort(np.unique(names, return_index=True)[1])
        for s in (sets[k] for k in fresh):
            if len(common) and len(s):
                found = np.minimum(np.searchsorted(common, s), len(common) - 1)
                s = s[np.argsort(np.where(common[found] == s, counts[found], 0), kind="stable")]
            n = len(s) - math.ceil(similarity * len(s) - EPS) + 1 if len(s) else 0
            keys.append(s[:n])
            at.append(np.arange(n))
            size.append(len(s))
        many = [len(k) for k in keys]
        columns = {
            "node": np.repeat(names[fresh], many), "key": np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64),
            "pos": np.concatenate([*at, np.zeros(0)]).astype(np.int32), "n": np.repeat(size, many).astype(np.int32),
        }
        return np.zeros(len(columns["key"]), dtype=np.int64), {k: pa.array(v) for k, v in columns.items()}

    return make


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's numbers of hashes in 2**k buckets, at least one a hash: sets twice as far apart as allowed differ in more."""
    bits = 1 << max((64 * len(FOLDS) - 1).bit_length(), (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_differ(x: np.ndarray, y: np.ndarray) -> int:
    """At least how many hashes only one of two sets has: each odd bucket of the difference holds one."""
    while len(x) != len(y):  # fold the longer one
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _allowed(similarity: float) -> float:
    """The share of both sizes together that may lie outside the overlap."""
    return (1 - similarity) / (1 + similarity)


def _folds(sets: DataFrame) -> DataFrame:
    """node and its sketch folded to ``FOLDS``, so that a join can tell most pairs apart before it makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.bitwise_xor.reduce(np.frombuffer(s.as_buffer(), np.int64).reshape(-1, len(FOLDS)), axis=0) for s in batch.column("s")]
            made = np.array(made, dtype=np.int64).reshape(-1, len(FOLDS))
            yield S.with_columns(batch, ["node"], **{c: pa.array(made[:, k]) for k, c in enumerate(FOLDS)})

    return sets.select("node", "s").mapInArrow(run, S.schema_of(sets, ["node"], **dict.fromkeys(FOLDS, "long")))


def _attach(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``pairs`` with n and s of node ``side``; a node of many pairs is dealt over several tasks."""
    parts = pairs.groupBy(side).agg(F.floor(F.count("*") / SHARE).cast("int").alias("parts"))
    held = sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("s").alias(f"s_{side}")).join(parts, side)
    copies = held.withColumn("part", F.explode(F.sequence(F.lit(0), "parts"))).drop("parts")
    dealt = pairs.join(parts, side).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts") + 1).cast("int")).drop("parts")
    return dealt.join(copies, [side, "part"]).drop("part")


def _passing(pairs: DataFrame, sets: DataFrame, dtype: type, test) -> DataFrame:
    """The pairs (a, b) whose buffers ``s`` and sizes ``n`` in ``sets`` pass ``test``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("s_a", "s_b")), *(batch.column(c).to_pylist() for c in ("n_a", "n_b")), strict=True)
            ok = [test(np.frombuffer(x.as_buffer(), dtype), np.frombuffer(y.as_buffer(), dtype), n, m) for x, y, n, m in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = _attach(_attach(pairs, sets, "a"), sets, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return S.materialize(both.mapInArrow(run, "a long, b long"), few=True)


def _whole_sets(pairs: DataFrame, docs: DataFrame, text: str, rows: DataFrame, words_in_shingle: int) -> DataFrame:
    """node, n and the whole set s of the nodes in ``pairs``, made from the text of one row each."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    where = S.materialize(rows.join(asked, "node", "left_semi").select("h1", "h2").distinct(), few=True)

    def whole(sets: list[np.ndarray]):
        return None, {"node": pa.array(_names(sets)), "n": pa.array([len(s) for s in sets], pa.int32()), "s": pa.array([s.tobytes() for s in sets], pa.binary())}

    # texts that nobody asks for stay where they are: a broadcast of at most BUCKETS numbers tells most of them
    bucket = F.pmod("h1", F.lit(BUCKETS))
    near = docs.withColumn("bucket", bucket).join(F.broadcast(where.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
    made = _sets(near.join(where, ["h1", "h2"], "left_semi"), text, ["h1"], whole, "node long, n int, s binary", words_in_shingle)
    out = S.materialize(made.select("node", "n", "s").dropDuplicates(["node"]))  # rows may repeat
    S.discard(where)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, rows: DataFrame, similarity: float, words_in_shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have the similarity; sketches spare most others the comparison."""
    allowed = _allowed(similarity)

    def near(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
        return may_differ(x, y) <= allowed * (n + m) + EPS

    def same(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (n + m - both) - EPS

    pairs = S.materialize(pairs.distinct(), few=True)
    close = _passing(pairs, sets, np.uint8, near)
    S.discard(pairs)
    whole = _whole_sets(close, docs, text, rows, words_in_shingle)
    out = _passing(close, whole, np.uint64, same)
    S.discard(close)
    S.discard(whole)
    return out


def _common(docs: DataFrame, text: str, words_in_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a bounded sample hold, sorted, and in how many; the ``MOST`` most frequent ones."""
    some = S.bounded_sample(docs.select(text), SAMPLE, text).dropDuplicates([text])  # copies of a text go together
    counted = _sets(some.withColumn("one", F.lit(1)), text, ["one"], _flat, "key long", words_in_shingle).groupBy("key").count()
    table = counted.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST).toArrow()
    keys, counts = table["key"].to_numpy().astype(np.int64).view(np.uint64), table["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _mixed(held: DataFrame) -> DataFrame:
    """The rows under keys that still hold two groups; a set that came in several batches is there once."""
    keys = held.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low != high").select("key")
    out = S.materialize(held.join(keys.hint("merge"), "key").distinct())
    S.discard(held)
    return out


def _first(similarity: float) -> Column:
    """Whether a shared key can be the first shingle that two similar nodes share: nothing before it counts for their overlap."""
    return F.expr("least(n - pos, b_n - b_pos)") >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("b_n")) - EPS


def _band(similarity: float) -> Column:
    """Similar nodes' sizes lie in the same band or in adjacent ones (a bit wider, for sizes just on the bound)."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(1 / similarity) + 1e-6)).cast("int")


def _meetings(folded: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different groups under a key that may be similar, by place, size and folded sketch.

    A node meets those of its own band and of the band below that are not larger. Of these only the keys
    matter before which at most half of their prefix lies, as the overlap is ``2 t / (1 + t)`` of the smaller
    size at least. The larger nodes under a key and band are dealt over parts of ``MEET`` rows, and each smaller
    one goes to every part, so that a heavy key is several tasks and no row is made for a pair that fails.
    """
    parts = folded.groupBy("key", "band").agg(F.ceil(F.count("*") / MEET).cast("int").alias("parts"))
    larger = folded.join(parts.hint("merge"), ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    early = F.col("n") - F.col("pos") >= F.lit(2 * similarity / (1 + similarity)) * F.col("n") - EPS
    lower = folded.where(early).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(parts.hint("merge"), ["key", "band"])
    lower = lower.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"b_{c}") for c in PLACE + FOLDS])
    differ = functools.reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in FOLDS])
    near = differ <= F.lit(_allowed(similarity)) * (F.col("n") + F.col("b_n")) + EPS
    met = larger.join(lower.hint("merge"), ["key", "band", "part"]).where("grp != b_grp and (b_n < n or b_n = n and b_node < node)")
    return met.where(_first(similarity)).where(near).select(*_ordered("node", "b_node"))


def _hung(ties: DataFrame) -> DataFrame:
    """(grp, head) of the groups in ``ties`` (u, v): the smallest group that a group's smallest neighbour (or itself) is tied to.

    Groups of one head hang together. That need not be the whole component: what is left apart meets again later.
    """
    both = ties.select("u", "v").unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = S.materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")), few=True)
    out = S.materialize(least.join(least.toDF("v", "head"), "v").select(F.col("u").alias("grp"), "head"), few=True)
    S.discard(least)
    return out


def _contracted(held: DataFrame, links: DataFrame) -> DataFrame:
    """``held`` with groups that ``links`` between nodes tie together made one."""
    groups = held.select("node", "grp").distinct().hint("merge")
    parts = _hung(links.join(groups.toDF("a", "u"), "a").join(groups.toDF("b", "v"), "b").select("u", "v").where("u != v"))
    out = S.materialize(held.join(parts, "grp", "left").withColumn("grp", F.coalesce("head", "grp")).drop("head"))
    S.discard(held)
    S.discard(parts)
    return out


def _components(docs: DataFrame, text: str, rows: DataFrame, sets: DataFrame, prints: DataFrame, similarity: float, words_in_shingle: int) -> DataFrame:
    """(node, component) of the nodes that have a near copy; ``prints`` are (node, fp) of all."""
    order = docs.sparkSession.sparkContext.broadcast(_common(docs, text, words_in_shingle))  # MOST shingles
    make = _prefixes(similarity, order)
    stored = _sets(docs.withColumn("one", F.lit(1)), text, ["one"], make, "node long, key long, pos int, n int", words_in_shingle)
    near = simhash.near_pairs(prints)
    links = [_similar(near, sets, docs, text, rows, similarity, words_in_shingle)]
    parts = _hung(links[0].toDF("u", "v"))
    stored = stored.select("key", "node", "pos", "n").join(parts.withColumnRenamed("grp", "node"), "node", "left")
    held = S.materialize(stored.withColumn("grp", F.coalesce("head", "node")).drop("head"))
    S.discard(parts)
    for k in range(ROUNDS):
        held = _mixed(held)
        place = F.xxhash64("node") if k == 0 else F.xxhash64(F.lit(k), "key", "node")
        heads = held.groupBy("key").agg(F.min(F.struct(place.alias("place"), *PLACE)).alias("head"))
        met = held.join(heads.select("key", *[F.col(f"head.{c}").alias(f"b_{c}") for c in PLACE]).hint("merge"), "key").where("grp != b_grp")
        links.append(_similar(met.where(_first(similarity)).select(*_ordered("node", "b_node")), sets, docs, text, rows, similarity, words_in_shingle))
        held = _contracted(held, links[-1])
    held = _mixed(held)
    folded = S.materialize(held.join(_folds(sets).hint("merge"), "node").withColumn("band", _band(similarity)))
    links.append(_similar(_meetings(folded, similarity), sets, docs, text, rows, similarity, words_in_shingle))
    S.discard(held)
    S.discard(folded)
    parts = S.connected_components(functools.reduce(DataFrame.unionByName, links))
    for table in links:
        S.discard(table)
    return parts


def keep_dissimilar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words_in_shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of similar texts, that of the smallest id (null last).

    Cases: texts without words (null, empty, blank) are alike. Of rows with one id, that of the smaller
    hash of the text stays, then that of the smaller hash of all columns; of rows equal in all columns
    one stays. Null ids are ids that come last. An empty table gives no rows. A text's shingles, 8 bytes
    each, lie in one task. ``docs`` is read five times or so and must give the same rows each time.
    """
    columns = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(columns)])
    text, own = f"_c{columns.index(text_col)}", f"_c{columns.index(id_col)}"
    plain = [F.col(f.name) for f in marked.schema if not f.dataType.simpleString().startswith("map") and "map<" not in f.dataType.simpleString()]
    marked = marked.withColumns({"h1": F.xxhash64(*plain), "h2": F.xxhash64(F.lit(SEED), *plain), "h0": F.xxhash64(text)})
    rows = S.materialize(_sets(marked, text, [own, "h0", "h1", "h2"], _described, "node long, twin long, n int, fp long, s binary", words_in_shingle))
    order = F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("id"), "h0", "h1", "h2")
    stay = rows.groupBy("node").agg(F.min(order).alias("first"), F.min("twin").alias("low"), F.max("twin").alias("high"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("s").alias("s"))
    twice = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two shingle sets share a name"))).cast("boolean")
    sets = S.materialize(stay.where(F.coalesce(twice, F.lit(True))).select("node", "n", "fp", "s", "first"))
    S.discard(rows)
    reps = sets.select("node", F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2"))
    parts = S.materialize(_components(marked, text, reps, sets.select("node", "n", "s"), sets.select("node", "fp"), similarity, words_in_shingle), few=True)
    known = parts.join(sets.select(F.col("node").alias("named"), "first"), F.col("node") == F.col("named"))
    best = known.groupBy("component").agg(F.min(F.struct("first", "node")).alias("best")).select(F.col("best.node").alias("node"))
    gone = parts.select("node").join(best, "node", "left_anti")
    kept = S.materialize(reps.join(gone, "node", "left_anti").select("h1", "h2").distinct(), few=True)
    S.discard(sets)
    S.discard(parts)
    # rows equal in all columns are told apart by nothing: one of them stays
    again = Window.partitionBy("h1", "h2").orderBy("h1")
    out = marked.join(kept.hint("merge"), ["h1", "h2"]).withColumn("again", F.row_number().over(again)).where("again = 1")
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)])
