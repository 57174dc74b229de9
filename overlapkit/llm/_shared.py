"""What several operators share: scratch tables, text batches, hashed features, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from overlapkit.sources import scratch_dir


def materialize(df: DataFrame, codec: str = "zstd", few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    ``discard`` deletes the table; what is left goes when the driver ends. ``few``: rows of a few numbers
    are dealt anew before they are written, to an eighth of the shuffle's partitions (one a core at least),
    so that many tasks with few rows do not write a file each. Tasks before that are as many as ever.
    """
    path = scratch_dir(df.sparkSession)
    if few:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8
        df = df.hint("rebalance", max(1, df.sparkSession.sparkContext.defaultParallelism, parts))
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._overlapkit_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``materialize`` result that no later plan reads."""
    path = getattr(df, "_overlapkit_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (text or binary) holds about ``max_bytes`` in each piece.

    A single value above the limit makes a piece of its own, whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def strings(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], names=[*keep, *more])


def schema_of(df: DataFrame, columns: list[str], **more: str) -> StructType:
    """Schema of an Arrow map's result: ``columns`` of ``df`` as they are, and more by type name."""
    kept = [StructField(c, df.schema[c].dataType, True) for c in columns]
    added = df.sparkSession.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in more.items())).schema.fields if more else []
    return StructType([*kept, *added])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` rows (all of a smaller table), the same ones on every run: a share by the hash of ``by``.

    ``by`` tells rows apart, so the number taken strays by the square root of ``rows`` at most times a
    few. Rows are counted and filtered where they lie; nothing is ordered and nothing moves.
    """
    bound = int((1 << 30) * min(1.0, rows / max(df.count(), 1)))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < bound)


def ordered_sums(df: DataFrame, order: list[Column], sums: dict[str, str], group: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each new name in ``sums``, the sum of a column over all rows before, in ``order``.

    With ``group`` the sums run within it. Rows are dealt by ranges of (group, order), summed within
    each range, and ranges add what earlier ones hold: neither a table nor a group meets in one task.
    ``order`` must tell rows apart where their places matter.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)  # the ranges stay as they are
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_n{k}") for k, c in enumerate(sums.values())])
    starts = totals.select(
        F.col("_part").alias("_at"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)],
        *[F.coalesce(F.sum(f"_n{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in range(len(sums))],
    )
    on = F.col("_part") == F.col("_at")
    for k, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = ranged.withColumns({f"_o{k}": F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in enumerate(sums.values())}).join(starts, on)
    return out.select(*df.columns, *[(F.col(f"_o{k}") + F.col(f"_s{k}")).alias(n) for k, n in enumerate(sums)])


# ---------------------------------------------------------------------------------------------
# connected components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reachable.

    Alternates the two star contractions: every node hangs its larger neighbours, then its smaller
    ones, on the smallest node it knows. Minimum per node is an aggregation (combined before the
    shuffle) joined back, so no node's neighbours meet in one task. Each round is written to the
    shared folder, and the rounds end when one changes nothing. Nulls and self-links are ignored.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct(), few=True
    )
    nodes = spark.createDataFrame([], f"node {dict(now.dtypes)['u']}, component {dict(now.dtypes)['u']}")
    if now.isEmpty():
        discard(now)
        return nodes
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
        )
        new = materialize(small.distinct(), few=True)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# ---------------------------------------------------------------------------------------------
# hashed text features, over one byte buffer for many texts

GRAM = 5  # bytes in a feature
PRIME = np.uint32(16_777_619)


def grams(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte ``GRAM``-grams of lower-cased texts: bucket of each, and the texts' offsets.

    Runs of white space count as one space and a text begins and ends with one, so a gram sees
    where words begin. Offsets has one entry more than texts; a text too short has one gram.
    """
    joined = [b" %s " % b" ".join(t.lower().split()) for t in texts]
    joined = [t if len(t) >= GRAM else t.ljust(GRAM) for t in joined]
    buf = np.frombuffer(b"".join(joined), dtype=np.uint8).astype(np.uint32)
    h = np.full(len(buf), 2_166_136_261, dtype=np.uint32)
    for k in range(GRAM):
        part = buf[k:] if k else buf
        h[: len(part)] = (h[: len(part)] ^ part) * PRIME
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(2_654_435_761)) >> np.uint32(32 - bits)
    ends = np.cumsum([len(t) for t in joined], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep = np.ones(len(buf), dtype=bool)
    for k in range(1, GRAM):
        keep[ends - k] = False
    offsets = np.concatenate([[0], np.cumsum(ends - starts - (GRAM - 1))]).astype(np.int64)
    return h[keep].astype(np.int32), offsets


def pooled(weights: np.ndarray, texts: list[bytes], bits: int) -> np.ndarray:
    """Mean weight of each text's grams."""
    if not texts:
        return np.zeros(0)
    h, offsets = grams(texts, bits)
    return np.add.reduceat(weights[h], offsets[:-1]) / np.diff(offsets)


UNIT = 1 << 16  # features are summed as whole numbers of 1 / UNIT, so that no order of tasks changes a sum


def cell_sums(rows: DataFrame, features, columns: list[str], centres: np.ndarray, scale: np.ndarray, without: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of rows, mean features) of each cell that has rows, over all rows.

    A row falls to the nearest of ``centres`` (in units of ``scale``); ``features(batch)`` gives a batch's
    vectors, ``columns[0]`` is its text. Counts and sums are combined within tasks, then by cell: at most
    ``len(centres)`` rows reach the driver, however many were summed. Rows whose ``id`` is in ``without`` do
    not count: cells and features are joined with it then, not the texts.
    """
    spark, dims = rows.sparkSession, centres.shape[1]
    shared = spark.sparkContext.broadcast((centres / scale, scale))  # a bounded sample's vectors
    names = [f"x{k}" for k in range(dims)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, unit = shared.value
        half = (at**2).sum(axis=1) / 2
        n, sums = np.zeros(len(at), dtype=np.int64), np.zeros((len(at), dims), dtype=np.int64)
        for batch in slices(batches, columns[0], 1_000_000):
            x = features(batch)
            for a in range(0, len(x), 4_096):
                part = x[a : a + 4_096]
                cell = np.argmax((part / unit) @ at.T - half, axis=1)
                n += np.bincount(cell, minlength=len(at))
                np.add.at(sums, cell, np.rint(part * UNIT).astype(np.int64))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array(sums[some, k]) for k in range(dims))], names=["cell", "n", *names])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, unit = shared.value
        half = (at**2).sum(axis=1) / 2
        for batch in slices(batches, columns[0], 1_000_000):
            x = features(batch)
            cell = np.concatenate([np.argmax((x[a : a + 4_096] / unit) @ at.T - half, axis=1) for a in range(0, len(x), 4_096)])
            values = pa.array(np.rint(x * UNIT).astype(np.int64).ravel())
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), values)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell), held], names=["id", "cell", "x"])

    if without is not None:
        placed = rows.select("id", *columns).mapInArrow(place, schema_of(rows, ["id"], cell="long", x="array<long>"))
        # sorted on both sides at every size, so that shuffled bytes grow as the rows do
        made = placed.join(without.hint("merge"), "id", "left_anti").select("cell", F.lit(1).cast("long").alias("n"), *[F.col("x")[k].alias(n) for k, n in enumerate(names)])
    else:
        made = rows.select(*columns).mapInArrow(add, ", ".join(["cell long", "n long", *(f"{x} long" for x in names)]))
    table = made.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).orderBy("cell").toArrow()
    n = table["n"].to_numpy().astype(np.float64)
    return n, np.stack([table[x].to_numpy() for x in names], axis=1).reshape(-1, dims) / UNIT / np.maximum(n, 1)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(scores: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of ``y`` on ``scores`` (Newton, smoothed targets)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, scale = scores.mean(), scores.std() or 1.0
    x = np.stack([(scores - mean) / scale, np.ones(len(scores))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        w -= np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * w)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)
