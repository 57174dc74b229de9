"""Embedding near-duplicates through a pivot-permutation index.

``pivots`` reference points are taken from a bounded sample of the vectors. A vector is described by
the ordered list of its ``prefix`` nearest ones. The inverted lists are kept for pairs of pivots: a
vector stands in the list of every two of its pivots, so two vectors that meet in a list share two
pivots at least, and their shared-pivot count (a product of two 0/1 matrices inside the list) must
reach ``min_shared`` before their cosine is computed in double precision.

The number of pivots grows with the square root of the rows of the largest label, so that lists, of
which there are as many as pairs of pivots, keep their length; a vector's prefix grows by one each time
it doubles, which keeps recall where it is (0.99 of pairs at a cosine of 0.93 among 64 random dimensions
with 128 pivots as with 4096).

A pair meets in as many lists as it shares pairs of pivots; it is counted only in the list of its
two lowest shared pivots, so counts need no removal of repeats. Lists above ``list_rows`` are dealt
into blocks by a hash, and every two blocks are compared, each in a group of its own: no list is
gathered whole, and none is cut short. A group returns a row per linked vector and the edges of a
spanning forest, never all pairs. Equal vectors of a label are one node with a weight; nodes are
numbered, and rows find theirs by label and vector, so no two vectors are taken for one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S


LEAST, LEAST_ROWS, MOST = 128, 20_000, 8_192  # pivots for up to so many rows of a label, and at most


def choose_pivots(nodes: DataFrame, count: int) -> np.ndarray:
    """(about ``count``, dimensions) unit vectors, taken by hash; no more rows reach the driver."""
    rows = S.bounded_sample(nodes.select("label", "vector"), count, "label", "vector").select("vector").collect()
    found = np.unique(np.array([r["vector"] for r in rows], dtype=np.float64), axis=0)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each unit vector's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def forest(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of a spanning forest of a boolean adjacency matrix."""
    n = len(adjacent)
    fresh = np.ones(n, dtype=bool)
    child, parent = [], []
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(adjacent[at] & fresh)
            fresh[new] = False
            child.append(new)
            parent.append(np.full(len(new), at))
            queue += new.tolist()
    return np.concatenate(child), np.concatenate(parent)


def _compare(ids, weights, x, member, second, left, right, cosine, min_shared):
    """Links inside a list's block (or between two of its blocks): (id, links) rows and forest edges."""
    sims = x[left] @ x[right].T
    shared = member[left] @ member[right].T
    lower = member[left][:, :second] @ member[right][:, :second].T  # shared pivots below the list's second: its first alone
    linked = (sims >= cosine) & (shared >= min_shared) & (lower == 1)
    if left is right:
        np.fill_diagonal(linked, False)
        count = linked @ weights[left]
        child, parent = forest(linked) if linked.any() else (np.zeros(0, int), np.zeros(0, int))
        return [(ids[left], count)], ids[left][child], ids[left][parent]
    counts = [(ids[left], linked @ weights[right]), (ids[right], linked.T @ weights[left])]
    if not linked.any():
        return counts, ids[:0], ids[:0]
    n, m = linked.shape
    whole = np.zeros((n + m, n + m), dtype=bool)
    whole[:n, n:], whole[n:, :n] = linked, linked.T
    child, parent = forest(whole)
    both = np.r_[ids[left], ids[right]]
    return counts, both[child], both[parent]


def near_duplicates(
    table: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    pivots: int | None = None,
    prefix: int | None = None,
    min_shared: int = 2,
    list_rows: int = 1024,
) -> DataFrame:
    """(id, n_links, component_id, kept): one row per vector; only vectors of one label are compared.

    Cases: a null, empty or zero vector, one with null or non-finite components, and one without a
    label link with nothing and stand alone; so does a vector of another length than its partner's.
    ``pivots`` and ``prefix`` follow from the rows unless given.
    Equal vectors of a label link with each other, whatever their ids; rows that repeat an id are
    rows of their own. An empty table gives no rows.
    """
    spark = table.sparkSession
    t = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    good = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    good = F.coalesce(good, F.lit(False)) & F.col("label").isNotNull()
    t = t.withColumn("vector", F.when(good, F.transform("vector", lambda v: v + F.lit(0.0))))  # -0.0 becomes 0.0
    nodes = t.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    nodes = S.materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    of_size = nodes.withColumn("dim", F.size("vector"))
    found: list[DataFrame] = []
    made: list[DataFrame] = []
    edges: list[DataFrame] = []
    largest = of_size.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"))
    for dim, most in largest.orderBy("dim").collect():  # one index for each length of vectors
        own = of_size.where(F.col("dim") == dim)
        count = pivots or int(np.clip(LEAST * np.sqrt(most / LEAST_ROWS), LEAST, MOST))
        length = prefix or 6 + round(np.log2(max(count, LEAST) / LEAST))
        points = choose_pivots(own, count)
        links = _links(own, points, cosine, length, min_shared, list_rows, dim)
        links = S.materialize(links)
        made.append(links)
        found.append(links.where("other is null").select("node", "links"))
        edges.append(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    if not found:
        none = spark.createDataFrame([], "node long, links double, a long, b long")
        found, edges = [none.select("node", "links")], [none.select("a", "b")]
    all_links, all_edges = found[0], edges[0]
    for more, edge in zip(found[1:], edges[1:], strict=True):
        all_links, all_edges = all_links.unionByName(more), all_edges.unionByName(edge)
    counts = all_links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = S.connected_components(all_edges).withColumnRenamed("node", "in_part")
    named = nodes.join(counts, "node", "left").join(parts, F.col("node") == F.col("in_part"), "left")
    named = named.select("label", "vector", "weight", "least", F.coalesce("links", F.lit(0.0)).alias("links"), F.coalesce("component", "node").alias("part"))
    named = S.materialize(named)
    for links in made:
        S.discard(links)
    S.discard(nodes)
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(least, "part").select("label", "vector", F.lit(True).alias("known"), "weight", "links", "component_id")
    out = t.join(named, ["label", "vector"], "left")
    n = F.coalesce(F.round(F.col("links")).cast("long") + F.col("weight") - 1, F.lit(0)).cast("long")
    part = F.when(F.col("known").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), n.alias("n_links"), part.alias("component_id"), F.coalesce(F.col("id") == part, F.lit(False)).alias("kept")
    )


def _links(nodes: DataFrame, points: np.ndarray, cosine: float, prefix: int, min_shared: int, list_rows: int, dim: int) -> DataFrame:
    """(node, other, links): with ``other`` null a node's count in one list, else an edge."""
    spark = nodes.sparkSession
    few = len(points)
    prefix = min(prefix, few)
    share = spark.sparkContext.broadcast(points)  # at most ``pivots`` vectors

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 4_096):
                batch = big.slice(a, 4_096)
                x = np.array(batch.column("vector").to_pylist(), dtype=np.float64).reshape(-1, dim)
                x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
                near = prefixes(x, share.value, prefix)
                order = np.sort(near, axis=1)
                i, j = np.triu_indices(prefix, 1) if prefix > 1 else (np.zeros(1, int), np.zeros(1, int))
                key = order[:, i] * few + order[:, j]
                row = np.repeat(np.arange(len(x)), key.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(row)) for c in ("label", "node", "weight")]
                    + [pa.array(key.ravel()), pa.array([near[r].astype("<u2").tobytes() for r in row], pa.binary()),
                       pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(row))],
                    names=["label", "node", "weight", "key", "near", "unit"],
                )

    schema = S.schema_of(nodes, ["label"], node="long", weight="long", key="long", near="binary", unit="binary")
    described = nodes.select("label", "node", "weight", "vector").mapInArrow(describe, schema)
    lists = described.select("label", "key").groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")
    lists = S.materialize(lists.select("label", "key", F.ceil(F.col("n") / list_rows).cast("long").alias("blocks")))
    rows = described.join(lists, ["label", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("label", "key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "weight", "near", "unit")
    rows = rows.repartition("label", "key", "lo", "hi").sortWithinPartitions("label", "key", "lo", "hi", "node")

    def one(batch: pa.Table) -> tuple[list, list, list]:
        """Rows of one list's block or pair of blocks."""
        n = batch.num_rows
        ids, weights = batch["node"].to_numpy(), batch["weight"].to_numpy().astype(np.float64)
        x = np.frombuffer(b"".join(batch["unit"].to_pylist()), dtype=np.float64).reshape(n, -1)
        near = np.frombuffer(b"".join(batch["near"].to_pylist()), dtype="<u2").reshape(n, -1)
        used, place = np.unique(near, return_inverse=True)  # the pivots of these rows alone
        member = np.zeros((n, len(used)), dtype=np.float32)
        member[np.arange(n)[:, None], place.reshape(near.shape)] = 1
        second = int(batch["key"][0].as_py()) % few
        lo, hi = batch["lo"][0].as_py(), batch["hi"][0].as_py()
        own = batch["own"].to_numpy()
        if prefix == 1:  # a single reference point: one list, shared by all
            second = 1
        second = int(np.searchsorted(used, second))
        left = np.flatnonzero(own == lo)
        right = left if lo == hi else np.flatnonzero(own == hi)
        if not len(left) or not len(right):
            return [], [], []
        need = min_shared if prefix > 1 else 1
        counts, child, parent = _compare(ids, weights, x, member, second, left, right, cosine, need)
        return counts, child.tolist(), parent.tolist()

    names = ["label", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            node, other, links = [], [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                counts, child, parent = one(table.slice(a, b - a))
                for i, c in counts:
                    some = c > 0
                    node += i[some].tolist()
                    links += c[some].tolist()
                    other += [None] * int(some.sum())
                node += child
                other += parent
                links += [None] * len(child)
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.float64())], names=["node", "other", "links"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            change = np.zeros(table.num_rows, dtype=bool)
            for c in names if table.num_rows else ():
                column = table[c].combine_chunks()
                change[1:] |= pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(change).tolist()]
            held = table.slice(cuts[-1])  # the last group may go on in the next batch; a group is bounded
            if len(cuts) > 1:
                yield flush(table, cuts)
        if held is not None and held.num_rows:
            yield flush(held, [0, held.num_rows])

    return rows.mapInArrow(run, "node long, other long, links double")
