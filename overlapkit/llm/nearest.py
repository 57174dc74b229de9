"""Exact nearest neighbours of many queries by a block matrix join on int8 codes.

Vectors are packed where they lie into blocks: ids, values, and int8 codes with a scale a vector
(``v = scale * code + rest``, the length of the rest is kept). Candidate blocks are dealt into groups
and shuffled once; query blocks, which are few, are copied to every group; an equi-join on the group
brings each query block to each candidate block of the group, one tile a row.

In a tile one integer product gives the distances between the coded vectors, and these differ from the
true ones by no more than both rests together. A candidate whose lower bound is above a query's k-th
upper bound (of this tile, or of the heap so far) can't be among its k nearest; the others are
computed from the values in double precision and offered to the query's heap of k. A query block's
tiles follow each other, so a task sends its k best of the group once; should they not, it sends more
rows, never other ones. Heaps of the groups meet by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

#: Vectors in a block of candidates and of queries, and candidate blocks in a group at most.
CANDIDATES, QUERIES, GROUP = 2_048, 1_024, 512
EXACT = 1_000  # dimensions whose products of codes add up exactly in single precision
BLOCK = "dim int, n int, ids binary, data binary, codes binary, scale binary, rest binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each row, and an upper bound of the length of what the codes leave out."""
    scale = np.abs(x).max(axis=1) / 127
    with np.errstate(all="ignore"):
        codes = np.rint(x / np.where(scale > 0, scale, 1.0)[:, None])
        codes = np.clip(np.nan_to_num(codes), -127, 127).astype(np.int8)
        rest = np.linalg.norm(x - scale[:, None] * codes, axis=1)
        size = np.linalg.norm(x, axis=1)
        return codes, scale, rest + 1e-9 * (rest + size)  # more than rounding can take away


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of int8 rows: single precision is exact for up to ``EXACT`` dimensions at once."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def bounds(qc, qs, qr, cc, cs, cr) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between two blocks of coded vectors."""
    with np.errstate(all="ignore"):
        squares = lambda c, s: (c.astype(np.float64) ** 2).sum(axis=1) * s * s
        d = squares(qc, qs)[:, None] + squares(cc, cs)[None] - 2 * np.outer(qs, cs) * code_products(qc, cc)
        size = np.sqrt(squares(qc, qs))[:, None] + np.sqrt(squares(cc, cs))[None]
        d, off = np.sqrt(np.maximum(d, 0)), qr[:, None] + cr[None] + 1e-7 * size  # the root of a rounded difference
        return d - off, d + off


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares added in order of dimensions."""
    with np.errstate(all="ignore"):
        return np.sqrt(np.add.accumulate((a - b) ** 2, axis=1)[:, -1])


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """A row for each block of at most ``rows`` vectors of one length, made where the vectors lie."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int, ids: list, values: list) -> pa.RecordBatch:
            x = np.array(values, dtype=np.float64).reshape(len(ids), dim)
            codes, scale, rest = quantise(x)
            row = [dim, len(ids), np.array(ids, dtype=np.int64).tobytes(), x.tobytes(), codes.tobytes(), scale.tobytes(), rest.tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            names = ["dim", "n", "ids", "data", "codes", "scale", "rest"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                ids, values = held.setdefault(len(v), ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) == rows:
                    yield block(len(v), *held.pop(len(v)))
        for dim, (ids, values) in held.items():
            yield block(dim, ids, values)

    return vectors.mapInArrow(pack, BLOCK)


def _tiles(k: int):
    """Maps joined block rows to (q_block, q_no, query_id, vec_id, score), k rows a query of a group at most."""

    def read(batch: pa.RecordBatch, i: int, side: str) -> list[np.ndarray]:
        n, dim = batch.column(side + "n")[i].as_py(), batch.column("dim")[i].as_py()
        raw = lambda c, kind: np.frombuffer(batch.column(side + c)[i].as_buffer(), kind)
        return [raw("ids", np.int64), raw("data", np.float64).reshape(n, dim), raw("codes", np.int8).reshape(n, dim), raw("scale", np.float64), raw("rest", np.float64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q, heaps = None, None, []

        def flush() -> pa.RecordBatch:
            rows = [(at, no, int(q[0][no]), -i, -s) for no, heap in enumerate(heaps) for s, i in heap]
            names, kinds = ["q_block", "q_no", "query_id", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("q_block")[i].as_py()
                if block != at:
                    if at is not None:
                        yield flush()
                    at, q = block, read(batch, i, "q_")
                    heaps = [[] for _ in q[0]]
                c = read(batch, i, "")
                low, high = bounds(*q[2:], *c[2:])
                own = q[0][:, None] == c[0][None]
                high[own] = np.inf
                most = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(high), np.inf)
                most = np.fmin(most, [-h[0][0] if len(h) == k else np.inf for h in heaps])
                row, col = np.nonzero(~own & ~(low > most[:, None]))
                for a in range(0, len(row), 65_536):
                    r, s = row[a : a + 65_536], col[a : a + 65_536]
                    for no, score, vec in zip(r.tolist(), distances(q[1][r], c[1][s]).tolist(), c[0][s].tolist(), strict=True):
                        if len(heaps[no]) < k:
                            heapq.heappush(heaps[no], (-score, -vec))
                        elif (-score, -vec) > heaps[no][0]:
                            heapq.heapreplace(heaps[no], (-score, -vec))
        if at is not None:
            yield flush()

    return run


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERIES, candidate_rows: int = CANDIDATES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest candidates of every query by Euclidean distance.

    Nearest first, ties to the smaller id; all candidates where they are fewer than k. Exact.
    Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part on
    either side; only vectors of one length are compared; a row that bears the query's id is no
    candidate for it; rows without an id take no part; rows of ``queries`` that repeat an id are
    answered one by one, and candidates that repeat one may stand in an answer together. Distances
    beyond the largest double are infinite and come last. Empty tables give no rows.
    """

    def good(df: DataFrame) -> DataFrame:
        t = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
        return t.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    spark = candidates.sparkSession
    packed = S.materialize(_blocks(good(candidates), candidate_rows).withColumn("block", F.monotonically_increasing_id()), codec="none")
    asked = S.materialize(_blocks(good(queries), query_rows).withColumn("q_block", F.monotonically_increasing_id()), codec="none")
    count, width = packed.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(count, max(width, -(-count // GROUP))))
    right = packed.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups))).drop("block")
    left = asked.select("q_block", "dim", *[F.col(c).alias("q_" + c) for c in ("n", "ids", "data", "codes", "scale", "rest")])
    left = left.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    # a merge join gives all candidate blocks of a query block in a row
    met = left.hint("merge").join(right, ["grp", "dim"])
    best = met.mapInArrow(_tiles(k), "q_block long, q_no int, query_id long, vec_id long, score double")
    w = Window.partitionBy("q_block", "q_no").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
