"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the binary
[23,12,7] Golay code. That code is perfect: every 23-bit word lies within 3 errors of exactly one
codeword. Decoding a segment to the codewords *near* it (within 4 errors: one, or six) gives several
12-bit indices, and if two words differ in one bit, the nearest codeword of one is always among the
near codewords of the other.

Four errors over three segments, smallest first, leave two cases:

* the best segment has none: the pair shares that whole segment;
* the best two have one each: in those two, nearest codewords of one document meet near codewords
  of the other.

So each fingerprint is *stored* under 6 keys (3 whole segments, 3 pairs of nearest codewords) and
*looked up* under 3 whole segments and about 85 pairs of near codewords. An equi-join on the key
gives candidates and an exact popcount verifies them: no link within the distance is missed, none
beyond it is made.

Only distinct fingerprints take part, and pairs within a group are not all made: fingerprints first
hang on the smallest one stored under each of their keys (an aggregation), which ties dense groups
together; the lookup then only asks the *other* groups under a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

SEED = 42
GENERATOR = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1, of the [23,12,7] code (a fixed value)
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and bits
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: bytes, words_in_shingle: int = 4) -> int:
    """64-bit SimHash of a lower-cased text: a bit is set if over half of its shingles' hashes set it."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > words_in_shingle:
        starts, ends = starts[: 1 - words_in_shingle], ends[words_in_shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    for a in range(0, n, 50_000):
        spans = zip(starts[a : a + 50_000].tolist(), ends[a : a + 50_000].tolist(), strict=True)
        h = np.array([digest(line[i:j], SEED) for i, j in spans], dtype=">u8")
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes: a bit is set if over half of them set it."""
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 50_000):
        total += np.unpackbits(hashes[a : a + 50_000].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def add_fingerprint(docs: DataFrame, *, text_col: str = "text", keep: list[str], words_in_shingle: int = 4) -> DataFrame:
    """``keep`` columns and ``fp``, the signed 64-bit fingerprint. Null and blank texts give zero."""
    schema = S.schema_of(docs, keep, fp="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, text_col):
            fp = np.array([fingerprint(t, words_in_shingle) for t in S.utf8(batch.column(text_col))], dtype=np.uint64)
            yield S.with_columns(batch, keep, fp=pa.array(fp.view(np.int64)))

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator: the 11-bit syndrome."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ GENERATOR << bit - 11, out)
    return out


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: the error pattern of weight 3 at most, and those of weight 4 (six slots).

    Returns (leader, near, counts): near[s, :counts[s]] are all patterns of weight up to 4.
    """
    bits = [1 << k for k in range(23)]
    patterns = [0]
    level = [(0, -1)]
    for _ in range(4):
        level = [(p | bits[k], k) for p, last in level for k in range(last + 1, 23)]
        patterns += [p for p, _ in level]
    p = np.array(patterns, dtype=np.int64)
    s = _remainder(p)
    near, counts = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    leader = np.zeros(2048, dtype=np.int64)
    for pattern, syndrome in zip(p.tolist(), s.tolist(), strict=True):  # by weight, so the first is the leader
        if not counts[syndrome]:
            leader[syndrome] = pattern
        near[syndrome, counts[syndrome]] = pattern
        counts[syndrome] += 1
    return leader, near, counts


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stored, looked up, owner of each looked up): keys of signed 64-bit fingerprints.

    ``stored`` is (n, 6); ``looked up`` is flat, ``owner`` being the row of its fingerprint.
    """
    leader, near, counts = golay_tables()
    u = fps.view(np.uint64)
    whole, nearest, listed, many = [], [], [], []
    for shift, bits in SEGMENTS:
        seg = (u >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndrome = _remainder(seg)
        whole.append(seg)
        nearest.append((seg ^ leader[syndrome]) >> 11)  # systematic: the high 12 bits name a codeword
        listed.append((seg[:, None] ^ near[syndrome]) >> 11)
        many.append(counts[syndrome])
    tag = lambda k: np.int64(k) << 32
    stored = [tag(k) | whole[k] for k in range(3)] + [tag(3 + k) | nearest[i] << 12 | nearest[j] for k, (i, j) in enumerate(PAIRS)]
    rows = np.arange(len(fps))
    asked, owner = [tag(k) | whole[k] for k in range(3)], [rows] * 3
    for k, (i, j) in enumerate(PAIRS):
        grid = (tag(3 + k) | listed[i][:, :, None] << 12 | listed[j][:, None, :]).reshape(len(fps), -1)
        real = ((np.arange(6) < many[i][:, None])[:, :, None] & (np.arange(6) < many[j][:, None])[:, None, :]).reshape(len(fps), -1)
        asked.append(grid[real])
        owner.append(np.repeat(rows, real.sum(axis=1)))
    return np.stack(stored, axis=1), np.concatenate(asked), np.concatenate(owner)


def _emit(which: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 1_000):  # up to 36 * 3 keys each: small batches on both sides
                batch = big.slice(a, 1_000)
                fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
                stored, asked, owner = keys(fps)
                if which == "stored":
                    owner, key = np.repeat(np.arange(len(fps)), 6), stored.ravel()
                else:
                    key = asked
                columns = [batch.column(c).take(pa.array(owner)) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays([pa.array(key), *columns], names=["key", *batch.schema.names])

    return run


def link(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """(fp, component) for a table of distinct ``fp``; component is the smallest fp reachable."""
    if not 0 <= max_distance <= 4:
        raise ValueError("the keys cover distances up to 4")
    nodes = nodes.select("fp")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance
    stored = nodes.mapInArrow(_emit("stored"), "key long, fp long")
    first = stored.groupBy("key").agg(F.min("fp").alias("b"))
    hung = stored.join(first, "key").where((F.col("fp") != F.col("b")) & close("fp", "b"))
    dense = S.materialize(S.connected_components(hung.select(F.col("fp").alias("a"), "b")))
    grouped = nodes.join(dense, nodes.fp == dense.node, "left").select("fp", F.coalesce("component", "fp").alias("grp"))
    grouped = S.materialize(grouped)
    held = grouped.mapInArrow(_emit("stored"), "key long, fp long, grp long")
    held = held.select("key", F.col("fp").alias("b"), F.col("grp").alias("b_grp"))
    asked = grouped.mapInArrow(_emit("asked"), "key long, fp long, grp long")
    groups = held.groupBy("key", "b_grp").agg(F.min("b").alias("one"), F.max("b").alias("other"))
    # a group with one fingerprint under the key is verified in the join itself
    worth = (F.col("grp") != F.col("b_grp")) & ((F.col("one") != F.col("other")) | close("fp", "one"))
    met = asked.join(groups.hint("shuffle_hash"), "key").where(worth)
    met = S.materialize(met.select("key", "fp", "grp", "one", "other", "b_grp"))
    sole = met.where(F.col("one") == F.col("other")).select("fp", "grp", F.col("one").alias("b"), "b_grp")
    more = met.where(F.col("one") != F.col("other")).select("key", "fp", "grp", "b_grp")
    more = more.join(held, ["key", "b_grp"]).select("fp", "grp", "b", "b_grp")
    across = sole.unionByName(more).where(close("fp", "b")).select(F.col("grp").alias("a"), F.col("b_grp").alias("b"))
    top = S.materialize(S.connected_components(across))
    out = grouped.join(top, grouped.grp == top.node, "left")
    return out.select("fp", F.coalesce("component", "grp").alias("component"))


def near_pairs(nodes: DataFrame, max_distance: int = 4) -> DataFrame:
    """Pairs (a, b) of nodes within ``max_distance`` bits, from a table of (node, fp): as many as there are nodes and looked-up keys at most.

    Nodes of one fingerprint meet the smallest of them; every fingerprint looks up its keys and meets the
    smallest fingerprint stored under each. So not every pair within the distance is given, only those
    with the smallest fingerprint under a key that both share.
    """
    if not 0 <= max_distance <= 4:
        raise ValueError("the keys cover distances up to 4")
    firsts = S.materialize(nodes.groupBy("fp").agg(F.min("node").alias("node")).select("fp", "node"), few=True)
    same = nodes.join(firsts.select("fp", F.col("node").alias("b")).hint("merge"), "fp").where("node != b").select(F.col("node").alias("a"), "b")
    kind = f"key long, fp long, node {dict(nodes.dtypes)['node']}"
    heads = firsts.mapInArrow(_emit("stored"), kind).groupBy("key").agg(F.min(F.struct("fp", "node")).alias("head"))
    heads = heads.select("key", F.col("head.fp").alias("b_fp"), F.col("head.node").alias("b"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b_fp"))) <= max_distance
    asked = firsts.mapInArrow(_emit("asked"), kind)
    # without a hint Spark takes either side for as large as ``firsts``, and broadcasts all looked-up keys
    across = asked.join(heads.hint("shuffle_hash"), (asked.key == heads.key) & (F.col("fp") != F.col("b_fp")) & close).select(F.col("node").alias("a"), "b")
    return same.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, words_in_shingle: int = 4
) -> DataFrame:
    """(id, fp, component_id, component_fp): one row per document.

    component_id is the smallest id reachable by links, component_fp the smallest fingerprint.

    Cases: null, empty and blank texts share fingerprint zero and link like any other; texts shorter
    than a shingle hash whole; repeated rows and repeated ids keep a row each; a null id keeps its
    row and never names a component unless all ids in it are null. An empty table gives no rows.
    """
    marked = S.materialize(add_fingerprint(docs, text_col=text_col, keep=[id_col], words_in_shingle=words_in_shingle))
    nodes = S.materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    parts = S.materialize(link(nodes, max_distance).join(nodes, "fp"))
    names = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = parts.select("fp", "component").join(names, "component").select("fp", "component_id", F.col("component").alias("component_fp"))
    return marked.join(named, "fp").select(id_col, "fp", "component_id", "component_fp")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, words_in_shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that of the smallest id (null last).

    Of rows that are equal in id and fingerprint the one with the smallest hash of its text stays, and
    of equal texts any. Cases as in ``simhash_components``; other columns pass through whatever their names.
    """
    found = simhash_components(docs, id_col=id_col, text_col=text_col, max_distance=max_distance, words_in_shingle=words_in_shingle)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "fp")).alias("first")
    stay = found.groupBy("component_fp").agg(first).select(F.col("first.id").alias("stay_id"), F.col("first.fp").alias("stay_fp"))
    columns = docs.columns
    marked = docs.withColumns({f"_c{k}": F.col(f"`{c}`") for k, c in enumerate(columns)}).select(*[f"_c{k}" for k in range(len(columns))])
    text, own = f"_c{columns.index(text_col)}", f"_c{columns.index(id_col)}"
    marked = add_fingerprint(marked, text_col=text, keep=marked.columns, words_in_shingle=words_in_shingle)
    kept = marked.join(stay, (F.col("fp") == F.col("stay_fp")) & F.col(own).eqNullSafe(F.col("stay_id")), "left_semi")
    whole = F.struct(*[F.col(f"_c{k}") for k in range(len(columns))]).alias("whole")
    kept = kept.groupBy(own, "fp").agg(F.min_by(whole, F.xxhash64(text)).alias("whole")).select("whole.*")
    return kept.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)])
