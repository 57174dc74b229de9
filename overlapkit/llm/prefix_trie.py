"""The prefix trie of conversations: what each shared beginning holds, and what storing it once saves.

Turns become numbers of a dictionary of (role, text), met by a digest, so no text is shuffled. A
conversation is a row of numbers; conversations are dealt by ranges of these rows and sorted. Members
with equal rows are packed into chunks of ids first, so a row that many conversations share is a few
chunks, hashed as they stream by in order.

A task cuts its sorted rows into range shards of bounded size. A shard is a ternary search tree:
every node has a turn, a lower and a higher sibling, and a first child; rows are inserted median
first, which balances the siblings. One iterative walk lists the nodes, parents first; read backwards
it adds members, leaves and savings up. Only nodes on the paths of a shard's first and last row can
lie in other shards too. These boundary nodes leave with the digest of their path and are added up
over shards by it; everything is kept as sums, and what two neighbouring shards both counted (their
common path, and a last row that goes on in the next shard) is taken off once, from the two rows that
face each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S

SHARD, CHUNK, SALTS = 50_000, 4_096, 16  # turns in a shard; ids in a chunk; parts of a boundary node's children
NODE = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, weight long, once long, ends_sha256 string"
ROWS = "kind int, " + NODE + ", part int, ids array<long>, sizes array<long>, last array<long>"


def turn_sequences(table: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): each conversation's turns in order, as dictionary numbers, and their texts' code points.

    Turns are in the order of ``turn_col`` (null first), those of equal numbers in that of the SHA-256
    of length of role, ":", role and text. A null role or text is an empty one; rows without a
    conversation are left out. Numbers differ from run to run, equal turns have equal ones.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    named = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = table.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), named.alias("name"), F.length(text).cast("long").alias("size")).where("conv_id is not null")
    words = S.materialize(turns.select("name").distinct())
    words = S.materialize(words.select(F.col("name"), F.monotonically_increasing_id().alias("id")))
    has = F.col("turn").isNotNull()
    one = F.struct(has.alias("has"), F.when(has, F.col("turn")).alias("turn"), "name", "id", "size")
    g = turns.join(words, "name").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return g.select("conv_id", F.col("all.id").alias("ids"), F.col("all.size").alias("sizes"))


def graft_heads(sequences: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Sequences with their first h turns replaced by those of conversation ``c - c % every``, if it is there.

    h is crc32 of the decimal id, modulo ``most + 1``.
    """
    h, c = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int"), F.col("conv_id")
    heads = sequences.where(c % every == 0).select(c.alias("_base"), F.slice("ids", 1, most).alias("_ids"), F.slice("sizes", 1, most).alias("_sizes"))
    t = sequences.withColumn("_h", h).withColumn("_base_of", c - c % every).join(heads, F.col("_base_of") == F.col("_base"), "left")

    def joined(name: str) -> Column:
        head = F.slice(F.coalesce(f"_{name}", F.array().cast("array<long>")), F.lit(1), F.col("_h"))
        return F.concat(head, F.slice(name, F.col("_h") + 1, F.size(name))).alias(name)

    return t.select("conv_id", joined("ids"), joined("sizes"))


def path_digests(ids: list[int]) -> list[bytes]:
    """A name for every prefix of ``ids``, the empty one first."""
    h, out = hashlib.sha256(), []
    out.append(h.digest()[:16])
    for i in ids:
        h.update(i.to_bytes(8, "little", signed=True))
        out.append(h.copy().digest()[:16])
    return out


class TernaryTree:
    """A ternary search tree of number sequences; node 0 is the root, without a turn."""

    def __init__(self) -> None:
        self.turn, self.lower, self.higher, self.child = [-1], [-1], [-1], [-1]
        self.up, self.depth, self.size = [-1], [0], [0]
        self.ends: dict[int, tuple[int, int, str]] = {}

    def _new(self, turn: int, size: int, up: int) -> int:
        for column, value in ((self.turn, turn), (self.lower, -1), (self.higher, -1), (self.child, -1), (self.up, up), (self.depth, self.depth[up] + 1), (self.size, size)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, ids: list[int], sizes: list[int], members: tuple[int, int, str]) -> None:
        node = 0
        for turn, size in zip(ids, sizes, strict=True):
            at, side, holder = self.child[node], self.child, node
            while at >= 0 and self.turn[at] != turn:
                side, holder = (self.lower if turn < self.turn[at] else self.higher), at
                at = side[at]
            if at < 0:
                at = self._new(turn, size, node)
                side[holder] = at
            node = at
        self.ends[node] = members

    def walk(self) -> list[int]:
        """All nodes, every node after its parent."""
        order, stack = [0], [self.child[0]]
        while stack:
            at = stack.pop()
            if at >= 0:
                order.append(at)
                stack += (self.lower[at], self.higher[at], self.child[at])
        return order

    def path(self, ids: list[int]) -> list[int]:
        found = [0]
        for turn in ids:
            at = self.child[found[-1]]
            while self.turn[at] != turn:
                at = self.lower[at] if turn < self.turn[at] else self.higher[at]
            found.append(at)
        return found


def median_order(n: int) -> Iterator[int]:
    """0 .. n-1, the middle of every stretch before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += ((m + 1, b), (a, m))


def shard_rows(rows: list[tuple[list[int], list[int], tuple[int, int, str]]]) -> list[tuple]:
    """Node rows of one shard, as ``NODE`` with kind first: 0 done but for a boundary parent, 1 boundary."""
    tree = TernaryTree()
    for k in median_order(len(rows)):
        tree.insert(*rows[k])
    total = len(tree.turn)
    n, least, children, leaves, weight, once = [0] * total, [None] * total, [0] * total, [0] * total, [0] * total, [0] * total
    order = tree.walk()
    for at in reversed(order):
        count, first, _ = tree.ends.get(at, (0, None, None))
        n[at] += count
        if first is not None and (least[at] is None or first < least[at]):
            least[at] = first
        if tree.child[at] < 0:
            leaves[at] = 1
        weight[at] += n[at] * tree.size[at]
        once[at] += tree.size[at]
        up = tree.up[at]
        if up >= 0:
            n[up] += n[at]
            children[up] += 1
            leaves[up] += leaves[at]
            weight[up] += weight[at]
            once[up] += once[at]
            if least[up] is None or least[at] < least[up]:
                least[up] = least[at]
    names: dict[int, bytes] = {}
    for ids in (rows[0][0], rows[-1][0]):
        names |= dict(zip(tree.path(ids), path_digests(ids), strict=True))
    out = []
    for at in order:
        up, digest = tree.up[at], tree.ends.get(at, (0, None, None))[2]
        parent = None if up < 0 or up in names else least[up]
        out.append((int(at in names), names.get(at), names.get(up), tree.depth[at], least[at], parent, n[at], children[at], leaves[at], weight[at], once[at], digest))
    return out


def facing_rows(last: list[int], ids: list[int], sizes: list[int]) -> list[tuple]:
    """What to take off the nodes of the path that a shard's last row shares with the next one's first (``ids``)."""
    d = 0
    while d < min(len(last), len(ids)) and last[d] == ids[d]:
        d += 1
    names, goes_on, twice, out = path_digests(ids[:d]), d == len(last), 0, []
    for k in range(d, -1, -1):
        twice += sizes[k - 1] if k else 0
        out.append((1, names[k], None, None, None, None, 0, -int(k < d), -int(goes_on), 0, -twice, None))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    rows = [r + (None,) * (len(schema) - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (ids, sizes, first, n, members) of neighbouring rows with equal ids."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(["ids", "sizes", "first", "n", "members"], kinds, strict=True)))
    held, members = None, []
    for batch in batches:
        out = []
        for ids, sizes, conv in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "conv_id")), strict=True):
            if members and (ids != held[0] or len(members) == CHUNK):
                out.append((*held, members[0], len(members), ",".join(map(str, members))))
                members = []
            held = (ids, sizes)
            members.append(conv)
        if out:
            yield _batch(out, schema)
    if members:
        yield _batch([(*held, members[0], len(members), ",".join(map(str, members)))], schema)


def _shards(limit: int):
    """Maps sorted chunks to node rows, boundary rows and the task's own first and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*[f.split(" ") for f in ROWS.split(", ")], strict=True)
        of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(n, of[t]) for n, t in zip(names, types, strict=True)])
        shard: list[tuple] = []
        turns, first, last, now = 0, None, None, None

        def closed() -> pa.RecordBatch:
            out = facing_rows(last, shard[0][0], shard[0][1]) if last is not None else []
            return _batch(out + shard_rows(shard), schema)

        def end(now) -> tuple:
            return now[0], now[1], (now[2], now[3], now[4].hexdigest())

        for batch in batches:
            for ids, sizes, least, n, members in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "first", "n", "members")), strict=True):
                if now is not None and ids == now[0]:
                    now[2] += n
                    now[4].update(b"," + members.encode())
                    continue
                if now is not None:
                    shard.append(end(now))
                    turns += len(now[0]) + 1
                    if turns >= limit:
                        yield closed()
                        shard, turns, last = [], 0, now[0]
                first = first or (ids, sizes)
                now = [ids, sizes, n, least, hashlib.sha256(members.encode())]
        if now is not None:
            shard.append(end(now))
            yield closed()
            ends = (2, *[None] * 11, TaskContext.get().partitionId(), *first, now[0])
            yield _batch([ends], schema)

    return run


def _facing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("once", pa.int64())])
    for batch in batches:
        for last, ids, sizes in zip(*(batch.column(c).to_pylist() for c in ("before", "ids", "sizes")), strict=True):
            yield _batch([(r[1], r[7], r[8], r[10]) for r in facing_rows(last, ids, sizes)], schema)


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """A row for every node of the trie of ``sequences`` (conv_id, ids, sizes).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the
    smallest member and the parent's, the members, children and childless nodes below, what is saved by
    keeping each text below once, and the SHA-256 of the members that end here, ascending, joined by
    commas. A conversation without turns is a member of the root. Every conv_id comes once. No
    sequences, no nodes. A conversation's numbers, 16 bytes a turn, are one row.
    """
    packed = sequences.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id").select("ids", "sizes", "conv_id")
    packed = packed.mapInArrow(_pack, "ids array<long>, sizes array<long>, first long, n long, members string")
    ranged = packed.repartitionByRange("ids").sortWithinPartitions("ids", "first")
    made = S.materialize(ranged.mapInArrow(_shards(shard_turns), ROWS))
    ends = made.where("kind = 2").withColumn("before", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part")))  # a row a range
    facing = ends.where("before is not null").select("before", "ids", "sizes").mapInArrow(_facing, "key binary, n_children long, n_leaves long, once long")
    boundary = made.where("kind = 1").unionByName(facing, allowMissingColumns=True).groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "once")], F.max("ends_sha256").alias("ends_sha256"),
    )
    boundary = S.materialize(boundary)
    known = boundary.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    done = made.where("kind = 0")
    open_rows = done.where("parent is not null").drop("parent_conv_id").unionByName(boundary.where("parent is not null"), allowMissingColumns=True)
    asked = open_rows.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")).join(known, ["parent", "salt"])
    root = boundary.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "weight", "once", "ends_sha256"]
    rows = done.where("parent is null").select(*columns).unionByName(asked.select(*columns)).unionByName(root.select(*columns))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(*columns[:6], (F.col("weight") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(table: DataFrame, **columns: str) -> DataFrame:
    """``trie_nodes`` of a table of turns; see ``turn_sequences`` for its columns and cases."""
    return trie_nodes(turn_sequences(table, **columns))
