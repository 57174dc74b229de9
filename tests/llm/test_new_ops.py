"""Nearest neighbours, prefix trie and periodic runs: brute force, bounds, shards of any size, edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S
from overlapkit.llm import nearest, periodic_runs, prefix_trie, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, score string, rank int, dim int"


# --- nearest neighbours by blocks


def by_hand(queries, rows, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in fine:
        if queries(q):
            d = [(float(nearest.distances(np.array([a]), np.array([b]))[0]), i) for i, b in fine if i != q and len(b) == len(a)]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(d)[:k])]
    return out


@pytest.mark.parametrize("rows, k", [(7, 3), (64, 10), (1000, 10)])
def test_nearest_equals_brute_force(spark, rows, k):
    rng = np.random.default_rng(rows)
    x = np.concatenate([rng.normal(size=(120, 5)), rng.integers(-1, 2, (60, 5)).astype(float), rng.normal(size=(10, 5)) * 1e-3 + 1e4])
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in table], VECTORS)
    got = nearest.nearest(df.where("vec_id % 7 = 0"), df, k, query_rows=5, candidate_rows=rows)
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(lambda i: i % 7 == 0, table, k))


def test_nearest_takes_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [
        (0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, []), (400, [0.0, 0.0]), (500, [nan, 1.0]), (600, [inf, 1.0]), (700, [None, 1.0]),
        (800, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (900, [1e300, -1e300]),
    ]
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in table], VECTORS)
    got = nearest.nearest(df.where("vec_id % 100 = 0"), df, 3)
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(lambda i: i % 100 == 0, table, 3))
    assert nearest.nearest(df.limit(0), df).count() == 0 == nearest.nearest(df, df.limit(0)).count()


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(5)
    for scale in (1e-9, 1.0, 1e12):
        a, b = rng.normal(size=(50, 64)) * scale, rng.normal(size=(80, 64)) * scale + rng.normal() * scale
        low, high = nearest.bounds(*nearest.quantise(a), *nearest.quantise(b))
        true = np.linalg.norm(a[:, None] - b[None], axis=2)
        assert (low <= true).all() and (true <= high).all() and ((high - low) < 0.2 * true.max()).all()
    wide = rng.integers(-127, 128, (3, 2500)).astype(np.int8)
    assert (nearest.code_products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


# --- prefix trie


def trie_by_hand(rows, graft=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, name, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        made[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("shard", [1, 7, 50_000])
def test_trie_equals_brute_force(spark, shard):
    rng = np.random.default_rng(shard)
    rows = []
    for c in range(400):
        for turn in range(int(rng.integers(1, 7))):
            rows.append((c, turn, ["user", "assistant", None][turn % 3], ["yes", "no", "né 🙂", None][int(rng.integers(0, 4)) if c % 3 else 0]))
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    own = prefix_trie.turn_sequences(t)
    for graft in (True, False):
        got = prefix_trie.trie_nodes(prefix_trie.graft_heads(own) if graft else own, shard)
        assert found(got) == trie_by_hand(rows, graft)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.queries()["op13_prefix_trie"](spark, SF)) == trie_by_hand(rows)


def test_trie_takes_odd_turns(spark):
    kind = "conv_id long, turn long, role string, text string, ids string, sizes int, id long, name string, parent string"
    rows = [(0, None, None, None), (0, 1, "a", "x"), (0, 1, "a", "x"), (1, 5, "a", "x" * 100_000), (1, None, "", ""), (None, 1, "a", "x"), (205, 0, "a", "lone"), (-7, 2, "a", "b"), (-7, 2, "b", "a")]
    t = spark.createDataFrame([(*r, "i", 1, 2, "n", "p") for r in rows], kind)
    assert found(prefix_trie.trie_nodes(prefix_trie.turn_sequences(t))) == trie_by_hand(rows, graft=False)
    deep = [(1, k, "r", str(k % 3)) for k in range(3_000)] + [(2, k, "r", str(k % 3)) for k in range(2_999)]
    t = spark.createDataFrame(deep, "conv_id long, turn long, role string, text string")
    got = prefix_trie.conversation_trie(t)
    assert got.count() == 3_001 and got.agg(F.max("depth"), F.sum("n_convs")).first() == (3_000, 6_001)
    assert prefix_trie.conversation_trie(t.limit(0)).count() == 0


# --- periodic runs


def runs_by_hand(words, least=6, exponent=4):
    """Every stretch of every period, from left to right; a period is the smallest if no smaller one fits."""
    found, n = [], len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                part = words[i : i + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {k for a, n, p in runs for k in range(a + p, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = ["a " * 200, "ab " * 5, "ab " * 6, "a b " * 3, "a b " * 4 + "a", "x " + "a b c " * 5 + "a b d", "", None, " \t\r\n\x0b\x0c ", "eins"]
    for _ in range(300):
        size = int(rng.integers(1, 4))
        words = [chr(97 + int(k)) for k in rng.integers(0, size, int(rng.integers(1, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            a, p, times = int(rng.integers(0, len(words))), int(rng.integers(1, 9)), int(rng.integers(3, 9))
            words[a : a + p] = words[a : a + p] * times
        texts.append(" ".join(words))
    t = spark.createDataFrame([(k, x, "r", "c", 1) for k, x in enumerate(texts)], "doc_id long, text string, Runs2 string, start string, owner int")
    for least, exponent in ((6, 4), (4, 3), (9, 3), (12, 5)):
        for r in periodic_runs.periodic_runs(t, words=least, exponent=exponent).collect():
            words = words_of(texts[r.doc_id])
            want = runs_by_hand(words, least, exponent)
            assert [tuple(x) for x in r.runs] == want, (texts[r.doc_id], least, exponent)
            assert r.collapsed == collapsed_by_hand(words, want)


def test_runs_of_the_table(spark):
    got = {r.doc_id: r for r in queries.queries()["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words, h = words_of(d.text), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_hand(words) if n < 3_000 or h % 10 == 0 else None
        r = got[d.doc_id]
        if runs is None:
            continue
        planted += bool(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top), d.doc_id
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{p}\n" for a, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
    assert planted > 5


def test_runs_of_very_long_texts(spark):
    long = [("a " * 300_000, [(0, 300_000, 1)]), ("a b " * 150_000, [(0, 300_000, 2)]), (" ".join(map(str, range(50_000))) + " " + "k " * 9, [(50_000, 9, 1)])]
    long.append((" ".join(map(str, range(20_000))) + " " + (" ".join(f"w{k}" for k in range(7_000)) + " ") * 4, [(20_000, 28_000, 7_000)]))
    t = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(long)], "doc_id long, text string")
    for r in periodic_runs.periodic_runs(t).collect():
        assert [tuple(x) for x in r.runs] == long[r.doc_id][1]
    assert periodic_runs.periodic_runs(t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(t.withColumnRenamed("doc_id", "Runs"))


def test_cells_without_labelled_rows_shuffle_no_texts(spark):
    """Rows that do not count are told by id after their features are made; sums are those of the others."""
    rows = spark.range(500).select("id", F.concat(F.lit("t"), F.repeat(F.lit("x"), (F.col("id") % 17).cast("int"))).alias("text"))
    some = spark.range(0, 500, 3)
    features = lambda b: np.array([[len(t), len(t) % 5] for t in b.column("text").to_pylist()], dtype=float)
    centres, scale = np.array([[3.0, 0.0], [12.0, 4.0]]), np.ones(2)
    n, mean = S.cell_sums(rows, features, ["text"], centres, scale, without=some)
    want_n, want = S.cell_sums(rows.join(some, "id", "left_anti"), features, ["text"], centres, scale)
    assert n.sum() == 333 and (n == want_n).all() and (mean == want).all()
