"""The pipeline's near_dedup stage against brute-force Jaccard similarity."""

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from overlapkit.llm import shingle_dedup, simhash

SF = "/root/testdata/sf0.01"


def brute_kept(rows, k=5):
    """Ids that stay: the smallest of each component of pairs with a similarity of 0.8 or more."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {find(i) for i in sets}


@pytest.mark.parametrize(("rounds", "meet"), [(shingle_dedup.ROUNDS, shingle_dedup.MEET), (0, 2)])
def test_near_dedup_keeps_what_brute_force_keeps(spark, monkeypatch, rounds, meet):
    """Also where nothing is contracted before groups meet, and every key that they share is several parts."""
    monkeypatch.setattr(shingle_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(shingle_dedup, "MEET", meet)
    rng = np.random.default_rng(5)
    rows = []
    for base in range(30):  # copies of 40 to 330 words with 1 to 6 changed words: similarities on both sides of 0.8
        words = [f"w{x}" for x in rng.integers(0, 5_000, 40 + 10 * base)]
        rows.append(" ".join(words))
        for changed in range(1, 7):
            copy = list(words)
            for at in rng.choice(len(copy), changed, replace=False):
                copy[at] = f"new{rng.integers(0, 10**9)}"
            rows.append(" ".join(copy))
    line = " ".join(f"common{x}" for x in range(30))
    rows += [f"{line} tail{k} end{k // 2}" for k in range(40)] + [f"{line} a{k} b{k} c{k} d{k} e{k} f{k} g{k}" for k in range(40)]
    rows += [None, "", " \n", "one", "ONE", "one two three four", "one two three four five", *["x y z"] * 5]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.keep_distinct(spark, docs, SF)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows)


def test_near_dedup_keeps_null_ids_last_and_given_tables_whole(spark):
    text = "same text of some words here"
    docs = spark.createDataFrame([(None, text), (6, text), (6, text), (None, "another text with some words")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, SF).collect()))) == ["6", "None"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % 3 == 0)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, SF).collect()} == brute_kept(rows)


def test_golay_keys_give_candidates_within_four_bits(spark, monkeypatch):
    """Fingerprints within 4 bits of the smallest one meet it, none farther off; the stage asks for them."""
    base, rng = 0x0123456789ABCDEF, np.random.default_rng(3)
    fps = [base] + [base + (1 << 62) ^ sum(1 << int(b) for b in rng.choice(60, k % 7, replace=False)) for k in range(70)]
    rows = [(k, x) for k, x in enumerate(fps)] + [(1000, base)]
    pairs = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()}
    by = dict(rows)
    least = min(fps[1:])
    first = min(k for k in by if by[k] == least)
    assert (0, 1000) in pairs and all((by[a] ^ by[b]).bit_count() <= 4 for a, b in pairs)
    meets = {a + b - first for a, b in pairs if first in (a, b)} | {k for k in by if by[k] == least}
    assert all(k in meets or any((k in p) for p in pairs) for k, x in by.items() if 0 < (x ^ least).bit_count() <= 4)
    asked, plain = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda *a: asked.append(a) or plain(*a))
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " one more"), (3, "another text")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, SF).collect()} == {1, 3} and asked


def test_small_tables_are_few_files(spark, monkeypatch):
    """Tables of a few numbers a row are not written as a file from each of many shuffle partitions."""
    import glob

    from overlapkit.llm import _shared as S

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    written, write = [], S.materialize

    def counted(df, *a, **b):
        out = write(df, *a, **b)
        written.append(len(glob.glob(f"{out._overlapkit_path.removeprefix('file:')}/part-*")))
        return out

    monkeypatch.setattr(S, "materialize", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(4000).selectExpr("id as a", "id - id % 4 as b")
        found = {r.node: r.component for r in S.connected_components(edges).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {i: i - i % 4 for i in range(4000)}
    assert written and max(written) <= 8


def test_tables_of_keys_are_not_broadcast(spark, monkeypatch):
    """However small Spark takes them for: looked-up keys are some 88 a fingerprint, and files of prefixes are far smaller than their rows."""
    from overlapkit.llm import _shared as S

    nodes = spark.createDataFrame([(k, k * 0x9E3779B97F4A7) for k in range(300)], "node long, fp long")
    explained = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], S.materialize

    def noted(df, *a, **b):
        plans.append(explained(df))
        return write(df, *a, **b)

    plans.append(explained(simhash.near_pairs(nodes)))
    monkeypatch.setattr(S, "materialize", noted)
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(k, text + f" tail{k}" + " more" * (k // 2)) for k in range(6)], "doc_id long, text string")
    plans.append(explained(corpus_pipeline.keep_distinct(spark, docs, SF)))
    assert "ShuffledHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[-1]
    for plan in plans:
        assert not re.search(r"BroadcastHashJoin \[(key|fp)#", plan), plan
        assert not ("f7#" in plan and "BroadcastHashJoin" in plan), plan
