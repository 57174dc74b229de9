"""Hand-made cases of the operators: overlaps, windows, vocabularies, cleaning, gates, sessions, inventories."""

import hashlib
import os
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from overlapkit import sources, streaming
from overlapkit.functions import normalize_samples, normalize_spaces, word_core, word_initial
from overlapkit.operators import inventory, seams, series, sessions, text, tokens, windows
from overlapkit.plans import fixtures
from overlapkit.plans import streaming as streaming_plans


def window_rows(*streams):
    """(series, window, ord, piece, initial, pos) of windows given as lists of (piece, pos)."""
    return [("s", w, k, p, p.startswith(" "), pos) for w, stream in enumerate(streams) for k, (p, pos) in enumerate(stream)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "series_id string, window_no long, ord long, piece string, initial boolean, pos long")


def words(text, at=0):
    return [(" " + w, at + k) for k, w in enumerate(text.split())]


def merged(spark, *streams, search=None, tolerance=None):
    out = seams.merge_windows(frame(spark, window_rows(*streams)), "series_id", search, tolerance)
    return "".join(r.piece for r in sorted(out.collect(), key=lambda r: (r.window_no, r.ord))).strip()


def test_merge_overlap_and_fallback(spark):
    assert merged(spark, words("a b c d"), words("c d e f", 2), search=5, tolerance=1) == "a b c d e f"
    assert merged(spark, words("a b c Not,"), [(" c", 2), (" not.", 3), (" so", 4)], search=5, tolerance=1) == "a b c not. so"
    # one common word is no run: what lies at or before the boundary is dropped
    assert merged(spark, words("a b c"), [(" c", 2), (" x", 3)], search=5, tolerance=1) == "a b c x"
    assert merged(spark, words("a b"), words("x y", 10), search=5, tolerance=1) == "a b x y"
    # pieces of words: the run is found on whole words
    assert merged(spark, [(" a", 0), ("sk", 1), (" not", 2)], [(" as", 0), ("k", 1), (" not", 2), (" what", 3)], search=9, tolerance=2) == "ask not what"


def core(word):
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def fold(window_list, search, tolerance, steps=None):
    """{window: (append_from, cut)} by taking windows one after another; a window is a list of (piece, initial, pos).

    ``steps`` collects how many tokens were committed before a window, stayed, and were so after it.
    """
    committed, taken = [], {}

    def words(toks):
        out = []
        for k, (piece, initial, pos) in enumerate(toks):
            if not out or initial:
                out.append([k, pos, ""])
            out[-1][2] += piece or ""
        return [(k, p, core(w)) for k, p, w in out]

    for number, fresh in window_list:
        start, before = 0, len(committed)
        if committed:
            boundary = committed[-1][1][2]
            lo = max((k + 1 for k, t in enumerate(committed) if t[1][2] + search < boundary), default=0)
            limit = max(boundary, fresh[0][2]) + search
            end = next((k for k, t in enumerate(fresh) if t[2] > limit), len(fresh))
            a, b = words([t for _, t in committed[lo:]]), words(fresh[:end])
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][2] and a[i + n][2] == b[j + n][2] and abs(a[i + n][1] - b[j + n][1]) <= tolerance:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] >= 2:
                committed = committed[: lo + a[-best[1]][0]]
                start = b[-best[2]][0]
            else:
                start = next((k for k, t in enumerate(fresh) if t[2] > boundary), len(fresh))
        taken[number] = start
        kept = len(committed)
        committed += [(number, t) for t in fresh[start:]]
        if steps is not None:
            steps.append((before, kept, len(committed)))
    return {w: (s, s + sum(n == w for n, _ in committed)) for w, s in taken.items()}


def random_streams(seed, jumps):
    rng, rows, keys = random.Random(seed), [], {}
    for k in range(60):
        n = rng.randint(3, 40)
        base = [rng.choice("abcd") for _ in range(n)]
        size, step = rng.randint(4, 9), rng.randint(2, 5)
        keys[f"k{k}"] = []
        for w, at in enumerate(range(0, max(1, n - 2), step)):
            noisy = [x if rng.random() > 0.2 else "z" for x in base[at : at + size]]
            toks = [(" " + x, rng.random() > 0.1, at + o + (rng.randint(-2, 2) if jumps else 0)) for o, x in enumerate(noisy)]
            keys[f"k{k}"].append((w, toks))
            rows += [(f"k{k}", w, o, *t) for o, t in enumerate(toks)]
    return rows, keys


@pytest.mark.parametrize("jumps", [False, True])
def test_spans_equal_the_fold(spark, jumps):
    rows, keys = random_streams(4, jumps)
    t = frame(spark, rows)
    for search, tolerance in ((4, 0), (6, 3), (None, None)):
        found = seams.window_spans(t, "series_id", search, tolerance).drop("toks").collect()
        reach, near = (2**61 if search is None else search), (2**61 if tolerance is None else tolerance)
        want = {(k, w): span for k, ws in keys.items() for w, span in fold(ws, reach, near).items()}
        assert {(r.series_id, r.window_no): (r.append_from, max(r.append_from, r.cut)) for r in found} == want
        assert any(r.exact for r in found)


def long_stream(seed, n_windows, broken, tolerance=0):
    """Windows of 40 words, 12 shared; those in ``broken`` lost all but a few words, and some words are noise."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(28 * n_windows + 12)]
    out = []
    for w in range(n_windows):
        at, size = 28 * w, rng.randint(1, 9) if w in broken else 40
        noisy = [x if rng.random() > 0.05 else "z" for x in base[at : at + size]]
        shift = rng.randint(-tolerance, tolerance)
        out.append((w, [(" " + x, True, at + o + shift) for o, x in enumerate(noisy)]))
    return out


@pytest.mark.parametrize("tolerance", [0, 3])
def test_only_islands_are_folded(spark, tolerance):
    keys = {f"k{k}": long_stream(k, 60, {20 * (k % 3), 30, 31, 50 + k % 5}, tolerance) for k in range(8)} | {None: long_stream(99, 30, {7})}
    t = frame(spark, [(k, w, o, *x) for k, ws in keys.items() for w, toks in ws for o, x in enumerate(toks)])
    found = seams.window_spans(t, "series_id", 12, tolerance).drop("toks").collect()
    want = {(k, w): span for k, ws in keys.items() for w, span in fold(ws, 12, tolerance).items()}
    assert {(r.series_id, r.window_no): (r.append_from, max(r.append_from, r.cut)) for r in found} == want
    whole = {r.series_id for r in found if r.exact and r.window_no == 10}
    folded = sum(r.exact for r in found if r.series_id not in whole)
    assert 0 < folded <= 12 * len(keys) and len(whole - {None}) <= (0 if tolerance == 0 else 6)
    for k, ws in keys.items():  # offsets run over stretches
        own, steps = sorted((r for r in found if r.series_id == k), key=lambda r: r.window_no), []
        fold(ws, 12, tolerance, steps)
        assert [r.start for r in own] == [kept for _, kept, _ in steps]


def test_confirmed_split_follows_the_fold(spark):
    rows, keys = random_streams(9, False)
    got = {(r.series_id, r.step): r for r in seams.confirmed_split(frame(spark, rows), "series_id", 6, 3).collect()}
    for k, ws in keys.items():
        steps = []
        spans = fold(ws, 6, 3, steps)
        for n, (before, kept, after) in enumerate(steps):
            r, own = got[k, n], [p for p, _, _ in ws[n][1][spans[n][0] :]]
            assert (r.confirmed_before, r.kept, r.unconfirmed, r.confirmed_after) == (before, kept, " ".join(own), after)


def test_seams_read_their_input_once(spark):
    rows, _ = random_streams(1, False)
    t = frame(spark, rows)
    df = seams.merged_text(seams.window_spans(t, "series_id", 6, 3), "series_id")
    assert df.count()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython") == 1 and plan.count("ExistingRDD") == 1


def test_seams_across_batches(spark):
    """A batch's first window meets the last one of the batch before; a filter on the result drops no window before that."""
    rows, keys = random_streams(7, True)
    t = frame(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = seams.window_spans(t, "series_id", 6, 3).drop("toks").collect()
        pairs = {(r.series_id, r.seam): r for r in seams.splice_pairs(t, "series_id", 6, 3).collect()}
        some = seams.splice_pairs(t, "series_id", 6, 3).where("seam % 2 = 1").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(k, w): span for k, ws in keys.items() for w, span in fold(ws, 6, 3).items()}
    assert {(r.series_id, r.window_no): (r.append_from, max(r.append_from, r.cut)) for r in found} == want
    assert some and all(r == pairs[r.series_id, r.seam] for r in some)


def test_seams_are_found_in_arrays(spark):
    """No word of a window is spelt by expressions of the plan, a token at a time."""
    t = spark.createDataFrame([("s", 0, [("a", True, 0), ("b", True, 1)]), ("s", 1, [("b", True, 1), ("c", True, 2)])], "series_id string, window_no long, toks array<struct<piece: string, initial: boolean, pos: long>>")
    df = seams.splice_pairs(t, "series_id", 5, 1)
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.keep_len, r.append_from, r.run, r.left_n) for r in df.orderBy("seam").collect()] == [(None, 0, None, None), (2, 1, 1, 2)]


def test_cores_are_those_of_spark(spark):
    rng = random.Random(3)
    letters = "aZ9.,-_ \tßÄéİıΣσς\u0301\u0345Ⓐ²½Ⅷ٣ñ“”–…中\U0001d400\U0001f600ǅŉ\u200d"
    words = ["", "..", "É\u0301,"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(3_000)]
    want = [r.core for r in spark.createDataFrame(list(enumerate(words)), "k int, w string").orderBy("k").select(word_core(F.col("w")).alias("core")).collect()]
    assert seams._cores(pa.array(words), seams._letters_of(spark)).to_pylist() == want


def plan(spark, n, **k):
    return [(r.start, r.len) for r in windows.plan_windows(spark.createDataFrame([("s", n)], "k string, n long"), "k", "n", **k).orderBy("window_no").collect()]


def test_plan_windows(spark):
    assert plan(spark, 0) == [(0, 0)] and plan(spark, 100_000) == [(0, 100_000)] and plan(spark, 240_000) == [(0, 240_000)]
    assert plan(spark, 3 * 208_000 + 240_000) == [(k * 208_000, 240_000) for k in range(4)]
    assert plan(spark, 240_000 + 50 * 1280) == [(0, 240_000), (50 * 1280, 240_000)]
    start, length = plan(spark, 290_000)[-1]
    assert start % 1280 == 0 and length == 240_000 and start + length <= 290_000
    start, length = plan(spark, 290_000, cover_tail=True)[-1]
    assert start + length == 290_000
    with pytest.raises(ValueError):
        plan(spark, 5, size=3, overlap=3)


def test_assign_paths_agree(spark):
    w = windows.plan_windows(spark.createDataFrame([("a", 53), ("b", 3)], "k string, n long"), "k", "n", 10, 3, 1)
    e = spark.createDataFrame([(k, i) for k, n in (("a", 53), ("b", 3)) for i in range(n)], "k string, idx long")
    both = [sorted(map(tuple, windows.assign_windows(e, w, "k", **o).select("k", "idx", "window_no").collect())) for o in ({}, {"stride": 7, "size": 10})]
    assert both[0] == both[1]


def test_irregular_windows(spark):
    rng = random.Random(3)
    w = [(rng.choice("ab"), k, rng.randint(-20, 400), rng.choice([0, 1, 2, 7, 8, 9, 64, 300, None])) for k in range(120)] + [(None, 900, 0, 10)]
    e = [(rng.choice("ab"), rng.randint(-30, 500)) for _ in range(400)] + [("a", None), (None, 5)]
    dw, de = spark.createDataFrame(w, "k string, window_no long, start long, len long"), spark.createDataFrame(e, "k string, idx long")
    got = sorted(map(tuple, windows.assign_windows(de, dw, "k").select("k", "idx", "window_no", "start", "len").collect()))
    assert got == sorted((k, i, no, at, n) for k, i in e for key, no, at, n in w if k and k == key and i is not None and n and at <= i < at + n)
    assert windows.assign_windows(de, dw.limit(0), "k").count() == 0 == windows.assign_windows(de.limit(0), dw, "k").count()


def test_many_windows_on_one_key(spark):
    """10^5 windows and 3 * 10^5 elements of one key: only what begins or ends near an element meets it."""
    w = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("window_no"), (F.col("id") * 3).alias("start"), (1 + F.pmod(F.xxhash64("id"), F.lit(4))).alias("len"))
    e = spark.range(300_000).select(F.lit("a").alias("k"), F.col("id").alias("idx"))
    assert windows.assign_windows(e, w, "k").count() == w.agg(F.sum(F.least(F.col("len"), 300_000 - F.col("start")))).first()[0]


def test_elements_are_dealt_to_windows_once(spark):
    """No element is copied for the windows that may hold it: windows are, and by as many bins as they reach into."""
    w = windows.plan_windows(spark.range(1, 40).select(F.col("id").alias("k"), (F.col("id") * 9).alias("n")), "k", "n", 40, 12, 1)
    e = spark.range(1, 40).select(F.col("id").alias("k"), F.explode(F.expr("sequence(0L, id * 9 - 1)")).alias("idx")).localCheckpoint()
    want = w.select(F.sum("len")).first()[0]
    for options in ({}, {"stride": 28, "size": 40}):
        joined = windows.assign_windows(e, w, "k", **options)
        assert joined.count() == want
        assert joined._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # the plan's and the bins'
    wide = spark.createDataFrame([(3, k, a, n) for k, (a, n) in enumerate([(-5, 3_000_000_000), (2, 1), (0, 129), (20, 2_500), (26, 1), (27, 5)])], "k long, window_no long, start long, len long")
    got = {r.window_no: r["count"] for r in windows.assign_windows(e, wide, "k").groupBy("window_no").count().collect()}
    assert got == {0: 27, 1: 1, 2: 27, 3: 7, 4: 1}


def test_equal_tables_join_no_rows(spark):
    a = spark.range(5_000).select("id", (F.col("id") % 97).cast("double").alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") / 3).alias("u"))
    assert [tuple(r) for r in seams.diff_summary(seams.table_diff(a, a.orderBy(F.desc("id")), ["id"], ["v"])).collect()] == [("match", 5_000, 0.0, 0.0)]
    b = a.where("id != 17").withColumn("u", F.when(F.col("id") == 18, None).otherwise(F.col("u"))).withColumn("v", F.when(F.col("id") == 19, F.col("v") + 0.25).otherwise(F.col("v")))
    b = b.unionByName(spark.createDataFrame([(9_000, 1.0, None), (None, 2.0, 2.0)], "id long, v double, u double"))
    for buckets in (1, 64, 1 << 16):
        got = {r.id: r.status for r in seams.table_diff(a, b, ["id"], ["v", "u"], 0.1, buckets).collect()}
        assert len(got) == 5_002 and {k: s for k, s in got.items() if s != "match"} == {17: "missing_right", 18: "differs", 19: "differs", 9_000: "missing_left", None: "missing_left"}


def test_score_windows_keeps_going(spark):
    def score(row):
        return [(1 // row["x"], 0)]

    got = windows.score_windows(spark.createDataFrame([("a", 0, 5, 1), ("a", 1, 9, 0)], "k string, window_no long, frame_offset long, x long"), score, "k").collect()
    assert sorted((r.window_no, r.pos, r.error is None) for r in got) == [(0, 5, True), (1, None, False)]


def test_windows_scored_in_batches(spark):
    """A batch that fails falls back on its windows; only the one at fault has an error."""
    import pyarrow.compute as pc

    def score(batch):
        return [[(str(v), k)] for k, v in enumerate(pc.divide(12, batch.column("x")).to_pylist())]

    t = spark.createDataFrame([("a", k, 100 * k, x) for k, x in enumerate([1, 2, 0, 4])], "k string, window_no long, frame_offset long, x long")
    good = windows.score_windows(t.where("x > 0").coalesce(1), score, "k", batched=True).orderBy("window_no").collect()
    assert [(r.token_id, r.pos, r.error) for r in good] == [("12", 0, None), ("6", 101, None), ("3", 302, None)]
    got = windows.score_windows(t.coalesce(1), score, "k", batched=True).orderBy("window_no").collect()
    assert [(r.token_id, r.error is None) for r in got] == [("12", True), ("6", True), (None, False), ("3", True)]
    short = windows.score_windows(t.coalesce(1), lambda batch: [], "k", batched=True).collect()
    assert len(short) == 4 and all("0 results for 1 windows" in r.error for r in short)


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    import hashlib

    (tmp_path / "t" / "m").mkdir(parents=True)
    (tmp_path / "t" / "m" / "small").write_bytes(b"abc")
    with open(tmp_path / "t" / "m" / "sparse", "wb") as f:
        f.truncate(3 << 30)
    zeros, h = bytes(1 << 24), hashlib.sha256()
    for _ in range(3 << 6):
        h.update(zeros)
    got = {r.path: (r.size, r.sha256) for r in sources.scan_artifacts(spark, str(tmp_path / "t"), full=True).collect()}
    assert got == {"m/small": (3, hashlib.sha256(b"abc").hexdigest()), "m/sparse": (3 << 30, h.hexdigest())}


def test_texts_are_files_of_their_own(spark, tmp_path):
    """A row is a file, whatever its value; no file is left to the driver to commit."""
    rows = [(1, "a\nb"), (1, "ö"), (2, ""), (None, "x"), (7, None)]
    sources.write_texts(spark.createDataFrame(rows, "k int, t string").coalesce(1), str(tmp_path / "out"), "k", "t")
    files = [(p.parent.name, p.read_text()) for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert sorted(files) == [("k=1", "a\nb\n"), ("k=1", "ö\n"), ("k=2", "\n"), ("k=7", "\n"), ("k=__HIVE_DEFAULT_PARTITION__", "x\n")]
    found = sources.scan_artifacts(spark, str(tmp_path / "out"), full=True).collect()
    assert sorted((r.size, r.sha256) for r in found) == sorted((len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for _, t in files)


def test_upsert_writes_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda rows: spark.createDataFrame(rows, "id long, v string, ver long, p string")
    assert sources.upsert_partitions(spark, path, table([(1, "a", 1, "x"), (2, "b", 1, "x"), (3, "c", 1, "y"), (4, "d", 1, None)]), ["id"], "p", "ver") == ["p=__HIVE_DEFAULT_PARTITION__", "p=x", "p=y"]
    files = lambda name: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / name).iterdir()}
    y, x = files("p=y"), files("p=x")
    assert sources.upsert_partitions(spark, path, table([(2, "B", 1, "x"), (9, "n", 1, "z")]), ["id"], "p", "ver") == ["p=x", "p=z"]
    assert files("p=y") == y and files("p=x") != x
    rows = lambda: sorted((r.id, r.v, r.p) for r in spark.read.parquet(path).collect())
    want = [(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (4, "d", None), (9, "n", "z")]
    assert rows() == want
    with pytest.raises(ValueError, match="versions differ"):
        sources.upsert_partitions(spark, path, table([(3, "C", 2, "y")]), ["id"], "p", "ver")
    with pytest.raises(ValueError, match="does not verify"):
        sources.upsert_partitions(spark, path, table([(3, "bad", 1, "y")]), ["id"], "p", "ver", check=lambda d: d.where("v = 'bad'"))
    assert rows() == want and {f.name for f in tmp_path.iterdir()} == {"t"}
    assert sources.upsert_partitions(spark, path, table([]), ["id"], "p") == []


def detok(spark, pieces):
    t = spark.createDataFrame([("s", k, p) for k, p in enumerate(pieces)], "k string, ord long, piece string")
    out = tokens.detokenize(t, ["k"]).collect()
    return out[0].text if out else ""


def test_detokenize(spark):
    assert detok(spark, ["▁hello", ",", "▁world"]) == "hello, world"
    assert detok(spark, [" Ask", " not", "<|end|>", None, "<unk>"]) == "Ask not<unk>"
    assert detok(spark, ["▁caf", "<0xC3>", "<0xA9>", "<0xFF>", "▁x"]) == "café� x"
    assert detok(spark, ["<0xZZ>", "▁a"]) == "a"


def test_long_words_and_pieces(spark):
    """A word of 12,000 bytes spelt in byte pieces is one run; a piece of 2 million characters stays whole."""
    rows = [("s", 0, -1, "▁")] + [("s", 0, k, "<0xC3>" if k % 2 == 0 else "<0xA9>") for k in range(12_000)] + [("s", 1, -1, "▁"), ("s", 1, 0, "<0x41>")]
    t = spark.createDataFrame(rows, "k string, idx long, j int, piece string").select("k", F.struct("idx", "j").alias("ord"), "piece")
    got = sorted((r.ord.idx, r.n, r.piece) for r in tokens.byte_fallback_runs(t, ["k"]).where("is_byte").collect())
    assert got == [(0, 12_000, "é" * 6_000), (1, 1, "A")]
    assert detok(spark, ["▁" + "x" * 2_000_000]) == "x" * 2_000_000


def test_phrase_audit(spark):
    texts = ["the red fox  ran off, the red fox RAN off", "a b", "xé", "", None, "fox", "red fox ran", "predated fox rants here now today"]
    phrases = ["the red fox ran off", "red fox ran", "d fox r", "é", "a b", "x", "now today", "ed fox ran", "fox  ran", "ate fox rant", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    p = spark.createDataFrame(list(enumerate(phrases)), "j long, p string")
    want = {(i, j, x.lower().count(y.lower())) for i, x in enumerate(texts) for j, y in enumerate(phrases) if x and y and y.lower() in x.lower()}
    assert {tuple(r) for r in seams.phrase_audit(t, p, "i", "t", "j", "p").collect()} == want


def test_phrase_audit_keeps_rows_apart(spark):
    t = spark.createDataFrame([(1, "b red fox ran a"), (1, "red fox ran red fox ran"), (None, "a red fox ran"), (2, "none")], "i long, t string")
    p = spark.createDataFrame([(7, "red fox ran"), (7, "red fox ran"), (None, "b"), (8, None), (9, "a of the red fox ran by night")], "j long, p string")
    got = sorted(map(repr, (tuple(r) for r in seams.phrase_audit(t, p, "i", "t", "j", "p").collect())))
    assert got == sorted(map(repr, [(1, 7, 1), (1, 7, 1), (1, 7, 2), (1, 7, 2), (None, 7, 1), (None, 7, 1), (1, None, 1)]))
    assert seams.phrase_audit(t, p.limit(0), "i", "t", "j", "p").count() == 0 == seams.phrase_audit(t.limit(0), p, "i", "t", "j", "p").count()


def test_phrases_meet_by_their_rarest_gram(spark):
    """A stock opening that every text has is no key of the phrases that begin with it."""
    t = spark.createDataFrame([(k, f"start of all the same opening words here then text number {k} goes on to its end") for k in range(300)], "i long, t string")
    p = spark.createDataFrame([(k, f"of all the same opening words here then text number {k} goes on to its") for k in range(300)], "j long, p string")
    assert seams.phrase_candidates(t, p, "i", "t", "j", "p").count() == 300
    assert sorted(map(tuple, seams.phrase_audit(t, p, "i", "t", "j", "p").collect())) == [(k, k, 1) for k in range(300)]


def test_words_and_spaces(spark):
    row = spark.range(1).select(word_core(F.lit("«Naïve!»")).alias("a"), word_core(F.lit("--")).alias("b"), word_initial(F.lit("▁x")).alias("c"), word_initial(F.lit("x")).alias("d"),
                                normalize_spaces(F.lit("a  b ,  c 。 \t x ")).alias("e"), normalize_samples(F.lit(-32767), "i16").alias("f")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("naïve", "", True, False, "a b, c。 \t x", -1.0)
    with pytest.raises(ValueError):
        normalize_samples(F.lit(1), "u8")


def test_clean_corpus(spark):
    cases = {("Um, hello world, uh like that", "en"): ", hello world, that", ("um  hello", "und"): "um hello", ("the number 5um is", "en"): "the number 5is",
             ("Xin chào uhm thế giới", "vi"): "Xin chào thế giới", ("là kiểu như vậy. kiểu như thế", "vi"): "là kiểu như vậy.thế", (" kiểu như thế", "vi"): "thế", ("umbrella er", "en"): "umbrella", ("a\n\n\n\nb", "xx"): "a\n\nb"}
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "i long, text string, lang string")
    assert [r.text for r in text.clean_corpus(d, "text", "lang").orderBy("i").collect()] == list(cases.values())
    assert "like" not in text.fillers(conservative=True)["en"]


def test_gate_and_endpoints(spark):
    p = [0.3, 0.36, 0.25, 0.19, 0.3, 0.9, 0.1, 0.1, 0.1, 0.1, 0.5, 0.1]
    f = spark.createDataFrame([("s", k, x) for k, x in enumerate(p)], "k string, n long, p double")
    g = series.trailing_silence(series.hysteresis_gate(f, "k", ["n"], "p"), "k", ["n"])
    rows = g.orderBy("n").collect()
    assert [r.active for r in rows] == [False, True, True, False, False, True, False, False, False, False, True, False]
    assert [r.silence_ms // 32 for r in rows] == [1, 0, 0, 1, 2, 0, 1, 2, 3, 4, 0, 1]
    assert [r.n for r in series.endpoints(g, "k", ["n"], 96).collect()] == [8]
    assert [(r.first_frame, r.last_frame) for r in series.utterances(g, "k", ["n"], 96).orderBy("first_frame").collect()] == [(1, 5), (10, 10)]
    with pytest.raises(ValueError):
        series.hysteresis_gate(f, "k", ["n"], "p", 0.1, 0.2)


def test_downmix_argmax_cadence(spark):
    s = spark.createDataFrame([("s", k, v) for k, v in enumerate([1.0, -1.0, 0.5, 0.5, 0.3])], "k string, i long, v double")
    assert [r.v for r in series.downmix(s, "k", "i", "v", 2).orderBy("i").collect()] == [0.0, 0.5, 0.3]
    a = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "x array<double>")
    assert [series.frame_argmax(a, "x", t).first().argmax for t in ("low", "high")] == [1, 2]
    c = spark.createDataFrame([("s", t, on) for t, on in ((0, False), (1, True), (2, True), (5, False), (11, False), (12, True))], "k string, t long, active boolean")
    assert [r.t for r in series.cadence_thin(c, "k", ["t"], "t", 10).orderBy("t").collect()] == [1, 11]


def test_folds_start_once_a_key(spark):
    """From an empty state too, and for a null key."""
    from overlapkit.functions import fold_rows

    def step(state, row):
        state["n"] = state.get("n", 0) + 1
        return [{"k": row["k"], "n": state["n"]}]

    t = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(5)], "k string, i long")
    got = sorted(map(repr, map(tuple, fold_rows(t, ["k"], ["i"], dict, step, "k string, n long").collect())))
    assert got == sorted(map(repr, [(k, n + 1) for k in ("a", "b", None) for n in range(5)]))


@pytest.mark.parametrize("seed", [1, 42, 12345, 999999, 0xDEADBEEF])
def test_dispatch_never_opens_twice(spark, seed):
    rng = random.Random(seed)
    c = spark.createDataFrame([("s", k, rng.choice(["Start", "Stop", "Toggle"])) for k in range(200)], "k string, n long, command string")
    open_now, state = 0, False
    for r in sessions.dispatch_commands(c, "k", ["n"]).orderBy("n").collect():
        state = {"Start": True, "Stop": False, "Toggle": not state}[r.command]
        open_now += {"SessionStarted": 1, "SessionEnded": -1, "Continue": 0}[r.action]
        assert open_now in (0, 1) and r.recording == state == bool(open_now)


def test_progress_and_phases(spark):
    rows = [("m", "a", 1, 200), ("m", "b", 2, 300), ("m", "a", 3, 400), ("m", None, 4, 999), ("m", "b", 5, 600)]
    p = spark.createDataFrame([(*r, 1000) for r in rows], "k string, f string, n long, v long, total long")
    assert [(r.received, r.percent) for r in inventory.progress_rollup(p, "k", "f", ["n"], "v", "total").orderBy("n").collect()] == [(200, 20), (500, 50), (700, 70), (1000, 100)]
    e = [("start", "a"), ("start", "b"), ("progress", "b"), ("failed", "a"), ("progress", "a"), ("start", "b"), ("done", "b")]
    t = spark.createDataFrame([("m", k, kind, m, "why", True) for k, (kind, m) in enumerate(e)], "k string, n long, kind string, model_id string, message string, load_ok boolean")
    got = [(r.phase, r.active_model) for r in inventory.phase_replay(t, "k", ["n"]).orderBy("n").collect()]
    assert got == [("Downloading", "a")] * 3 + [("NeedsModel", "a")] * 2 + [("Downloading", "b"), ("Ready", "b")]


def test_platform_floor(spark):
    row = spark.range(1).select(*[inventory.supported(F.lit(v), "14.4").alias(f"c{k}") for k, v in enumerate(("14.0", "14.4", "14.10", "15.0", "14", "x", None))]).first()
    assert list(row) == [True, True, False, False, False, False, False]


def transcript(spark, tmp_path, rows, end=1_000, **options):
    """Rows of the streamed transcript; a micro-batch a list of (seconds, type, token)."""
    from overlapkit import streaming as st

    schema = "user_id long, ts timestamp, event_id long, event_type string, recoverable boolean, token string"
    at, n = str(tmp_path / "events"), 0
    for batch in rows:
        made = []
        for t, kind, token in batch:
            made.append((1, 1_000 + t, n, kind, True, token))
            n += 1
        d = spark.createDataFrame(made, schema.replace("timestamp", "long"))
        d.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(at)
    for k in (1, 2):  # silence elsewhere moves the watermark
        d = spark.createDataFrame([(None, 1_000 + k * end, None, None, None, None)], schema.replace("timestamp", "long"))
        d.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(at)
    stream = sources.read_frames(spark, at, d.withColumn("ts", F.timestamp_seconds("ts")).schema, streaming=True, files=1)
    out = st.run_available(st.stream_transcript(stream, delay="20 seconds", **options), "append").collect()
    return [(r.event_id, r.kind, r.committed, r.confirmed, r.unconfirmed) for r in sorted(out, key=lambda r: (r.event_id, r.batch))]


def test_stream_transcript(spark, tmp_path):
    say, hush = "PartialTranscript", "Activity"
    rows = [
        [(0, "SessionStarted", None), (1, say, "a"), (2, say, "b"), (3, hush, None)],  # a partial at once, then none within the interval
        [(20, hush, None), (30, hush, None)],  # the pause shows and promotes once
        [(31, say, "c"), (32, say, "d e f g h")],  # one block fills two windows, and makes no partial of its own
        [(60, say, "i"), (61, "SessionCompleted", None), (62, say, "late")],
    ]
    got = transcript(spark, tmp_path, rows, window=4, overlap=1, interval_us=10_000_000, pause_us=15_000_000)
    assert got == [
        (1, "partial", 0, "", "a"), (4, "partial", 0, "", "a b"), (4, "promote", 2, "a b", ""), (6, "partial", 2, "", "c"),
        (7, "commit", 3, "c", "d e f g h"), (7, "commit", 6, "d e f", "g h"), (8, "partial", 6, "", "g h i"), (9, "final", 9, "g h i", ""),
    ]
    assert " ".join(r[3] for r in got if r[3]) == "a b c d e f g h i"


def test_stream_transcript_in_any_order(spark, tmp_path):
    """Rows that come later, within the delay, give what they give in order; silence ends an open transcript."""
    say = "PartialTranscript"
    numbered = [(0, "SessionStarted", None), (4, say, "a"), (8, say, "b"), (12, say, "c d"), (14, "SessionCompleted", None), (15, "SessionStarted", None), (16, say, "x")]
    orders = {"in": [[0, 1, 2], [3, 4], [5, 6]], "out": [[1, 0], [6, 2], [4, 3, 5]]}
    got = {}
    for name, batches in orders.items():
        made = transcript(spark, tmp_path / name, [[numbered[k] for k in b] for b in batches], end=100_000_000, window=4, overlap=1, interval_us=10_000_000, pause_us=15_000_000)
        got[name] = [r[1:] for r in sorted(made, key=lambda r: (dict(enumerate(k for b in batches for k in b))[r[0]]))]
    assert got["in"] == got["out"]
    assert got["in"][-1] == ("unexpected end", 0, "", "x") and [r[2] for r in got["in"] if r[0] == "final"] == ["d"]


KEYED = "user_id long, ts timestamp, event_id long, event_type string, kind string, file string, bytes long"


def keyed_stream(spark, path, seed, late):
    """Random events of six users in five micro-batches, rows up to ``late`` seconds out of order; the rows as a table, and the stream."""
    rng = random.Random(seed)
    kinds = [("SessionStarted", "start"), ("SessionCompleted", "done"), ("Error", "failed"), ("Activity", "progress"), ("SessionCompleted", "progress")]
    rows = [(rng.randint(1, 6), 1_000 + 10 * k + rng.randint(0, 5), k, *rng.choice(kinds), rng.choice(["a", "b", None]), rng.randint(0, 99)) for k in range(300)]
    batches = [[] for _ in range(5)]
    for r in rows:
        batches[min(4, (r[1] - 1_000 + rng.randint(0, late)) // 600)].append(r)
    for k in (1, 2):
        batches.append([(None, 10_000_000 * k, None, None, None, None, None)])
    table = lambda b: spark.createDataFrame(b, KEYED.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts"))
    for b in batches:
        table(b).coalesce(1).write.mode("append").parquet(path)
    return table(rows), sources.read_frames(spark, path, table(rows).schema, streaming=True, files=1)


@pytest.mark.parametrize("late", [0, 1_500])
def test_keyed_streams_equal_their_batch_twins(spark, tmp_path, late):
    from overlapkit import streaming as st

    order = ["ts", "event_id"]
    table, stream = keyed_stream(spark, str(tmp_path / "e"), late, late)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    stale = sessions.drop_stale_completions(table, "user_id", order).where("event_type = 'SessionCompleted'").select("user_id", "event_id", "stale")
    assert same(st.run_available(st.stream_drop_stale(stream, "1600 seconds"), "append").drop("batch"), stale)
    live = inventory.live_ticks(table, "user_id", order).select("user_id", "event_id", "live")
    assert same(st.run_available(st.stream_terminal_latch(stream, "1600 seconds"), "append").drop("batch"), live)
    sums = inventory.progress_rollup(table, "user_id", "file", order, "bytes", "bytes").select("user_id", "event_id", "received")
    assert same(st.run_available(st.stream_progress(stream, "1600 seconds"), "append").drop("batch"), sums)


def test_silent_keys_leave_no_state(spark, tmp_path):
    from overlapkit import streaming as st

    _, stream = keyed_stream(spark, str(tmp_path / "e"), 3, 0)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.PROVIDER)
    try:
        q = st.stream_terminal_latch(stream, "60 seconds").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("noop").start()
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: __import__("json").loads(p.json), q.recentProgress)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert max(held) >= 12 and held[-1] == 0, held


def test_stream_splice_equals_the_fold(spark, tmp_path):
    from overlapkit import streaming as st

    keys = {k: long_stream(k, 25, {5 + k, 12}) for k in range(4)}
    kind = "series_id long, ts long, window_no long, toks array<struct<piece: string, initial: boolean, pos: long>>"
    rows = [(k, 1_000 + w * 10, w, toks) for k, ws in keys.items() for w, toks in ws]
    random.Random(1).shuffle(rows)
    for part in (rows[::2], rows[1::2], [(None, 10**6, None, None)], [(None, 2 * 10**6, None, None)]):
        t = spark.createDataFrame(part, kind).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1)
        t.write.mode("append").parquet(str(tmp_path / "w"))
    stream = sources.read_frames(spark, str(tmp_path / "w"), t.schema, streaming=True, files=1)
    got = {r.series_id: (r.n_tokens, r.text) for r in st.spliced_text(st.run_available(st.stream_splice(stream, "series_id", 12, 2), "append"), "series_id", "").collect()}
    for k, ws in keys.items():
        spans = fold(ws, 12, 2)
        left = [p for w, toks in ws for p, _, _ in toks[spans[w][0] : spans[w][1]]]
        assert got[k] == (len(left), "".join(left))


def test_sources(spark, tmp_path):
    (tmp_path / "vocab.json").write_text('{"0": "▁a", "2": "<0x0A>", "x": "no"}')
    got = {(r.token_id, r.piece, r.has_byte_fallback) for r in sources.read_vocab(spark, str(tmp_path / "vocab.json"), 5).collect()}
    assert got == {(0, "▁a", True), (2, "<0x0A>", True), (5, None, True)}
    (tmp_path / "m.json").write_text('{"default": "z", "models": {"a": {"dir_name": "d", "assets": {"r": "f"}}}}')
    with pytest.raises(Exception, match="unknown default"):
        sources.read_manifest(spark, str(tmp_path / "m.json")).collect()
    (tmp_path / "tree/x").mkdir(parents=True)
    (tmp_path / "tree/x/f").write_bytes(b"abc")
    assert [(r.path, r.size, r.sha256 is None) for r in sources.scan_artifacts(spark, str(tmp_path / "tree")).collect()] == [("x/f", 3, True)]
    t, at = spark.range(5), str(tmp_path / "out")
    assert sources.publish_verified(t, at, lambda d: d.where("id < 0")) and spark.read.parquet(at).count() == 5
    assert not sources.publish_verified(spark.range(9), at, lambda d: d.where("id > 7")) and spark.read.parquet(at).count() == 5
    assert sources.publish_verified(spark.range(7), at, lambda d: d.where("id < 0")) and spark.read.parquet(at).count() == 7
    a = spark.createDataFrame([(1, 1), (2, 1)], "k long, version int")
    with pytest.raises(Exception, match="versions differ"):
        sources.upsert_by_key(a, a.withColumn("version", F.lit(2)), ["k"], "version").collect()


def test_keys_of_a_group_share_calls_to_the_state_store():
    """A thousand keys in a micro-batch are one value in state, not calls for each."""
    calls = []

    class Cell:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("put", "update", "appendValue"):
                    self.held = list(args[0]) if name == "put" else [*(self.held if name == "appendValue" else []), args[0]]
                if name == "clear":
                    self.held = []
                return {"exists": bool(self.held), "get": self.held[0] if self.held and self is handle.clock else self.held}.get(name)

            return call

    class Handle:
        clock = Cell()

        def getListState(self, *args):
            return Cell()

        def getValueState(self, name, *args):
            return self.clock if name == "clock" else Cell()

        def registerTimer(self, at):
            calls.append("timer")

        deleteTimer = registerTimer

    handle = Handle()
    p = streaming._Stale("us long, event_id long, event_type string", ["user_id", "event_id", "stale"], 86_400_000)
    p.init(handle)
    rows = pd.DataFrame({"key": range(1_000), "us": range(5_000_000, 5_001_000), "event_id": range(1_000), "event_type": ["SessionStarted", "SessionCompleted"] * 500})
    assert list(p.handleInputRows((0,), iter([rows]), None)) == []
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 6_000})()
    (out,) = p.handleExpiredTimer((0,), now, None)
    assert list(out["user_id"]) == list(range(1, 1_000, 2)) and out["stale"].all() and len(calls) < 20


def test_parts_of_a_stream_are_files_by_their_rows(spark, monkeypatch):
    """A micro-batch is one part, in as many files as its rows ask for, up to the shuffle partitions."""
    monkeypatch.setattr(streaming_plans, "FILE_ROWS", 100)
    rows = spark.range(900).select(F.timestamp_seconds("id").alias("ts"), F.col("id").cast("long"))
    s = streaming_plans._in_parts(spark, rows, (F.col("id") < 300, F.col("id") >= 300), closing=1)
    sizes = streaming.run_available(s, "append").groupBy("batch").agg(F.count("*").alias("n"), F.count("id").alias("ids")).orderBy("batch").collect()
    assert [(r.n, r.ids) for r in sizes] == [(300, 300), (600, 600), (3, 0), (3, 0)]


def test_filler_report_cleans_a_text_once(spark):
    """Every filler is one pass over what those before it left, not one more over the text for each of them."""
    words = ["a", "b", "c", "d", "e", "f"]
    report = text.filler_report(spark.createDataFrame([("a b b e", "en"), ("f", "en"), (None, "en"), ("a", None)], "t string, l string"), "t", "l", {"en": words, "de": words[:2]})
    assert sorted(map(tuple, report.collect())) == [("en", "a", 1, 1, 2), ("en", "b", 2, 1, 4), ("en", "e", 1, 1, 1), ("en", "f", 1, 1, 1)]
    assert report._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 8


def test_tokens_in_order_stream_across_batches(spark):
    """Runs, words and texts that reach over many Arrow batches, several keys and a null one; each task sorts its rows once."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        raw = "zwölf Äpfel".encode()
        spelt = ["▁a", *(f"<0x{b:02X}>" for b in raw), "<s>", "▁b", "c", " d", None, "<unk>", "▁"]
        rows = [(k, n, p) for k in (1, 2, None) for n, p in enumerate(spelt)] + [(3, 0, "<0xC3>"), (3, 1, "<s>"), (4, 0, " x")]
        t = spark.createDataFrame(rows, "k long, ord long, piece string").repartition(5)
        runs = {(r.k, r.ord): (r.n, r.piece) for r in tokens.byte_fallback_runs(t, ["k"]).collect()}
        assert all(runs[k, 1] == (len(raw), "zwölf Äpfel") for k in (1, 2, None)) and runs[3, 0] == (1, "�") and len(runs) == 3 * 9 - 3 + 3
        text = {r.k: r.text for r in tokens.detokenize(t, ["k"]).collect()}
        assert text == {**dict.fromkeys((1, 2, None), "azwölf Äpfel bc d<unk> "), 3: "�", 4: "x"}
        w = t.withColumn("initial", F.col("piece").startswith("▁")).withColumn("pos", F.col("ord") * 2)
        words = tokens.segment_words(w, ["k"])
        found = sorted((r.word_no, r.tok_start, r.tok_end, r.pos, r.word) for r in words.where("k is null").collect())
        end = len(raw)
        assert [x[:4] for x in found] == [(0, 0, end + 2, 0), (1, end + 2, end + 7, 2 * end + 4), (2, end + 7, end + 8, 2 * end + 14)]
        assert found[1][4] == "▁bc d<unk>" and words.where("k = 2").count() == 3
        plan = tokens.detokenize(t, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and "collect_list" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("noisy", [False, True])
def test_windows_cut_in_batches_equal_the_plan(spark, tmp_path, noisy):
    """Also for null and empty texts, a null id, and texts of just a window's size."""
    words = [f"w{k}ß" if k % 5 else f"Äw{k}" for k in range(3_000)]
    rows = [(k, "  ".join(words[:n])) for k, n in enumerate((0, 1, 39, 40, 41, 67, 68, 69, 96, 97, 3_000))] + [(None, "a\x0bb c d\x1ce"), (50, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for at in (str(tmp_path), "/root/testdata/sf0.001"):
        cut, planned = fixtures.cut_windows(spark, at, noisy), fixtures.window_arrays(spark, at, noisy)
        assert cut.schema.simpleString() == planned.schema.simpleString()
        rows = cut.select("*", F.xxhash64("series_id", "window_no", "toks.piece", "toks.pos").alias("h")).groupBy("h").count()
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, planned.select(F.xxhash64("series_id", "window_no", "toks.piece", "toks.pos").alias("h")).groupBy("h").count().collect()))


def test_a_vocabulary_is_broadcast_at_any_size(spark):
    """Rows of a frequent piece would meet in one task of a sorted join."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = spark.createDataFrame([("▁a",), ("b",), (None,)], "token_id string")
        found = tokens.piece_info(t, spark.createDataFrame([("▁a", "▁a")], "token_id string, piece string"))
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and found.where("initial").count() == 1 and found.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_stream_splice_leaves_little_on_disk(spark, monkeypatch):
    """Waiting windows are kept compressed, windows are not shuffled to be written, and what the stream read and kept goes with it."""
    repartition = type(spark.range(1)).repartition
    toks = "array<struct<piece: string, initial: boolean, pos: long>>"
    places = [[10**6 + k for k in range(40)], [7, None, 9], [None, 5], [-(2**63), 2**63 - 1], [2**62, 2**63 - 1], [2**63 - 1], [-1, 0], [3]]
    rows = [[(f"w{p}", True, p) for p in ps] for ps in places]
    rows += [[("a\x1fb", True, 0), ("c", False, 1)], [("a\x1eb", True, 0), ("", True, 1)], [(None, None, 0), ("\x1f", True, 1)], [("", True, 4)]]
    made = spark.createDataFrame([(r,) for r in [*rows, [], None]], f"toks {toks}").select(streaming._packed_tokens(F.col("toks")).alias("t")).collect()
    assert [r.t for r in made[-2:]] == [None, None]
    assert [[(p, bool(i), k) for p, i, k in streaming._tokens(r.t)] for r in made[:-2]] == [[(p, bool(i), k) for p, i, k in r] for r in rows]
    table = pa.table({"key": [1] * 500, "toks": [made[0].t] * 500})
    blob = streaming._packed(table)
    assert list(streaming._rows(blob)) == [(1, made[0].t)] * 500 and len(blob) < table.nbytes / 4

    def by_key(df, n, *by):
        assert by, "windows are shuffled"
        return repartition(df, n, *by)

    monkeypatch.setattr(type(spark.range(1)), "repartition", by_key)
    at = sources.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert streaming_plans.st3_stream_splice(spark, "/root/testdata/sf0.001").count() == 200
    (left,) = set(os.listdir(at)) - before
    assert os.listdir(f"{at}/{left}") == ["out"]
