"""Scans by ranges against the window form: random rows, null keys, ties, one hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlapkit.operators import inventory, series, sessions
from overlapkit.operators.scan import Scan, State

KINDS = ["SessionStarted", "PartialTranscript", "Activity", "SessionCompleted", "Error"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    n = 3_000
    key = np.where(rng.random(n) < 0.6, 7, rng.integers(0, 5, n))  # one key has more than half
    out = []
    for k in range(n):
        v = float(rng.random()) if rng.random() > 0.05 else None
        kind = KINDS[int(rng.integers(0, 5))]
        out.append((int(key[k]) if key[k] != 3 else None, k // 3, k, v, kind, ["Start", "Stop", "Toggle", "Toggle"][int(rng.integers(0, 4))], f"c{k}" if v else None, f"u{k}", ["a", "b", None][int(rng.integers(0, 3))], int(rng.integers(0, 100))))
    kind = "k long, ts long, event_id long, p double, event_type string, command string, confirmed string, unconfirmed string, file string, bytes long"
    return spark.createDataFrame(out, kind).repartition(6).withColumn("kind", F.when(F.col("command") == "Start", "start").when(F.col("command") == "Stop", "done").otherwise("progress"))


ORDER = ["ts", "event_id"]
CASES = {
    "gate": lambda t, n: series.hysteresis_gate(t, "k", ORDER, "p", 0.6, 0.3, range_rows=n),
    "silence": lambda t, n: series.trailing_silence(series.hysteresis_gate(t, "k", ORDER, "p", 0.9, 0.6), "k", ORDER, range_rows=n),
    "utterances": lambda t, n: series.utterances(series.hysteresis_gate(t, "k", ORDER, "p", 0.9, 0.6), "k", ORDER, 96, range_rows=n),
    "endpoints": lambda t, n: series.endpoints(series.trailing_silence(series.hysteresis_gate(t, "k", ORDER, "p", 0.9, 0.6), "k", ORDER), "k", ORDER, 96, range_rows=n),
    "dispatch": lambda t, n: sessions.dispatch_commands(t, "k", ORDER, range_rows=n),
    "stale": lambda t, n: sessions.drop_stale_completions(t, "k", ORDER, range_rows=n),
    "view": lambda t, n: sessions.view_state(t, "k", ORDER, range_rows=n),
    "progress": lambda t, n: inventory.progress_rollup(t, "k", "file", ORDER, "bytes", "ts", range_rows=n),
    "ticks": lambda t, n: inventory.live_ticks(t, "k", ORDER, range_rows=n),
}


@pytest.mark.parametrize("name", list(CASES))
def test_ranges_equal_windows(rows, name):
    want, got = CASES[name](rows, 10**9), CASES[name](rows, 150)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_states(spark):
    t = spark.createDataFrame([(1, k, None if k % 3 else k, k % 2) for k in range(40)], "k long, at long, v long, f long")
    states = {
        "a": State("last", F.col("v")), "b": State("last", F.col("v"), before=True, default=F.lit(-1)), "c": State("lag", F.col("v")), "d": State("sum", F.col("v"), before=True),
        "e": State("max", F.col("v"), by=("f",)), "g": State("lag", F.col("at"), by=("f",)),
    }
    want, got = (Scan(t, ["k"], ["at"], n).with_states(**states).rows() for n in (100, 7))
    assert got.columns == ["k", "at", "v", "f", *states] and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert Scan(t.limit(0), ["k"], ["at"]).with_states(**states).rows().count() == 0


def test_a_hot_series_runs_in_many_tasks(spark):
    t = spark.range(400_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("p"))
    s = Scan(t, ["k"], ["at"], 20_000)
    dealt = s.heavy.groupBy("_range").count().collect()
    assert s.light.count() == 0 and len(dealt) >= 20 and max(r["count"] for r in dealt) < 60_000
    plain, ranged = (series.hysteresis_gate(t, "k", ["at"], "p", range_rows=n) for n in (10**9, 20_000))
    assert ranged.exceptAll(plain).count() == 0 and ranged.count() == 400_000
