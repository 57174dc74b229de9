"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
import regex
from test_operators import fold

from overlapkit import plans
from overlapkit.operators import text
from overlapkit.plans import fixtures, seams
from overlapkit.plans import text as text_plans

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def norm(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else str(x)
    return sorted(repr([show(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(plans.all_queries()))
def test_query(spark, duck, name):
    df = plans.all_queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = plans.all_oracles().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm(rows, df.columns) == norm(cursor.fetchall(), columns)


def test_noisy_merges_equal_the_fold(spark):
    """d4 and d6, which have no SQL, window by window."""
    keys = defaultdict(dict)
    for r in fixtures.window_arrays(spark, SF, noisy=True).collect():
        keys[r.series_id][r.window_no] = [tuple(t) for t in r.toks]
    merged = {r.series_id: (r.n_tokens, r.text) for r in seams.d4_merge_windows(spark, SF).collect()}
    steps = {(r.series_id, r.step): tuple(r)[2:] for r in seams.d6_confirmed_split(spark, SF).collect()}
    assert merged.keys() == keys.keys()
    for k, windows in keys.items():
        ws = sorted(windows.items())
        spans = fold(ws, fixtures.OVERLAP, seams.N_DIFF)
        left = [p for w, toks in ws for p, _, _ in toks[spans[w][0] : spans[w][1]]]
        assert merged[k] == (len(left), " ".join(left))
        seen = []
        spans = fold(ws, fixtures.OVERLAP, 0, seen)
        for (w, toks), (before, kept, after) in zip(ws, seen, strict=True):
            assert steps[k, w] == (before, kept, " ".join(p for p, _, _ in toks[spans[w][0] :]), after)


def test_whole_dictionaries_equal_plain_substitution(spark):
    """e4_clean_corpus_full, which has no SQL, filler by filler in another regular expression engine."""
    got = {r.doc_id: (r.chars, r.digest) for r in text_plans.e4_clean_corpus_full(spark, SF).collect()}
    punctuation = ".,!?:;\u2010-\u201f\u2030-\u205f\u3001-\u3003\u3008-\u3011\u3014-\u3017\u301d-\u302f\uff01-\uff60"
    for r in text_plans._dirty(spark, SF).collect():
        t = r.text
        for w in text.FILLERS.get(r.lang, []):
            t = regex.sub(rf"(?i)(?<!\p{{Alphabetic}}){regex.escape(w, literal_spaces=True)}(?!\p{{Alphabetic}}) ?", "", t)
        t = regex.sub(f" ([{punctuation}])", r"\1", regex.sub(" +", " ", regex.sub("\n{3,}", "\n\n", t))).strip()
        assert got[r.doc_id] == (len(t), hashlib.md5(t.encode()).hexdigest())
