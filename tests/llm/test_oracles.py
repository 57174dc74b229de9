"""Queries of this subpackage with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from overlapkit.llm import oracle, queries

SF = "/root/testdata/sf0.001"


def norm(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else str(x)
    return sorted(repr([show(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings conversations labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(found.fetchall(), columns)
