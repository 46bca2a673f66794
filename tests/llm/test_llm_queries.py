"""Queries of the corpus operators that SQL expresses, against that SQL."""

import duckdb
import pytest

from waveframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_small, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_small}/{table}.parquet')")
    found = duck.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    df = QUERIES[name](spark, sf_small)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(r) for r in found.fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
