"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    out = [tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


ENGINE = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.mark.parametrize("name", ENGINE)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    wanted = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) == len(wanted)
    a, b = rows(got), rows(wanted)
    differ = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differ, f"{len(differ)} rows differ, first {differ[:2]}"
    assert len(got) > 0
