"""Corpus queries that SQL can express give the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from strandline.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    key = got.columns[0]
    got, want = (f[sorted(got.columns)].sort_values(key).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None), check_dtype=False)
