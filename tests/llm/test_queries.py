"""Registered queries of this subpackage against their DuckDB twins."""

import os

import duckdb
import pytest

from pairweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    plain = lambda df: rows(df.astype({c: "float64" if df[c].dtype.kind == "f" else "int64" for c in df if df[c].dtype.kind in "iuf"}))
    assert plain(got) == plain(want)
