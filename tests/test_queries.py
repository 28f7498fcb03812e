"""Every registered query of the glycan operators against its DuckDB twin."""

import os

import duckdb
import pytest

from sweetlake.jobs.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(df, columns):
    values = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return sorted(tuple(str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLES:
        assert list(got.columns)
        return
    con = duckdb.connect()
    for t in NAMES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    expected = con.execute(ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)
