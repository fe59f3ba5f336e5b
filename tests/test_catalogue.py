"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from rightsloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        return None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, str) else float(v) if hasattr(v, "as_tuple") else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y) if all(isinstance(v, float) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
