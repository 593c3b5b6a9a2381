import glob
import os

import pytest

from lexigraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_the_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_every_problem_has_its_query():
    names = set(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 7, 9, 10)} | {"p8_ids"} <= names
