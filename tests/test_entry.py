import glob
import os

import pytest

import __spark_entry__
from lexigraph import queries_core, queries_io, queries_reference

SF = "/root/testdata/sf0.001"
QUERIES = queries_reference.queries() | queries_io.queries() | queries_core.queries()
SQL = queries_reference.oracle_sql() | queries_io.oracle_sql() | queries_core.oracle_sql()
CHECKED = ["keyword_search", "keyword_rules", "tfidf_topk", "sampled_frequencies", "sentence_split", "run_grouping", "prefix_concat", "path_match_arb", "pattern_frequency", "relation_features", "graph_edges", "cosine_topk", "position_features", "relation_edges", "induced_patterns", "indel_align_top1", "segmenter_records", "parser_rows", "embedding_file", "gbk_lines", "string_measures", "incremental_upsert", "tree_text", "p5_found", "p5_per_charge"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else str(v) for v in row) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHECKED)
def test_rows_equal_the_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(SQL[name]).df())


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_flagship_has_rows(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    assert __spark_entry__.entry(spark).count() > 0
