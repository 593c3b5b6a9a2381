"""How the joins on tokens are planned, whatever the files on disk weigh."""

import pytest
from pyspark.sql import functions as F

from lexigraph import queries_reference as Q
from lexigraph.operators import graph, relations, tokens, trees
from lexigraph.plans import patterns
from lexigraph.session import materialize

KEYS = Q.KEYS


@pytest.fixture(scope="module")
def tok(spark):
    """Tokens whose file is far below the threshold of a broadcast."""
    rows = [(i // 400, i % 400, "。" if i % 20 == 0 else "词" * (i % 7 + 1), "n") for i in range(4000)]
    cut = spark.createDataFrame(rows, "case_id long, pos int, word string, type string")
    return materialize(tokens.surrogate_tree(tokens.with_sentences(cut)))


def planned(df):
    """The physical plan before it runs; adaptive execution leaves joins with a hint as they are."""
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("text", [Q.AB, Q.ARB])
def test_no_match_is_broadcast(tok, text):
    plan = planned(patterns.match(tok, text, KEYS))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_label_is_broadcast(tok):
    found = patterns.match(tok, Q.AB, KEYS)
    plan = planned(relations.labelled(materialize(found), found.where("a_idx % 2 = 0"), KEYS))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_sentence_is_broadcast_for_an_induced_pattern(tok):
    plan = planned(trees.induce_relations(tok, materialize(patterns.match(tok, Q.ARB, KEYS)), KEYS))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("of", [relations.features, lambda *x: graph.relation_graph(*x)[1]])
def test_no_token_is_broadcast_for_its_features_or_edges(monkeypatch, tok, of):
    plans = []
    for module in (relations, graph):
        monkeypatch.setattr(module, "materialize", lambda df, **kw: plans.append(planned(df)) or materialize(df, **kw))
    plans.append(planned(of(materialize(patterns.match(tok, Q.ARB, KEYS)), tok, KEYS)))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_tokens_with_sentences_are_shuffled_once(spark, tmp_path):
    rows = [(1, i, "w", "n") for i in range(9)]
    spark.createDataFrame(rows, "case_id long, pos int, word string, type string").write.parquet(f"{tmp_path}/lac_cut.parquet")
    plan = Q.tree_tokens(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_predicate_without_a_token_gives_no_match(spark):
    """The head of 2 and 3 isn't there; that of 5 and 6 is."""
    rows = [(1, 0, 2, 9, "nsubj"), (1, 0, 3, 9, "dobj"), (1, 0, 4, 0, "x"), (1, 0, 5, 4, "nsubj"), (1, 0, 6, 4, "dobj")]
    tok = spark.createDataFrame(rows, "case_id long, sent_id int, idx int, head int, dep string")
    for text in (Q.ARB, "(r)<-[:nsubj]-(a),(r)<-[:dobj]-(b)", "(a)-[:nsubj]->(r),(b)-[:dobj]->(r)"):
        assert [(r.a_idx, r.r_idx, r.b_idx) for r in patterns.match(tok, text, KEYS).collect()] == [(5, 4, 6)]


def test_features_of_candidates_lie_where_their_sentence_does(tok):
    """Each candidate once, with the tags of its tokens, as a join on all keys gives them."""
    found = materialize(patterns.match(tok, Q.ARB, KEYS))
    got = relations.features(found, tok, KEYS)
    assert got.count() == found.count() > 0 and got.where("pos_a <> 0 or pos_r <> 0 or pos_b <> 0").isEmpty()
    assert got.select(F.sum(F.abs(F.col("a_idx") - F.col("r_idx")) - F.col("ra"))).first()[0] == 0
