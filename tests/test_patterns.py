import random

import pytest
from pyspark.sql import functions as F

from lexigraph import queries_reference
from lexigraph.operators import relations, tokens, trees
from lexigraph.plans import patterns

KEYS = ["doc_id", "sent_id"]
SCHEMA = "doc_id int, sent_id int, idx int, word string, type string, head int, dep string"


def sentence():
    """The worked example: appositions and a predicate with subject, object and conjunct."""
    rows = [(1, "被告人", "n", 2, "appos"), (2, "周某", "PER", 14, "nsubj"), (13, "民警", "n", 14, "dobj"), (14, "抓获", "v", 0, "root"), (19, "供述", "v", 14, "conj"), (20, "犯罪事实", "n", 19, "dobj")]
    return [(1, 0, *r) for r in rows]


def test_worked_example(spark):
    tok = spark.createDataFrame(sentence(), SCHEMA)
    got = patterns.match(tok, "(b)<-[:appos]-(a) ?is", KEYS).collect()
    assert [(r.a_idx, r.r_idx, r.b_idx) for r in got] == [(1, -1, 2)]
    got = patterns.match(tok, "(a)-[:dobj]->(r),(r)<-[:nsubj]-(b)", KEYS).collect()
    assert [(r.a_idx, r.r_idx, r.b_idx) for r in got] == [(13, 14, 2)]
    got = patterns.match(tok, "(a)-[:nsubj]->()<-[:conj]-(r),(r)<-[:dobj]-(b)", KEYS).collect()
    assert (2, 19, 20) in [(r.a_idx, r.r_idx, r.b_idx) for r in got]


def test_second_path_written_backwards_binds_by_role(spark):
    tok = spark.createDataFrame(sentence(), SCHEMA)
    got = patterns.match(tok, "(a)-[:dobj]->(r),(b)-[:nsubj]->(r)", KEYS).collect()
    assert [(r.a_idx, r.r_idx, r.b_idx) for r in got] == [(13, 14, 2)]


@pytest.mark.parametrize("text", ["", "(a)", "(a)-[:x]->(b)", "(a)-[:x]->(b) ?nope", "(a)->(b) ?is", "(a)-[:x]->(a) ?is", "(a)-[:x]->(r)"])
def test_text_that_is_no_pattern(text):
    with pytest.raises(ValueError):
        patterns.parse(text)


def walk(tok, path):
    """A naive walk from every token."""
    by = {r[2]: r for r in tok}
    found = set()

    def go(at, k, trail):
        if k == len(path.steps):
            roles = {r: i for r, i in zip(path.roles, trail) if r}
            if len(set(roles.values())) == len(roles):
                found.add(tuple(sorted(roles.items())))
            return
        way, dep = path.steps[k]
        if way == "child":
            for r in tok:
                if r[5] == at and r[6] == dep:
                    go(r[2], k + 1, [*trail, r[2]])
        elif by[at][6] == dep and by[at][5] in by:
            go(by[at][5], k + 1, [*trail, by[at][5]])

    for i in by:
        go(i, 0, [i])
    return found


def test_matches_equal_a_naive_walk_on_random_trees(spark):
    rng = random.Random(3)
    path = patterns.parse_path("(a)-[:x]->()<-[:y:z]-(b)")
    for _ in range(3):
        tok = [(1, 0, i, f"w{i}", "n", rng.randrange(0, i), rng.choice(["x", "y:z"])) for i in range(1, 25)]
        got = patterns.match_path(spark.createDataFrame(tok, SCHEMA), path, KEYS).collect()
        assert {(("a", r.a_idx), ("b", r.b_idx)) for r in got} == walk(tok, path)


def test_induced_pattern_finds_its_pair_again(spark):
    tok = spark.createDataFrame(sentence(), SCHEMA)
    pairs = spark.createDataFrame([(1, 0, 1, 20)], "doc_id int, sent_id int, a_idx int, b_idx int")
    made = trees.lca_paths(tok, pairs, KEYS, "a", "b").first().pattern
    assert made == "(a)-[:appos]->()-[:nsubj]->()<-[:conj]-()<-[:dobj]-(b)"
    got = patterns.match(tok, made + " ?is", KEYS).collect()
    assert [(r.a_idx, r.b_idx) for r in got] == [(1, 20)]


def test_prefixes_run_downwards(spark):
    rows = [(1, 0, 5, "在", "p", 8, "case"), (1, 0, 6, "启东市", "LOC", 8, "nmod"), (1, 0, 7, "汇龙镇", "LOC", 8, "nmod"), (1, 0, 8, "金手", "n", 0, "root")]
    from lexigraph.functions import scalars as X

    tok = spark.createDataFrame(rows, SCHEMA).withColumn("penn", X.penn_tag("type"))
    assert [(r.idx, r.prefix) for r in tokens.prefixes(tok, KEYS).collect()] == [(8, "汇龙镇|启东市|")]


def test_features_of_implied_and_given_relations(spark):
    tok = spark.createDataFrame([*sentence(), (1, 0, 15, "，", "w", 14, "punct")], SCHEMA)
    cand = spark.createDataFrame([(1, 0, 13, 14, 2), (1, 0, 1, -1, 20)], "doc_id int, sent_id int, a_idx int, r_idx int, b_idx int")
    got = {r.a_idx: tuple(r)[5:] for r in relations.features(cand, tok, KEYS).collect()}
    assert got[13] == (0, 9, 6, 1, 1, 12, -1, 11, -1, 0, -1)
    assert got[1] == (0, 99, 0, 0, -1, 0, 1, 19, 1, 1, -1)


def test_labels_treat_implied_relations_alike(spark):
    schema = "doc_id int, sent_id int, a_idx int, r_idx int, b_idx int"
    cand = spark.createDataFrame([(1, 0, 1, -1, 2), (1, 0, 3, 4, 5)], schema)
    gold = spark.createDataFrame([(1, 0, 1, -3, 2), (1, 0, 3, 9, 5)], schema)
    assert {r.a_idx: r.label for r in relations.labelled(cand, gold, KEYS).collect()} == {1: 1, 3: 0}


def test_gate_keeps_patterns_without_a_tree(spark):
    cols = ["pattern", "label", *relations.FEATURES]
    rows = [("p", int(i % 2), *([i % 2] * 11)) for i in range(30)] + [("q", 0, *([0] * 11))]
    df = spark.createDataFrame(rows, cols)
    models = relations.train_trees(df)
    assert list(models) == ["p"]
    kept = relations.gate(df, models)
    assert kept.where("pattern = 'p'").count() == 15 and kept.where("pattern = 'q'").count() == 1
    assert relations.gate(df, {}).count() == 31


def test_ancestors_are_followed_to_the_root(spark):
    """A chain of 35 tokens, of which the root has two branches; and a ring, which ends."""
    deep = [(1, 0, i, i - 1, "d", "x", "w") for i in range(1, 36)] + [(1, 0, 36, 1, "e", "x", "w")]
    ring = [(2, 0, i, i % 3 + 1, "d", "x", "w") for i in range(1, 4)]
    tok = spark.createDataFrame(deep + ring, "doc_id long, sent_id int, idx int, head int, dep string, type string, word string")
    up = trees.ancestors(tok, KEYS)
    assert up.where("doc_id = 1 and idx = 35").agg(F.max("steps")).first()[0] == 34
    assert up.where("doc_id = 2 and idx = 1").select("anc").distinct().count() == 3
    pairs = spark.createDataFrame([(1, 0, 35, 36)], "doc_id long, sent_id int, a_idx int, b_idx int")
    assert trees.lca_paths(tok, pairs, KEYS, "a", "b").first().pattern == "(a)" + "()".join(["-[:d]->"] * 34 + ["<-[:e]-"]) + "(b)"


def test_lca_of_a_long_sentence(spark, tmp_path):
    """The common ancestor of tokens 2,048 and 4,095 of a heap is its root, 11 steps up from both."""
    rows = [(1, i, "w", "PER" if i in (2048, 4095) else "n") for i in range(1, 4096)]
    spark.createDataFrame(rows, "case_id long, pos int, word string, type string").write.parquet(f"{tmp_path}/lac_cut.parquet")
    got = queries_reference.lca_patterns(spark, str(tmp_path)).collect()
    assert [(r.a_idx, r.b_idx, r.pattern.count("->"), r.pattern.count("<-")) for r in got] == [(2048, 4095, 11, 11)]
