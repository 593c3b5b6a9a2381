import pytest
from pyspark.sql import functions as F

from lexigraph import session
from lexigraph.operators import graph, relations, trees
from lexigraph.plans import patterns
from lexigraph.sources import readers, writers
from lexigraph.streaming import upsert

KEYS = ["case_id", "sent_id"]
SCHEMA = "case_id long, sent_id int, idx int, word string, type string, head int, dep string"
#: The worked sentence: appositions, a predicate with subject and object, and a conjunct with an object.
ROWS = [(1, "被告人", "n", 2, "appos"), (2, "周某", "PER", 14, "nsubj"), (13, "民警", "n", 14, "dobj"), (14, "抓获", "v", 0, "root"), (19, "供述", "v", 14, "conj"), (20, "犯罪事实", "n", 19, "dobj")]


@pytest.fixture
def tok(spark):
    return spark.createDataFrame([(7, 0, *r) for r in ROWS], SCHEMA)


def gold(spark, *rows):
    return spark.createDataFrame([(7, 0, *r) for r in rows], "case_id long, sent_id int, a_idx int, r_idx int, b_idx int")


def test_induced_roles_and_their_matches(spark, tok):
    rel = gold(spark, (1, -1, 2), (13, 14, 2), (2, 19, 20), (1, 14, 99), (13, -9, 2))
    got = {(r.a_idx, r.r_idx, r.b_idx): r.pattern for r in trees.induce_relations(tok, rel, KEYS).collect()}
    assert got == {
        (1, -1, 2): "(a)-[:appos]->(b) ?is",
        (13, 14, 2): "(a)-[:dobj]->(r),(r)<-[:nsubj]-(b)",
        (2, 19, 20): "(a)-[:nsubj]->()<-[:conj]-(r),(r)<-[:dobj]-(b)",
    }
    for (a, r, b), text in got.items():
        assert (a, r, b) in {(m.a_idx, m.r_idx, m.b_idx) for m in patterns.match(tok, text, KEYS).collect()}


def test_the_store_chooses_the_writing(spark, tok):
    store = spark.createDataFrame([("(b)<-[:appos]-(a) ?is", 4), ("(r)<-[:dobj]-(a),(b)-[:nsubj]->(r)", 1)], "pattern string, frequency long")
    made = trees.induce_relations(tok, gold(spark, (1, -1, 2), (13, 14, 2), (2, 19, 20)), KEYS, store)
    assert {r.a_idx: r.pattern for r in made.collect()} == {1: "(b)<-[:appos]-(a) ?is", 13: "(r)<-[:dobj]-(a),(b)-[:nsubj]->(r)", 2: "(a)-[:nsubj]->()<-[:conj]-(r),(r)<-[:dobj]-(b)"}
    assert [(r.pattern, r.frequency) for r in trees.restock(store, made).collect()][0] == ("(b)<-[:appos]-(a) ?is", 5)


def test_relations_become_edges(spark, tok):
    nodes, edges = graph.relation_graph(gold(spark, (1, -1, 2), (13, 14, 2), (13, 14, 99), (13, 50, 2)), tok, KEYS)
    assert {tuple(r)[:2] for r in nodes.collect()} == {("Entity", "被告人"), ("Person", "周某_Case7"), ("Entity", "民警")}
    assert {tuple(r) for r in edges.collect()} == {
        ("Entity", "被告人", "is", "Person", "周某_Case7"), ("Entity", "民警", "抓获", "Person", "周某_Case7"),
        *((label, name, "相关实体", "LegalCase", "Case7") for label, name in (("Entity", "被告人"), ("Person", "周某_Case7"), ("Entity", "民警"))),
    }


def test_keywords_and_places(spark):
    nodes, edges = graph.keyword_graph(spark.createDataFrame([(1, "自愿认罪"), (2, None), (None, "自愿认罪")], "case_id long, fact string"), "fact", [("认罪", "罪")])
    assert [tuple(r) for r in edges.collect()] == [("LegalCase", "Case1", "监督关键短语", "Keyword", "罪")] and nodes.count() == 1
    places = spark.createDataFrame([("Location", "棠谷"), ("Organization", "棠谷县法院")], "label string, name string")
    al = spark.createDataFrame([("棠谷", "棠谷县"), ("棠谷县", "棠谷县")], "pattern string, canonical string")
    assert {tuple(r) for r in graph.place_edges(places, al).collect()} == {("Location", "棠谷", "is", "Location", "棠谷县"), ("Organization", "棠谷县法院", "位于", "Location", "棠谷县")}


def test_alignment_by_the_rarest_pairs_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 3))) + rng.choice(["", "自治县", "自治州", "区区"])
    names, pats = {word() for _ in range(120)}, {word() for _ in range(80)}

    def indel(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else 2)))
            row = new
        return row[-1]

    want = {}
    for n in names:
        best = min(((indel(p, n) / max(min(len(p), len(n)), 1), p + "!") for p in pats), default=None)
        if best and best[0] <= 0.5:
            want[n] = best
    got = graph.align(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p, p + "!") for p in pats], "pattern string, canonical string"))
    assert {r.name: (r.score, r.canonical) for r in got.collect()} == want


def test_nodes_that_are_there_take_new_columns(spark):
    old = spark.createDataFrame([("a", "p1", "kept"), ("b", None, "kept")], "name string, prefix string, subgraph string")
    new = spark.createDataFrame([("a", "p2", "x"), ("b", None, "x"), ("c", "p3", "x")], "name string, prefix string, subgraph string")
    assert {tuple(r) for r in graph.merge_nodes(old, new, ["name"], ["prefix"]).collect()} == {("a", "p2", "kept"), ("b", None, "kept"), ("c", "p3", "x")}


def test_a_later_batch_sets_the_prefix(spark, tmp_path):
    schema = "case_id long, sent_id int, idx int, word string, type string, prefix string"
    base = str(tmp_path)
    for k, prefix in enumerate(["甲|", "乙|"]):
        spark.createDataFrame([(1, 0, 1, "周某", "PER", prefix)], schema).write.mode("append").parquet(f"{base}/in")
        upsert.upsert_tokens(spark, f"{base}/in", schema, f"{base}/graph", f"{base}/state")
    assert [tuple(r) for r in upsert.prefixes(spark, f"{base}/graph").collect()] == [("Person", "周某_Case1", "乙|")]
    assert spark.read.parquet(f"{base}/graph/nodes").where("label = 'Person'").count() == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError):
        session.shared_dir(Session)


def test_annotator_tokens_and_other_text(spark):
    df = spark.createDataFrame([(1, '{"sentences": [{"index": 0, "tokens": [{"index": 1, "word": "a", "pos": null}]}]}'), (2, "no json"), (3, None)], "doc_id int, doc string")
    assert [tuple(r) for r in readers.annotator_tokens(df, "doc").collect()] == [(1, 0, 1, "a", None)]


def test_text_in_another_encoding(spark, tmp_path):
    path = f"{tmp_path}/gbk"
    writers.text_encoded(spark.createDataFrame([("甲县,乙\"",), ("b c",)], "v string"), "v", path, "GBK")
    assert sorted(r.value for r in readers.lines(spark, path, "GBK").collect()) == sorted(["甲县,乙\"", "b c"])
    assert readers.lines(spark, path, "GBK").where(F.contains("value", F.lit("甲"))).count() == 1


def test_a_round_of_learning(spark):
    """Twenty sentences of one shape, half of them confirmed: the pattern enters the store, and its tree tells them apart by the tag."""
    rows = [(k, 0, i, w, t if i != 1 or k % 2 else "n", h, d) for k in range(20) for i, w, t, h, d in [(1, "周某", "PER", 2, "nsubj"), (2, "抓获", "v", 0, "root"), (3, "民警", "n", 2, "dobj")]]
    tok = spark.createDataFrame(rows, SCHEMA)
    confirmed = spark.createDataFrame([(k, 0, 1, 2, 3) for k in range(1, 20, 2)], "case_id long, sent_id int, a_idx int, r_idx int, b_idx int")
    store, models = relations.retrain(tok, confirmed, spark.createDataFrame([], "pattern string, frequency long"), KEYS)
    assert [tuple(r) for r in store.collect()] == [("(a)-[:nsubj]->(r),(r)<-[:dobj]-(b)", 10)]
    rows = relations.features(patterns.match_all(tok, list(models), KEYS), tok, KEYS)
    assert {r.case_id for r in relations.gate(rows, models).collect()} == set(range(1, 20, 2))
    assert relations.retrain(tok, confirmed.limit(0), spark.createDataFrame([], "pattern string, frequency long"), KEYS)[1] == {}
