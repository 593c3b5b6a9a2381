from lexigraph.operators import annotations

KEYS = ["doc_id"]
TOK = [(1, 1, "周某", "PER", 2, "nsubj"), (1, 2, "供述", "v", 0, "root"), (1, 4, "事实", None, 2, "dobj")]
SCHEMA = "doc_id int, idx int, word string, type string, head int, dep string"


def test_tree_text(spark):
    df = spark.createDataFrame(TOK, SCHEMA)
    assert annotations.tree_text(df, KEYS).first().tree == "(ROOT:[ROOT] (root:供述 (nsubj:周某 )(dobj:事实 )))"
    chain = spark.createDataFrame([(1, i, "w", "n", i - 1, "d") for i in range(1, 3000)], SCHEMA)
    assert annotations.tree_text(chain, KEYS).first().tree.count("(") == 3000


def test_display_and_punctuation(spark):
    df = spark.createDataFrame(TOK, SCHEMA)
    assert {r.idx: r.line for r in annotations.display(df, KEYS).collect()} == {1: "周某(1PER->供述)", 2: "供述(2v->PUNC)", 4: "事实(4->供述)"}
    seg = spark.createDataFrame([(1, 3, "，", "w", 0, ""), (1, 2, "供述", "v", 0, "")], SCHEMA)
    assert sorted((r.idx, r.dep) for r in annotations.with_punctuation(df, seg, KEYS).collect()) == [(1, "nsubj"), (2, "root"), (3, "-"), (4, "dobj")]


def test_decode(spark):
    df = spark.createDataFrame([("1", "is", "cri"), ("2", "7", "3"), ("1", "nope", "3"), ("who", "is", "3"), (None, "is", "3")], "a string, r string, b string")
    assert sorted(tuple(r) for r in annotations.decode(df).collect()) == [(1, -1, -10), (2, 7, 3)]


def test_confirm(spark):
    cols = "doc_id int, a_idx int, r_idx int, b_idx int"
    cand = spark.createDataFrame([(1, 1, -1, 2), (1, 3, -1, 4), (1, 5, -1, 6), (1, 5, -1, 6)], cols)
    ans = spark.createDataFrame([(1, 1, -1, 2, "yes", False), (1, 3, -1, 4, "no", False), (1, 9, 8, 7, None, True)], cols + ", answer string, entered boolean")
    assert {tuple(r)[1:] for r in annotations.confirm(cand, ans, KEYS).collect()} == {(1, -1, 2), (5, -1, 6), (9, 8, 7)}
