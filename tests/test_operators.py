import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import balanced, classterms, embedding, graph, search, tokens
from lexigraph.session import broadcast_if_small, materialize, spread
from lexigraph.sources import readers, writers
from lexigraph.streaming import upsert
from tests.test_scalars import indel

T0 = dt.datetime(2020, 1, 1)
BAL = "key string, at timestamp, id long, n int, part int, first_at string"


def brute(rows):
    out = {}
    by = defaultdict(list)
    for k, at, i, n, *_ in rows:
        by[k].append((at, i, n))
    for k, v in by.items():
        times = sorted(t for t, _, _ in v if t)
        gaps = [int((b - a).total_seconds() * 1e6) for a, b in zip(times, times[1:])]
        out[k] = (len(v), len({(t, i) for t, i, _ in v}), times[0] if times else None, times[-1] if times else None, max(gaps, default=0), sum(n or 0 for _, _, n in v))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_per_key_stitches_heavy_keys(spark, partitions):
    rows = [("hot", T0 + dt.timedelta(seconds=(i * 37) % 911), i % 50, i % 3, 0, "x") for i in range(2000)]
    rows += [(f"k{i % 40}", T0 + dt.timedelta(days=i), i, 1, 0, "x") for i in range(200)]
    rows += [(None, T0, 1, 1, 0, "x"), (None, None, None, None, 0, None), ("late", None, 1, 2, 0, "x"), ("late", None, 1, 2, 0, "x"), ("", T0, 5, 5, 0, "x")]
    df = spark.createDataFrame(rows, BAL)
    got = {r.key: tuple(r)[1:] for r in balanced.per_key(df, "key", "at", "id", F.col("n"), partitions).collect()}
    assert got == brute(rows)


def test_per_key_of_nothing(spark):
    df = spark.createDataFrame([], BAL)
    assert balanced.per_key(df, "key", "at", "id", F.col("n")).collect() == []
    assert balanced.heavy_keys(df, "key", "at", "id", F.col("n"), 0.05).collect() == []


def test_heavy_keys_count_null_rows_in_the_total(spark):
    rows = [("a", T0, 1, 1, 0, "")] * 5 + [(None, T0, 1, 1, 0, "")] * 94 + [("b", T0, 1, 1, 0, "")]
    assert [r.key for r in balanced.heavy_keys(spark.createDataFrame(rows, BAL), "key", "at", "id", F.col("n"), 0.05).collect()] == ["a"]


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("key"), F.timestamp_seconds("id").alias("at"), "id", F.lit(1).alias("n"))
    ranged = df.repartitionByRange(8, "key", "at", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) > 4 and max(r["count"] for r in ranged) < 8000


def test_search(spark):
    df = spark.createDataFrame([("a手机", ["x", "y"]), ("手机", None), ("b", ["x"]), ("手机", ["z"]), (None, ["x"])], "fact string, acc array<string>")
    got = [(r.fact, r.classes) for r in search.keyword_search(df, "fact", "手机", "acc", ["z"]).collect()]
    assert got == [("a手机", "x;y"), ("手机", "")]
    assert search.keyword_search(df, "fact", "手机", "acc", "zz").count() == 2
    assert search.keyword_search(df, "fact", "手机", "acc").count() == 3
    t = spark.createDataFrame([("甲县", "in", "乙"), ("乙", "in", "甲")], "a string, r string, b string")
    assert (search.triple_search(t, "甲").count(), search.triple_search(t, "甲", False).count()) == (1, 2)


def test_rules_with_look_around(spark):
    rules = search.parse_rules(["(?<!(没))有异议==>异议 # remark", "a b==>c", "# nothing", "", "x==>y==>z"])
    assert rules == [("(?<!(没))有异议", "异议"), ("a", "a"), ("b", "c")]
    df = spark.createDataFrame([("没有异议",), ("被告有异议 b",), (None,)], "t string")
    assert [r[0] for r in df.select(search.rule_hits("t", rules)).collect()][:2] == [[], ["异议", "c"]]
    literal = search.parse_rules(["r(?<!(没))有异议==>异议"])
    assert df.select(search.rule_hits("t", literal)).collect()[1][0] == []


def test_class_terms(spark):
    tok = spark.createDataFrame([(1, "刀", "n"), (1, "刀", "n"), (1, "，", "w"), (2, "车", "n"), (2, "刀", "n"), (3, "x", None)], "case_id int, word string, type string")
    cls = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "case_id int, accusation string")
    freq = classterms.class_frequencies(tok, cls)
    assert {(r.accusation, r.term): r.cnt for r in freq.collect()} == {("A", "刀n"): 2, ("B", "刀n"): 2, ("C", "刀n"): 1, ("C", "车n"): 1}
    assert {(r.accusation, r.term): round(r.score, 6) for r in classterms.tfidf(freq).collect()}[("C", "车n")] == round(0.5 * 1.0986122887, 6)


def test_align_equals_brute_force(spark):
    names = ["盘县", "六盘水市", "棠谷县", "棠谷", "谷棠县", "", "甲", "乙", "棠谷泽族自治县", None]
    aliases = [("棠谷", "棠谷县"), ("棠谷县", "棠谷县"), ("六盘水", "六盘水市"), ("甲", "甲市"), ("", "空"), ("谷县", "谷县")]
    a = spark.createDataFrame([(n,) for n in names], "name string")
    b = spark.createDataFrame(aliases, "pattern string, canonical string")
    want = {}
    for n in filter(None, names):
        scored = [(indel(p, n) / max(min(len(p), len(n)), 1), c) for p, c in aliases if p and c != n]
        scored = [x for x in scored if x[0] <= 0.5]
        if scored:
            want[n] = min(scored)
    assert {r.name: (r.score, r.canonical) for r in graph.align(a, b).collect()} == want


def test_graph_of_a_case(spark):
    tok = spark.createDataFrame([(7, "二零一六年十二月", "TIME"), (7, "周某", "PER"), (7, "周某", "PER"), (7, "x", None), (7, "法院", "ORG"), (7, "县", "LOC")], "case_id int, word string, type string")
    nodes, edges = graph.case_graph(tok)
    names = {(r.label, r.name) for r in nodes.collect()}
    assert names == {("LegalCase", "Case7"), ("Person", "周某_Case7"), ("Time", "二零一六年十二月"), ("Year", "2016年"), ("Month", "12月"), ("YearMonth", "2016年12月"), ("Organization", "法院"), ("Location", "县")}
    got = {(r.src, r.type, r.dst) for r in edges.collect()}
    assert ("2016年12月", "相关时间", "12月") in got and ("Case7", "人物", "周某_Case7") in got
    assert graph.link(edges, nodes.where("label <> 'Person'")).count() == edges.count() - 1


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "name string, v int, p string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "q"), ("c", 0, "r")], "name string, v int, p string")
    assert {tuple(r) for r in graph.upsert_nodes(old, new, ["name"], "v").collect()} == {("a", 2, "z"), ("b", 1, "y"), ("c", 1, "q")}
    assert [r.name for r in graph.new_rows(old, new, ["name"]).collect()] == ["c"]


def test_containing_and_ontology(spark):
    al = spark.createDataFrame([("棠谷", "棠谷县"), ("县", "县")], "pattern string, canonical string")
    n = spark.createDataFrame([("棠谷县法院",), ("谷",), (None,)], "name string")
    # every alias counts, those of one character too; search.usable_aliases bars unwanted ones before
    assert sorted(tuple(r) for r in graph.containing(n, al).collect()) == [("棠谷县法院", "县"), ("棠谷县法院", "棠谷县")]
    tr = spark.createDataFrame([(2, "棠谷", "in", "乙"), (1, "棠谷", "in", "甲"), (3, "无", "in", "丙")], "seq int, a string, r string, b string")
    got = {r.name: r.props for r in graph.ontology(tr, al).collect()}
    assert got == {"棠谷县": {"in": "甲;乙"}, "县": {}}


def test_windows(spark):
    df = spark.createDataFrame([(1, i, w, "n") for i, w in enumerate(["甲", "。", "乙", "丙", "。", "丁"])], "case_id int, pos int, word string, type string")
    sent = tokens.with_sentences(df)
    assert [(r.sent_id, r.idx) for r in sent.orderBy("pos").collect()] == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 1)]
    assert tokens.complete_sentences(sent).count() == 5
    gap = spark.createDataFrame([(1, 1), (1, 4), (1, 5)], "k int, i int")
    assert sorted(r.missing for r in tokens.gaps(gap, ["k"], "i").collect()) == [2, 3]
    ev = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "u int, t int, v string")
    assert [(r.run, r.v, r.n) for r in tokens.runs(ev, ["u"], ["t"], "v").orderBy("run").collect()] == [(1, "a", 2), (2, None, 2), (3, "a", 1)]


def test_classifier_inputs(spark):
    df = spark.createDataFrame([(["甲", "打", "乙", "打", "丙"], "甲", "打"), (["甲"], "甲", "无")], "w array<string>, e1 string, e2 string")
    a, b = embedding.classifier_inputs(df, "w", "e1", "e2", {"乙": 1}, 8).collect()
    assert a.ids == [2, 3, 1, 3, 0, 0, 0, 0] and a.pos2[:5] == [7, 7, 7, 7, 7]
    assert b.ids is None


def test_sources_round_trip(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"fact": "甲", "meta": {"accusation": ["x"]}}\nnot json\n', encoding="utf8")
    rows = readers.json_lines(spark, f"{p}/a.jsonl").cache().collect()
    assert rows[0].fact == "甲" and rows[1]._corrupt == "not json"
    (tmp_path / "t.tsv").write_text("a\tb\tc\nshort\tline\n", encoding="utf8")
    assert [tuple(r) for r in readers.triples(spark, f"{p}/t.tsv").collect()] == [("a", "b", "c")]
    (tmp_path / "g.txt").write_bytes("甲,乙\n丙\n".encode("gbk"))
    assert [r.value for r in readers.lines(spark, f"{p}/g.txt", "GBK").collect()] == ["甲,乙", "丙"]
    assert [r.value for r in readers.lines(spark, f"{p}/t.tsv", keep_break=True).collect()] == ["a\tb\tc\n", "short\tline\n"]
    (tmp_path / "e.txt").write_text("2 3\n" + "w" * 40 + " 1 2.5 x\nv 1 2\n", encoding="utf8")
    got = readers.embeddings(spark, f"{p}/e.txt", 3).collect()
    assert [(len(r.word), r.vec) for r in got] == [(30, [1.0, 2.5, None])]
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, w array<string>")
    writers.line_sentences(df, "w", f"{p}/ls")
    assert [r.value for r in spark.read.text(f"{p}/ls").collect()] == ["a b"]
    writers.json_lines(df, f"{p}/js")
    writers.json_lines(df, f"{p}/js")
    assert spark.read.json(f"{p}/js").count() == 2
    writers.append_new(df, f"{p}/up", ["id"])
    writers.append_new(df, f"{p}/up", ["id"])
    assert spark.read.parquet(f"{p}/up").count() == 1
    assert readers.settings("# x\nkey 12\nname  v\nbad\nthree a b\n") == {"key": 12, "name": "v"}


def test_records_of_segmenter_and_parser(spark):
    df = spark.createDataFrame([(1, "甲 n 0 3\t乙。丙 nz 3 9\tbad\t。 w 12 3")], "id int, r string")
    assert [(r.word, r.type) for r in readers.segmented_records(df, "r").collect()] == [("甲", "n"), ("乙", "nz"), ("。", "w"), ("丙", "BAD"), ("。", "w")]
    line = "1\t甲\t_\t_\tNR\t_\t2\tnsubj\t_\t_"
    df = spark.createDataFrame([(1, line + "\nshort\n")], "id int, r string")
    assert [tuple(r) for r in readers.parser_rows(df, "r").collect()] == [(1, 1, "甲", "NR", 2, "nsubj")]
    red = spark.createDataFrame([("甲", "甲县")], "title string, target string")
    assert {r.n: r.canonical for r in readers.follow_redirects(spark.createDataFrame([("甲",), ("乙",)], "n string"), "n", red).collect()} == {"甲": "甲县", "乙": ""}


def test_stream_resumes_and_appends_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "case_id long, pos int, word string, type string"
    spark.createDataFrame([(1, 0, "周某", "PER"), (1, 1, "县", "LOC")], schema).write.parquet(src)
    upsert.upsert_tokens(spark, src, schema, out, state)
    first = spark.read.parquet(f"{out}/nodes").count()
    spark.createDataFrame([(1, 2, "县", "LOC"), (2, 0, "县", "LOC")], schema).write.mode("append").parquet(src)
    upsert.upsert_tokens(spark, src, schema, out, state)
    assert (first, spark.read.parquet(f"{out}/nodes").count(), spark.read.parquet(f"{out}/edges").count()) == (3, 4, 3)
    assert upsert.resume_shard(spark, src, schema, 0, 2, "case_id", f"{out}/s", f"{state}/s") == 3
    assert upsert.resume_shard(spark, src, schema, 0, 2, "case_id", f"{out}/s", f"{state}/s") == 3


def test_materialize_and_broadcast_bound(spark):
    df = spark.range(10)
    assert materialize(df).count() == 10 and spread(df) >= 1
    assert "broadcast" in broadcast_if_small(df, 8)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 8, 40)._jdf.queryExecution().logical().toString().lower()


def test_similar_to_skips_unusable_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0])], "k string, v array<float>")
    probes = v.where("k = 'a'").select(F.col("k").alias("probe"), F.col("v").alias("pvec"))
    assert [(r.k, r.cosine) for r in embedding.similar_to(v, "k", "v", probes, 3).collect()] == [("b", 0.707107)]


def test_rows_alike_are_cut_too(spark):
    """A key with null times and ids only: its rows are spread, and the result is that of one task."""
    df = spark.createDataFrame([("a", None, None, "x")] * 4000 + [("b", None, 1, "y")], "k string, t timestamp, i long, f string").repartition(4)
    got = {r.k: (r.n_rows, r.n_distinct, r.total) for r in balanced.per_key(df, "k", "t", "i", F.length("f"), 4).collect()}
    assert got == {"a": (4000, 1, 4000), "b": (1, 1, 1)}
    sizes = df.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(4, "k", "t", "i", "place").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2000
