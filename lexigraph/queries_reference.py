"""Queries of the text-to-graph operators over whole tables, with the equivalent SQL."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph import schemas
from lexigraph.functions import scalars as X
from lexigraph.operators import annotations, classterms, embedding, graph, relations, search, tokens, trees
from lexigraph.plans import patterns
from lexigraph.session import materialize, scratch, table
from lexigraph.sources import readers, writers
from lexigraph.streaming import upsert

KEYS = ["case_id", "sent_id"]
AB = "(b)<-[:appos]-(a) ?is"
ARB = "(a)-[:nsubj]->(r),(r)<-[:dobj]-(b)"
RULES = ["手机尾号[0-9]{4}==>尾号 自愿认罪 # two rules on a line", "另案处理==>另案", "绰号“[^”]+”==>绰号 # a remark"]
PEOPLES = ["泽族", "岚族"]
VOCABULARY = {"被告人": 1, "，": 2, "。": 3}


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.segmented(table(spark, sf, "lac_cut"))


def tree_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens with sentences and the surrogate tree."""
    return tokens.surrogate_tree(tokens.with_sentences(tokens.segmented(table(spark, sf, "lac_cut"), together=True)))


def _stored_tokens(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Keys, idx, head, dep and the named columns of tree_tokens on disk, without the shuffle files they came by."""
    return materialize(tree_tokens(spark, sf).select(*KEYS, "idx", "head", "dep", *cols), tidy=True)


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (case_id, accusation) of all charges of a case."""
    return table(spark, sf, "train").where("case_id is not null").select("case_id", F.explode("meta.accusation").alias("accusation")).where("accusation is not null").distinct()


def frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return classterms.class_frequencies(segmented(spark, sf), classes(spark, sf))


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "train").select("case_id", "fact", F.col("meta.accusation").alias("acc"))
    return search.keyword_search(df, "fact", "手机", "acc", ["醉酒驾车"]).select("case_id", "classes")


def triple_search(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "divisions").select(F.col("name").alias("a"), F.col("level").alias("r"), F.col("short").alias("b"))
    return search.triple_search(t, "竹", False)


def line_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.contains("text", F.lit("被告人"))).agg(F.count("*").alias("n"))


def keyword_rules(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.rule_hits("fact", search.parse_rules(RULES))
    return table(spark, sf, "train").select("case_id", F.explode(hits).alias("hit")).distinct()


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return classterms.top(classterms.tfidf(frequencies(spark, sf)), "score", 200, ["term", "accusation"])


def tf_topk(spark: SparkSession, sf: str) -> DataFrame:
    freq = frequencies(spark, sf).groupBy("term").agg(F.sum("cnt").alias("cnt"))
    return classterms.top(freq, "cnt", 100, ["term"], 0)


def class_lists(spark: SparkSession, sf: str) -> DataFrame:
    return classterms.classes_of_terms(frequencies(spark, sf))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "train").where("case_id is not null and accusation is not null").select("case_id", "accusation").distinct()


def first_n_per_class_shard(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.first_per_class(_cases(spark, sf), "accusation", "case_id", 6, 10).select("accusation", "shard", "case_id", "rn")


def sampled_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Term frequencies over the cases that the per-class sample took; a sampled case counts for all its classes."""
    taken = tokens.first_per_class(_cases(spark, sf), "accusation", "case_id", 6, 10).select("case_id").distinct()
    return classterms.class_frequencies(segmented(spark, sf).join(taken, "case_id", "left_semi"), classes(spark, sf))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    full = tokens.complete_sentences(tokens.with_sentences(segmented(spark, sf)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])
    return full.groupBy(*KEYS).agg(F.count("*").alias("n_tokens"), F.array_join(words, "").alias("text"))


def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.with_offsets(segmented(spark, sf)).select("case_id", "pos", "word", "begin_at", "end_at")


def gap_commas(spark: SparkSession, sf: str) -> DataFrame:
    kept = segmented(spark, sf).where(~F.col("word").isin(*tokens.COMMAS))
    return tokens.gaps(kept, ["case_id"], "pos").select("case_id", "missing")


def run_grouping(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "run", "event_type", "first_at", "last_at", "n")


def prefix_concat(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.prefixes(tree_tokens(spark, sf).withColumn("penn", X.penn_tag("type")), KEYS)


def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    return trees.edges(tree_tokens(spark, sf), KEYS, by_text=True).select(*KEYS, "head", "idx", "dep", "head_word", "word")


def path_match_ab(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.match(tree_tokens(spark, sf), AB, KEYS)


def path_match_arb(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.match(tree_tokens(spark, sf), ARB, KEYS)


def _person_pairs(tok: DataFrame) -> DataFrame:
    """Neighbouring person tokens of a sentence."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    return tok.where("type = 'PER'").select(*KEYS, F.lag("idx").over(w).alias("a_idx"), F.col("idx").alias("b_idx")).where("a_idx is not null")


def lca_patterns(spark: SparkSession, sf: str) -> DataFrame:
    tok = materialize(tree_tokens(spark, sf).select(*KEYS, "idx", "head", "dep", "type"))
    return trees.lca_paths(tok, _person_pairs(tok), KEYS, "a", "b")


def pattern_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return trees.pattern_frequency(lca_patterns(spark, sf), 3)


def relation_features(spark: SparkSession, sf: str) -> DataFrame:
    tok = _stored_tokens(spark, sf, "word", "type")
    return relations.features(materialize(patterns.match(tok, ARB, KEYS), tidy=True), tok, KEYS)


def label_join(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates labelled by gold relations: nouns and their heads, some of which are no candidates."""
    tok = _stored_tokens(spark, sf, "type")
    gold = tok.where("type = 'n'").select(*KEYS, F.col("idx").alias("a_idx"), F.lit(-2).alias("r_idx"), F.col("head").alias("b_idx"))
    return relations.labelled(materialize(patterns.match(tok, AB, KEYS), tidy=True), gold, KEYS)


def classifier_gate(spark: SparkSession, sf: str) -> DataFrame:
    tok = _stored_tokens(spark, sf, "word", "type")
    cand = _matches(tok)
    rows = materialize(relations.labelled(relations.features(cand, tok, KEYS), cand.where("b_idx > a_idx").select(*KEYS, "a_idx", "r_idx", "b_idx"), KEYS), tidy=True)
    return relations.gate(rows, relations.train_trees(rows)).select(*KEYS, "pattern", "a_idx", "r_idx", "b_idx")


def _matches(tok: DataFrame) -> DataFrame:
    """Matches of both patterns on disk, without the shuffle files that each came by."""
    one, two = (materialize(patterns.match_all(tok, [p], KEYS), tidy=True) for p in (AB, ARB))
    return one.unionByName(two)


def token_display(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.display(tree_tokens(spark, sf), KEYS)


def tag_records(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.tag_records(tokens.with_offsets(segmented(spark, sf)).select("case_id", "pos", "word", "type", "begin_at", "end_at"))


def tree_text(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.tree_text(tree_tokens(spark, sf), KEYS)


def relation_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of persons, written by index or name; tags that name no relation drop out."""
    rel = tree_tokens(spark, sf).where("type = 'PER'").select(*KEYS, F.col("idx").cast("string").alias("a"), F.element_at(F.array(F.lit("is"), F.lit("at"), F.lit("none")), F.col("idx") % 3 + 1).alias("r"), F.lit("cri").alias("b"))
    return annotations.decode(rel)


def confirmed_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Matches with answers by index: every third rejected, every fifth confirmed, and the rejected ones entered anew the other way round."""
    cand = materialize(patterns.match(tree_tokens(spark, sf), ARB, KEYS))
    said = cand.where("a_idx % 3 = 0").select("*", F.lit("no").alias("answer"), F.lit(False).alias("entered"))
    yes = cand.where("a_idx % 3 <> 0 and a_idx % 5 = 0").select("*", F.lit("y").alias("answer"), F.lit(False).alias("entered"))
    new = said.select(*KEYS, F.col("b_idx").alias("a_idx"), "r_idx", F.col("a_idx").alias("b_idx"), "answer", F.lit(True).alias("entered"))
    return annotations.confirm(cand, said.unionByName(yes).unionByName(new), KEYS)


def indel_align_top1(spark: SparkSession, sf: str) -> DataFrame:
    return graph.align(table(spark, sf, "dump_locations").select("name"), graph.aliases_of(table(spark, sf, "divisions")))


def contains_join(spark: SparkSession, sf: str) -> DataFrame:
    names = segmented(spark, sf).where("type = 'ORG' or type = 'LOC'").select(F.col("word").alias("name"))
    return graph.containing(names, graph.aliases_of(table(spark, sf, "divisions")))


def hierarchy_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hierarchy(table(spark, sf, "divisions"))


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.case_graph(segmented(spark, sf))[0]


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.case_graph(segmented(spark, sf))[1]


def linked_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that are left when the nodes of counties aren't there."""
    nodes, edges = graph.case_graph(segmented(spark, sf))
    return graph.link(edges, nodes.where("not contains(name, '县')"))


def digit_fold(spark: SparkSession, sf: str) -> DataFrame:
    return segmented(spark, sf).where("type = 'TIME'").select("word").distinct().select("word", X.fold_digits("word").alias("folded"))


def key_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "dump_locations").where("name is not null").select("name").distinct().select("name", X.property_key("name").alias("key"))


def short_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "divisions").select("code", "name", X.short_name("name", "level", PEOPLES).alias("made"))


def pos_map(spark: SparkSession, sf: str) -> DataFrame:
    words = segmented(spark, sf).select("word", "type").distinct()
    return words.select("word", "type", X.penn_tag("type").alias("penn"), X.tag_number("type").alias("number"), X.node_label("type").alias("label"), X.render("word", "type").alias("rendered"))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    v = table(spark, sf, "embeddings")
    probes = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("pvec"))
    return embedding.similar_to(v, "vec_id", "embedding", probes, 5)


def word2vec_vocab(spark: SparkSession, sf: str) -> DataFrame:
    sent = segmented(spark, sf).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    # words with a vector of the usual size, and its length
    return embedding.skip_gram(sent, "words").getVectors().select("word", F.size(vector_to_array("vector")).alias("n"))


def vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words with a number out of their vector: all ones where a word has none."""
    words = segmented(spark, sf).select("word").distinct()
    vectors = table(spark, sf, "tencent_word_embeddings").where("vec is not null").groupBy("word").agg(F.min("vec").alias("vec"))
    return embedding.lookup(words, vectors).select("word", F.round(F.col("vec")[0].cast("double"), 5).alias("first"), F.size("vec").alias("n"))


def position_features(spark: SparkSession, sf: str) -> DataFrame:
    full = tokens.with_sentences(segmented(spark, sf))
    words = F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])
    sent = full.groupBy(*KEYS).agg(words.alias("words")).withColumn("e1", F.element_at("words", 1)).withColumn("e2", F.element_at("words", -1))
    made = embedding.classifier_inputs(sent, "words", "e1", "e2", VOCABULARY)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return made.select(*KEYS, text("ids"), text("pos1"), text("pos2"))


def anti_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Divisions that no place word names."""
    said = segmented(spark, sf).where("type = 'LOC'").select(F.col("word").alias("name")).distinct()
    return table(spark, sf, "divisions").select("name").distinct().join(said, "name", "left_anti")


def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "train").where("case_id is not null").select("case_id", "loaded_at", "accusation")
    return graph.last_wins(t, "case_id", "loaded_at")


def ontology_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Divisions with their properties, and bare entities for typed places that no triple is about."""
    d = table(spark, sf, "divisions")
    kinds = F.array(F.struct(F.lit("level").alias("r"), F.col("level").alias("b")), F.struct(F.lit("code").alias("r"), F.col("code").alias("b")))
    triples = d.select(F.col("code").cast("long").alias("seq"), F.col("short").alias("a"), F.explode(kinds).alias("x")).select("seq", "a", "x.r", "x.b")
    typed = table(spark, sf, "dump_locations").where("name is not null").select(F.col("name").alias("pattern"), F.col("name").alias("canonical"))
    made = graph.ontology(triples, graph.aliases_of(d).unionByName(typed).distinct())
    return made.select("name", F.col("props")["code"].alias("codes"), F.size("props").alias("n"))


def search_page(spark: SparkSession, sf: str) -> DataFrame:
    return search.page(_cases(spark, sf), ["case_id", "accusation"], 96, 100)


def incremental_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and edges of lac_cut's files, upserted batch by batch; the counts of both."""
    base = scratch(spark)
    # as a glob, the path may be a file as well as a folder of files
    source = f"{sf}/lac_cut.parque[t]"
    upsert.upsert_tokens(spark, source, table(spark, sf, "lac_cut").schema, f"{base}/graph", f"{base}/state")
    nodes, edges = spark.read.parquet(f"{base}/graph/nodes"), spark.read.parquet(f"{base}/graph/edges")
    return nodes.groupBy("label").count().withColumnRenamed("label", "kind").unionByName(edges.groupBy("type").count().withColumnRenamed("type", "kind"))


def _keywords(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return graph.keyword_graph(table(spark, sf, "train").select("case_id", "fact"), "fact", search.parse_rules(RULES))


def keyword_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _keywords(spark, sf)[1]


def keyword_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _keywords(spark, sf)[0]


def place_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Courts of the places in the cases, within the divisions that their names hold."""
    places = graph.case_graph(segmented(spark, sf))[0].where("label = 'Location'")
    nodes = places.select(F.lit("Organization").alias("label"), F.concat("name", F.lit("人民法院")).alias("name"))
    return graph.place_edges(nodes, graph.aliases_of(table(spark, sf, "divisions"))).where("src_label = 'Organization'")


def place_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the cases and the division that each is."""
    nodes = graph.case_graph(segmented(spark, sf))[0]
    return graph.place_edges(nodes, graph.aliases_of(table(spark, sf, "divisions"))).where("src_label = 'Location'")


def _accepted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tok = _stored_tokens(spark, sf, "word", "type")
    found = _matches(tok).select(*KEYS, "a_idx", "r_idx", "b_idx")
    return graph.relation_graph(found, tok, KEYS)


def relation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that the matched relations add to the graph."""
    return _accepted(spark, sf)[1]


def relation_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _accepted(spark, sf)[0]


def node_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    tok = materialize(tree_tokens(spark, sf).withColumn("penn", X.penn_tag("type")))
    return graph.node_prefixes(tok.join(tokens.prefixes(tok, KEYS), [*KEYS, "idx"]), ["case_id", "sent_id", "idx"])


def merged_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Typed places merged into the divisions: a place that is there takes the typed short form, the rest stays."""
    d = table(spark, sf, "divisions").select("name", "short", F.col("code").alias("seen"))
    typed = table(spark, sf, "dump_locations").where("name is not null").select("name", "short", F.lit("typed").alias("seen"))
    return graph.merge_nodes(d, typed, ["name"], ["short"])


def ontology_build(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the three division levels, written as CSV files with headers and read again."""
    base, d = scratch(spark), table(spark, sf, "divisions")
    frames = []
    for level, cols in (("ProvinceName", ["code", "name"]), ("CityName", ["code", "name", "provinceCode"]), ("AreaName", ["code", "name", "cityCode", "provinceCode"])):
        own = d.where(F.col("level") == level).select("code", "name", F.col("province_code").alias("provinceCode"), F.col("city_code").alias("cityCode")).select(*cols)
        own.write.option("header", True).csv(f"{base}/{level}")
        frames.append(readers.csv_table(spark, f"{base}/{level}", own.schema))
    return graph.ontology_of(*frames, PEOPLES)[0]


def ontology_targets(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "divisions").select("level", "code", "name", F.col("province_code").alias("provinceCode"), F.col("city_code").alias("cityCode"))
    level = lambda n: d.where(F.col("level") == n).drop("level")
    return graph.ontology_of(level("ProvinceName"), level("CityName"), level("AreaName"), PEOPLES)[1]


STORE = ["(r)<-[:nsubj]-(a),(r)<-[:dobj]-(b)", "(b)<-[:appos]-(a) ?is"]


def induced_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of the matched relations, written as the store has them."""
    tok = _stored_tokens(spark, sf)
    found = _matches(tok).select(*KEYS, "a_idx", "r_idx", "b_idx")
    store = spark.createDataFrame([(p, 3) for p in STORE], "pattern string, frequency long")
    return trees.induce_relations(tok, found, KEYS, store)


def pattern_store(spark: SparkSession, sf: str) -> DataFrame:
    """The store after the round: its frequencies and those of the induced patterns, written as JSON and read again."""
    path = scratch(spark)
    store = spark.createDataFrame([(p, 3) for p in STORE], "pattern string, frequency long")
    writers.json_lines(trees.restock(store, induced_patterns(spark, sf)), path, append=False)
    return readers.json_lines(spark, path, schemas.PATTERN).where("_corrupt is null and frequency > 2").select("pattern", "frequency")


def string_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures between the typed name and short form of places: indel ratio, longest common substring, ratio without a common end, common characters."""
    t = table(spark, sf, "dump_locations").where("length(name) > 0 and length(short) > 0").select("name", "short").distinct()
    return t.select(
        "name", "short", F.round(X.indel_ratio("name", "short"), 9).alias("ratio"), X.common_substring("name", "short").alias("common"),
        F.round(X.related_ratio("name", "short"), 9).alias("related"), F.round(X.jaccard(X.chars(F.col("name")), X.chars(F.col("short"))), 9).alias("jaccard"),
    )


def without_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "train").select("case_id", X.strip_breaks("fact").alias("fact")).distinct()


def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and recall of the rule that a candidate to the right of its head is a relation."""
    rows = label_join(spark, sf).withColumn("prediction", (F.col("a_idx") % 4 < 2).cast("int"))
    return relations.accuracy(rows).select(F.round("accuracy", 9).alias("accuracy"), F.round("recall", 9).alias("recall"))


def subject_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Triples about one subject."""
    t = table(spark, sf, "divisions").select(F.col("name").alias("a"), F.col("level").alias("r"), F.col("short").alias("b"))
    return t.where("a = '新城区'")


def usable_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return search.usable_aliases(table(spark, sf, "dump_locations").select(F.col("short").alias("pattern"), F.col("name").alias("canonical")).distinct(), ["县", "新城"])


def feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The features that hold no distance."""
    return relations.without_distances(relation_features(spark, sf), [*KEYS, "a_idx", "r_idx", "b_idx"])


def queries() -> dict:
    """All queries of this module by name."""
    own = [
        keyword_search, triple_search, line_count, keyword_rules, tfidf_topk, tf_topk, class_lists, first_n_per_class_shard, sampled_frequencies, sentence_split, token_offsets, gap_commas,
        run_grouping, prefix_concat, tree_edges, path_match_ab, path_match_arb, lca_patterns, pattern_frequency, relation_features, token_display, tag_records, tree_text, relation_decode, confirmed_relations, label_join, classifier_gate, indel_align_top1, contains_join,
        hierarchy_links, graph_nodes, graph_edges, linked_edges, digit_fold, key_sanitize, short_name, pos_map, cosine_topk, word2vec_vocab, vector_lookup, position_features, anti_targets, last_wins,
        ontology_dump, search_page, incremental_upsert, keyword_edges, keyword_nodes, place_edges, place_alignment, relation_edges, relation_nodes, node_prefixes, merged_nodes, ontology_build, ontology_targets,
        induced_patterns, pattern_store, string_measures, without_breaks, label_accuracy, subject_scan, usable_aliases, feature_projection,
    ]
    return {f.__name__: f for f in own} | {"tf_by_class": frequencies}


TOK = """t0 AS (SELECT DISTINCT case_id, pos, word, type FROM lac_cut WHERE case_id IS NOT NULL AND word IS NOT NULL AND word <> '')"""
SENT = TOK + """, t1 AS (SELECT *, CAST(coalesce(sum(CASE WHEN word IN ('。','！','？','!','?') THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS sent_id FROM t0),
    t2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, sent_id ORDER BY pos) AS INTEGER) AS idx FROM t1)"""
TREE = SENT + """, tok AS (SELECT *, CAST(idx // 2 AS INTEGER) AS head, ['nsubj','dobj','appos','conj','nmod:tmod'][length(word) % 5 + 1] AS dep FROM t2)"""
CLASSES = "c AS (SELECT DISTINCT case_id, accusation FROM (SELECT case_id, unnest(meta.accusation) AS accusation FROM train WHERE case_id IS NOT NULL) WHERE accusation IS NOT NULL)"
NAMED = "k AS (SELECT case_id, word || type AS term FROM t0 WHERE type IS NOT NULL AND NOT contains('mcfqurxcpwTIMEPERLOCORG', type))"
FREQ = f"WITH {TOK}, {CLASSES}, {NAMED}, f AS (SELECT accusation, term, count(*) AS cnt FROM k JOIN c USING (case_id) GROUP BY 1, 2)"
CASES = "SELECT DISTINCT case_id, accusation FROM train WHERE case_id IS NOT NULL AND accusation IS NOT NULL"
SAMPLE = f"SELECT accusation, case_id % 6 AS shard, case_id, CAST(row_number() OVER (PARTITION BY accusation, case_id % 6 ORDER BY case_id) AS INTEGER) AS rn FROM ({CASES}) QUALIFY rn <= 10"
ALIASES = "al AS (SELECT short AS pattern, name AS canonical FROM divisions UNION SELECT name, name FROM divisions)"
AB_SQL = "ab AS (SELECT DISTINCT b.case_id, b.sent_id, a.idx AS a_idx, -1 AS r_idx, b.idx AS b_idx FROM tok b JOIN tok a ON a.case_id = b.case_id AND a.sent_id = b.sent_id AND a.head = b.idx AND a.dep = 'appos')"
ARB_SQL = """arb AS (SELECT DISTINCT r.case_id, r.sent_id, a.idx AS a_idx, r.idx AS r_idx, b.idx AS b_idx FROM tok r
    JOIN tok a ON a.case_id = r.case_id AND a.sent_id = r.sent_id AND a.head = r.idx AND a.dep = 'nsubj'
    JOIN tok b ON b.case_id = r.case_id AND b.sent_id = r.sent_id AND b.head = r.idx AND b.dep = 'dobj' WHERE a.idx <> b.idx)"""
PAIRS = "p AS (SELECT case_id, sent_id, lag(idx) OVER (PARTITION BY case_id, sent_id ORDER BY idx) AS a_idx, idx AS b_idx FROM tok WHERE type = 'PER' QUALIFY a_idx IS NOT NULL)"
LCA = f"""WITH RECURSIVE {TREE}, {PAIRS}, seed AS (SELECT DISTINCT case_id, sent_id, unnest([a_idx, b_idx]) AS idx FROM p),
    up AS (SELECT case_id, sent_id, idx, idx AS anc, 0 AS steps, CAST([] AS VARCHAR[]) AS ups FROM seed
      UNION ALL SELECT u.case_id, u.sent_id, u.idx, t.head, u.steps + 1, list_append(u.ups, t.dep) FROM up u JOIN tok t ON t.case_id = u.case_id AND t.sent_id = u.sent_id AND t.idx = u.anc WHERE t.head > 0),
    m AS (SELECT p.*, l.ups AS lu, r.ups AS ru, row_number() OVER (PARTITION BY p.case_id, p.sent_id, p.a_idx, p.b_idx ORDER BY l.steps + r.steps) AS k FROM p
      JOIN up l ON l.case_id = p.case_id AND l.sent_id = p.sent_id AND l.idx = p.a_idx
      JOIN up r ON r.case_id = p.case_id AND r.sent_id = p.sent_id AND r.idx = p.b_idx AND r.anc = l.anc),
    lca AS (SELECT case_id, sent_id, a_idx, b_idx, '(a)' || array_to_string(list_concat(list_transform(lu, lambda d: '-[:' || d || ']->'), list_transform(list_reverse(ru), lambda d: '<-[:' || d || ']-')), '()') || '(b)' AS pattern FROM m WHERE k = 1)"""
TAGS = ", ".join(f"('{k}', '{v}', {X.TAG_NUMBER.get(k, X.OTHER_TAG)})" for k, v in X.PENN.items())
NUMBERS = f"n AS (SELECT * FROM (VALUES {TAGS}) AS v(tag, penn, number))"
LABELLED = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LABEL.items()) + " ELSE 'Entity' END"
KIND = "CASE WHEN contains(type, 'LOC') THEN 'Location' WHEN contains(type, 'PER') THEN 'Person' WHEN contains(type, 'ORG') THEN 'Organization' WHEN contains(type, 'TIME') THEN 'Time' END"
REL = "CASE label WHEN 'Location' THEN '地理位于' WHEN 'Person' THEN '人物' WHEN 'Organization' THEN '相关组织' ELSE '相关时间' END"
GRAPH = f"""WITH {TOK}, g AS (SELECT DISTINCT 'Case' || case_id AS cn, word, {KIND} AS label FROM t0 WHERE label IS NOT NULL),
    d AS (SELECT cn, label, CASE WHEN label = 'Person' THEN word || '_' || cn ELSE word END AS name FROM g),
    x AS (SELECT cn, translate(word, '零一二三四五六七八九十', '01234567891') AS t FROM g WHERE label = 'Time'),
    q AS (SELECT cn, regexp_extract_all(t, '[0-9]{{4}}年') AS y, regexp_extract_all(t, '[0-9]{{1,2}}月') AS m, regexp_extract_all(t, '[0-9]{{4}}年[0-9]{{1,2}}月') AS ym FROM x),
    z AS (SELECT cn, unnest(y) AS name, 'Year' AS label FROM q UNION ALL SELECT cn, unnest(m), 'Month' FROM q UNION ALL SELECT cn, unnest(ym), 'YearMonth' FROM q),
    i AS (SELECT DISTINCT ym, part, kind FROM (SELECT ym, unnest(y) AS part, 'Year' AS kind FROM (SELECT unnest(ym) AS ym, y FROM q) UNION ALL SELECT ym, unnest(m), 'Month' FROM (SELECT unnest(ym) AS ym, m FROM q)) WHERE contains(ym, part))"""
EDGES = GRAPH + f""" SELECT 'LegalCase' AS src_label, cn AS src, {REL} AS type, label AS dst_label, name AS dst FROM d UNION SELECT 'LegalCase', cn, '相关时间', label, name FROM z
    UNION SELECT 'YearMonth', ym, '相关时间', kind, part FROM i"""


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two non-empty strings: rows of the table folded over the characters of a."""
    equal = f"list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({b}) + 1), lambda j: CASE WHEN {a}[i] = {b}[j] THEN 1 ELSE 0 END))"
    best = "list_max(list_transform(range(1, m + 1), lambda k: greatest(o[k], CASE WHEN k > 1 THEN o[k - 1] ELSE 0 END + e[k])))"
    return f"list_reduce(list_prepend(list_transform(range(1, length({b}) + 1), lambda z: 0), {equal}), lambda o, e: list_transform(range(1, length({b}) + 1), lambda m: {best}))[-1]"


def ratio_sql(a: str, b: str) -> str:
    return f"((length({a}) + length({b}) - 2 * {lcs_sql(a, b)}) / greatest(least(length({a}), length({b})), 1))"


def _aligned(names: str) -> str:
    """Tables that end in best: the nearest alias of each of the names, where strings that may align share a character or two."""
    return f"""{ALIASES}, a AS ({names}), p AS (SELECT DISTINCT pattern FROM al WHERE length(pattern) > 0),
        ac AS (SELECT DISTINCT name, unnest(string_split(name, '')) AS c FROM a), pc AS (SELECT DISTINCT pattern, unnest(string_split(pattern, '')) AS c FROM p),
        m AS (SELECT name, pattern FROM ac JOIN pc USING (c) GROUP BY 1, 2 HAVING abs(length(name) - length(pattern)) <= 0.5 * least(length(name), length(pattern)) AND (count(*) >= 2 OR length(name) = 1 OR length(pattern) = 1 OR len(list_distinct(string_split(name, ''))) < length(name) OR len(list_distinct(string_split(pattern, ''))) < length(pattern))),
        s AS (SELECT name, canonical, {ratio_sql('name', 'pattern')} AS score FROM m JOIN al USING (pattern) WHERE canonical <> name),
        best AS (SELECT name, canonical, score FROM s WHERE score <= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score, canonical) = 1)"""


NODES = GRAPH + " SELECT label, name, 'legalCase' AS subgraph FROM (SELECT 'LegalCase' AS label, 'Case' || case_id AS name FROM t0 UNION SELECT label, name FROM d UNION SELECT label, name FROM z)"
RULES_SQL = "(VALUES ('手机尾号[0-9]{4}', '尾号'), ('自愿认罪', '自愿认罪'), ('另案处理', '另案'), ('绰号“[^”]+”', '绰号')) AS r(p, hit)"
LABELS = f"WITH {TREE}, {AB_SQL}, lab AS (SELECT ab.*, CASE WHEN t.type = 'n' AND t.head = ab.b_idx THEN 1 ELSE 0 END AS label FROM ab JOIN tok t ON t.case_id = ab.case_id AND t.sent_id = ab.sent_id AND t.idx = ab.a_idx)"
RELATED = f"""WITH {TREE}, {AB_SQL}, {ARB_SQL}, u AS (SELECT *, {LABELLED} AS lb, 'Case' || case_id AS cn, CASE WHEN type = 'PER' THEN word || '_Case' || case_id ELSE word END AS nm FROM tok), r AS (SELECT * FROM ab UNION ALL SELECT * FROM arb),
    rel AS (SELECT a.cn, a.lb AS la, a.nm AS na, b.lb AS lb, b.nm AS nb, CASE WHEN r_idx = -1 THEN 'is' ELSE t.word END AS rw FROM r JOIN u a ON (a.case_id, a.sent_id, a.idx) = (r.case_id, r.sent_id, r.a_idx)
      JOIN u b ON (b.case_id, b.sent_id, b.idx) = (r.case_id, r.sent_id, r.b_idx) LEFT JOIN u t ON (t.case_id, t.sent_id, t.idx) = (r.case_id, r.sent_id, r.r_idx))"""
MADE = """WITH b AS (SELECT *, CASE level WHEN 'ProvinceName' THEN 0 WHEN 'CityName' THEN 1 ELSE 2 END AS rank, regexp_replace(name, CASE level WHEN 'ProvinceName' THEN '(自治区|省|市)$' WHEN 'CityName' THEN '(自治州|地区|市)$' ELSE '(自治县|市|县)$' END, '') AS s FROM divisions),
    c AS (SELECT *, CASE WHEN s = '' THEN name ELSE s END AS s2 FROM b), m AS (SELECT *, CASE WHEN s2 = '内蒙古' OR regexp_replace(s2, '(岚族|泽族)+$', '') = '' THEN s2 ELSE regexp_replace(s2, '(岚族|泽族)+$', '') END AS made FROM c)"""
NOISE = X.KEY_NOISE.replace("'", "''")


def oracle_sql() -> dict:
    """SQL of the queries above; the classifier has none."""
    masked = "CASE WHEN x = words[1] THEN 4 WHEN x = words[-1] THEN 5 WHEN x = '被告人' THEN 1 WHEN x = '，' THEN 2 WHEN x = '。' THEN 3 ELSE 0 END"

    def positions(entity: str) -> str:
        at = f"(len(words) - list_position(list_reverse(words), {entity}))"
        return f"array_to_string(list_resize(list_transform(range(0, len(words)), lambda i: CAST(least(greatest(i - {at} + 60, 0), 120) AS INTEGER)), 121, 120), ',')"

    return {
        "keyword_search": "SELECT case_id, coalesce(array_to_string(meta.accusation, ';'), '') AS classes FROM train WHERE contains(fact, '手机') AND NOT list_has_any(coalesce(meta.accusation, []), ['醉酒驾车'])",
        "triple_search": "SELECT name AS a, level AS r, short AS b FROM divisions WHERE contains(name, '竹') OR contains(level, '竹') OR contains(short, '竹')",
        "line_count": "SELECT count(*) AS n FROM documents WHERE contains(text, '被告人')",
        "keyword_rules": "SELECT DISTINCT case_id, hit FROM train, (VALUES ('手机尾号[0-9]{4}', '尾号'), ('自愿认罪', '自愿认罪'), ('另案处理', '另案'), ('绰号“[^”]+”', '绰号')) AS r(p, hit) WHERE regexp_matches(fact, p)",
        "tf_by_class": FREQ + " SELECT * FROM f",
        "tfidf_topk": FREQ + """, t AS (SELECT accusation, sum(cnt) AS total FROM f GROUP BY 1), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
            SELECT accusation, term, cnt, df, round(cnt / total * ln((SELECT count(*) FROM t) / df), 9) AS score FROM f JOIN t USING (accusation) JOIN d USING (term) ORDER BY score DESC, term DESC, accusation DESC LIMIT 200""",
        "tf_topk": FREQ + " SELECT term, CAST(sum(cnt) AS BIGINT) AS cnt FROM f GROUP BY 1 ORDER BY cnt DESC, term DESC LIMIT 100",
        "class_lists": FREQ + " SELECT term, string_agg(accusation, ';' ORDER BY accusation) AS classes, count(*) AS df FROM f GROUP BY 1",
        "first_n_per_class_shard": SAMPLE,
        "sampled_frequencies": f"WITH {TOK}, {CLASSES}, {NAMED}, s AS (SELECT DISTINCT case_id FROM ({SAMPLE})) SELECT accusation, term, count(*) AS cnt FROM k JOIN c USING (case_id) WHERE case_id IN (SELECT case_id FROM s) GROUP BY 1, 2",
        "sentence_split": f"WITH {SENT} SELECT case_id, sent_id, count(*) AS n_tokens, string_agg(word, '' ORDER BY idx) AS text FROM t2 GROUP BY 1, 2 HAVING bool_or(word IN ('。','！','？','!','?'))",
        "token_offsets": f"WITH {TOK} SELECT case_id, pos, word, CAST(coalesce(sum(length(word)) OVER w, 0) AS INTEGER) AS begin_at, CAST(coalesce(sum(length(word)) OVER w, 0) + length(word) - 1 AS INTEGER) AS end_at FROM t0 WINDOW w AS (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "gap_commas": f"WITH {TOK}, k AS (SELECT case_id, pos, lag(pos) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM t0 WHERE word NOT IN ('，', ',', '、')) SELECT case_id, CAST(unnest(range(b + 1, pos)) AS INTEGER) AS missing FROM k WHERE pos > b + 1",
        "run_grouping": """WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM e) SELECT user_id, run, event_type, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM r GROUP BY 1, 2, 3""",
        "prefix_concat": f"WITH {TREE}, {NUMBERS} SELECT case_id, sent_id, head AS idx, string_agg(word, '|' ORDER BY idx DESC) || '|' AS prefix FROM tok JOIN n ON tok.type = n.tag WHERE head > 0 AND penn NOT IN ('PU', 'P', 'U', '') GROUP BY 1, 2, 3",
        "tree_edges": f"""WITH {TREE}, e AS (SELECT c.case_id, c.sent_id, c.head, c.idx, c.dep, CASE WHEN c.head = 0 THEN '[ROOT]' ELSE h.word END AS head_word, c.word FROM tok c LEFT JOIN tok h ON h.case_id = c.case_id AND h.sent_id = c.sent_id AND h.idx = c.head WHERE c.head = 0 OR h.idx IS NOT NULL)
            SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY case_id, sent_id, head_word, dep, word ORDER BY idx) = 1""",
        "path_match_ab": f"WITH {TREE}, {AB_SQL} SELECT * FROM ab",
        "path_match_arb": f"WITH {TREE}, {ARB_SQL} SELECT * FROM arb",
        "lca_patterns": LCA + " SELECT * FROM lca",
        "pattern_frequency": LCA + " SELECT pattern, count(*) AS frequency FROM lca GROUP BY 1 HAVING count(*) >= 3",
        "relation_features": f"""WITH {TREE}, {ARB_SQL}, {NUMBERS}, u AS (SELECT tok.*, coalesce(number, 99) AS num FROM tok LEFT JOIN n ON tok.type = n.tag),
            s AS (SELECT a.case_id, a.sent_id, a_idx, r_idx, b_idx, bool_or(t.word IN ('，', ',', '、')) AS comma, bool_or(t.word IN ('。','！','？','!','?')) AS stop FROM arb a LEFT JOIN tok t ON t.case_id = a.case_id AND t.sent_id = a.sent_id AND t.idx > least(a_idx, r_idx, b_idx) AND t.idx < greatest(a_idx, r_idx, b_idx) GROUP BY 1, 2, 3, 4, 5)
            SELECT s.case_id, s.sent_id, a_idx, r_idx, b_idx, a.num AS pos_a, r.num AS pos_r, b.num AS pos_b, abs(r_idx - a_idx) AS ra, CASE WHEN r_idx > a_idx THEN 1 ELSE -1 END AS ra_sign, abs(b_idx - r_idx) AS br, CASE WHEN b_idx > r_idx THEN 1 ELSE -1 END AS br_sign,
              abs(b_idx - a_idx) AS ba, CASE WHEN b_idx > a_idx THEN 1 ELSE -1 END AS ba_sign, CAST(coalesce(comma, false) AS INTEGER) AS comma, CASE WHEN stop THEN 1 ELSE -1 END AS stop
            FROM s JOIN u a ON (a.case_id, a.sent_id, a.idx) = (s.case_id, s.sent_id, a_idx) JOIN u r ON (r.case_id, r.sent_id, r.idx) = (s.case_id, s.sent_id, r_idx) JOIN u b ON (b.case_id, b.sent_id, b.idx) = (s.case_id, s.sent_id, b_idx)""",
        "label_join": LABELS + " SELECT * FROM lab",
        "label_accuracy": LABELS + " SELECT round(avg(CASE WHEN (a_idx % 4 < 2) = (label = 1) THEN 1.0 ELSE 0 END), 9) AS accuracy, round(avg(CASE WHEN label = 1 THEN CASE WHEN a_idx % 4 < 2 THEN 1.0 ELSE 0 END END), 9) AS recall FROM lab",
        "token_display": f"WITH {TREE}, w AS (SELECT case_id, sent_id, map(list(idx), list(word)) AS words FROM tok GROUP BY 1, 2) SELECT c.case_id, c.sent_id, c.idx, c.word || '(' || c.idx || coalesce(c.type, '') || '->' || coalesce(words[c.head], 'PUNC') || ')' AS line FROM tok c JOIN w ON w.case_id = c.case_id AND w.sent_id = c.sent_id",
        "feature_projection": f"""WITH {TREE}, {ARB_SQL}, {NUMBERS}, u AS (SELECT tok.*, coalesce(number, 99) AS num FROM tok LEFT JOIN n ON tok.type = n.tag)
            SELECT s.case_id, s.sent_id, a_idx, r_idx, b_idx, a.num AS pos_a, r.num AS pos_r, b.num AS pos_b, CASE WHEN b_idx > r_idx THEN 1 ELSE -1 END AS br_sign
            FROM arb s JOIN u a ON (a.case_id, a.sent_id, a.idx) = (s.case_id, s.sent_id, a_idx) JOIN u r ON (r.case_id, r.sent_id, r.idx) = (s.case_id, s.sent_id, r_idx) JOIN u b ON (b.case_id, b.sent_id, b.idx) = (s.case_id, s.sent_id, b_idx)""",
        "tree_text": f"""WITH RECURSIVE {TREE}, tp AS (SELECT case_id, sent_id, idx, dep, word, [idx] AS path FROM tok WHERE head = 0
              UNION ALL SELECT t.case_id, t.sent_id, t.idx, t.dep, t.word, list_append(tp.path, t.idx) FROM tok t JOIN tp ON t.case_id = tp.case_id AND t.sent_id = tp.sent_id AND t.head = tp.idx),
            o AS (SELECT *, len(path) - coalesce(len(lead(path) OVER (PARTITION BY case_id, sent_id ORDER BY path)), 1) + 1 AS closing FROM tp)
            SELECT case_id, sent_id, '(ROOT:[ROOT] ' || string_agg('(' || dep || ':' || word || ' ' || repeat(')', CAST(closing AS BIGINT)), '' ORDER BY path) || ')' AS tree FROM o GROUP BY 1, 2""",
        "tag_records": f"WITH {TOK} SELECT case_id, pos, word, type, CAST(coalesce(sum(length(word)) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, CAST(length(word) AS INTEGER) AS length FROM t0",
        "relation_decode": f"WITH {TREE} SELECT case_id, sent_id, idx AS a_idx, CASE idx % 3 WHEN 0 THEN -1 ELSE -5 END AS r_idx, -10 AS b_idx FROM tok WHERE type = 'PER' AND idx % 3 < 2",
        "confirmed_relations": f"WITH {TREE}, {ARB_SQL} SELECT * FROM arb WHERE a_idx % 3 <> 0 UNION SELECT case_id, sent_id, b_idx, r_idx, a_idx FROM arb WHERE a_idx % 3 = 0",
        "contains_join": f"WITH {TOK}, {ALIASES}, o AS (SELECT DISTINCT word AS name FROM t0 WHERE type IN ('ORG', 'LOC')) SELECT DISTINCT name, canonical FROM o JOIN al ON contains(name, pattern) WHERE pattern <> ''",
        "hierarchy_links": "SELECT DISTINCT d.code, d.name, d.level, p.name AS parent, p.level AS parent_level FROM divisions d JOIN divisions p ON p.code = coalesce(d.city_code, d.province_code)",
        "graph_nodes": NODES,
        "graph_edges": EDGES,
        "linked_edges": f"SELECT * FROM ({EDGES}) WHERE NOT contains(src, '县') AND NOT contains(dst, '县')",
        "digit_fold": f"WITH {TOK} SELECT DISTINCT word, translate(word, '零一二三四五六七八九十', '01234567891') AS folded FROM t0 WHERE type = 'TIME'",
        "key_sanitize": f"SELECT DISTINCT name, translate(CASE WHEN regexp_matches(name, '^[0-9]') THEN '_' || name ELSE name END, '{NOISE}', '') AS key FROM dump_locations WHERE name IS NOT NULL",
        "short_name": """WITH b AS (SELECT code, name, level, regexp_replace(name, CASE level WHEN 'ProvinceName' THEN '(自治区|省|市)$' WHEN 'CityName' THEN '(自治州|地区|市)$' ELSE '(自治县|市|县)$' END, '') AS s FROM divisions),
            c AS (SELECT code, name, CASE WHEN s = '' THEN name ELSE s END AS s FROM b) SELECT code, name, CASE WHEN s = '内蒙古' OR regexp_replace(s, '(岚族|泽族)+$', '') = '' THEN s ELSE regexp_replace(s, '(岚族|泽族)+$', '') END AS made FROM c""",
        "pos_map": f"WITH {TOK}, {NUMBERS} SELECT DISTINCT word, type, penn, CAST(coalesce(number, 99) AS INTEGER) AS number, {LABELLED} AS label, CASE WHEN coalesce(penn, '') = '' THEN word ELSE word || '/' || penn END AS rendered FROM t0 LEFT JOIN n ON t0.type = n.tag",
        "cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT p.vec_id AS probe, v.vec_id, list_cosine_similarity(v.e, p.e) AS c FROM v, v p WHERE p.vec_id % 50 = 0 AND v.vec_id <> p.vec_id)
            SELECT probe, vec_id, round(c, 6) AS cosine, CAST(row_number() OVER (PARTITION BY probe ORDER BY round(c, 9) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
        "word2vec_vocab": f"WITH {TOK} SELECT word, 200 AS n FROM t0 GROUP BY 1 HAVING count(*) >= 10",
        "vector_lookup": f"WITH {TOK}, v AS (SELECT word, min(vec) AS vec FROM tencent_word_embeddings WHERE vec IS NOT NULL GROUP BY 1) SELECT DISTINCT t0.word, round(CAST(coalesce(vec[1], 1) AS DOUBLE), 5) AS first, CAST(coalesce(len(vec), 200) AS INTEGER) AS n FROM t0 LEFT JOIN v ON t0.word = v.word",
        "position_features": f"WITH {SENT}, w AS (SELECT case_id, sent_id, list(word ORDER BY idx) AS words FROM t2 GROUP BY 1, 2) SELECT case_id, sent_id, array_to_string(list_resize(list_transform(words, lambda x: CAST({masked} AS INTEGER)), 121, 0), ',') AS ids, {positions('words[1]')} AS pos1, {positions('words[-1]')} AS pos2 FROM w",
        "anti_targets": f"WITH {TOK} SELECT DISTINCT name FROM divisions WHERE name NOT IN (SELECT word FROM t0 WHERE type = 'LOC')",
        "last_wins": "SELECT DISTINCT ON (case_id) case_id, loaded_at, accusation FROM train WHERE case_id IS NOT NULL ORDER BY case_id, loaded_at DESC",
        "ontology_dump": f"""WITH {ALIASES}, tg AS (SELECT * FROM al UNION SELECT name, name FROM dump_locations WHERE name IS NOT NULL), t AS (SELECT canonical, d.code, d.level FROM divisions d JOIN tg ON tg.pattern = d.short),
            f AS (SELECT canonical, string_agg(code, ';' ORDER BY CAST(code AS BIGINT)) AS codes FROM t GROUP BY 1)
            SELECT n.canonical AS name, codes, CASE WHEN codes IS NULL THEN 0 ELSE 2 END AS n FROM (SELECT DISTINCT canonical FROM tg) n LEFT JOIN f USING (canonical)""",
        "keyword_edges": f"SELECT DISTINCT 'LegalCase' AS src_label, 'Case' || case_id AS src, '监督关键短语' AS type, 'Keyword' AS dst_label, hit AS dst FROM train, {RULES_SQL} WHERE case_id IS NOT NULL AND regexp_matches(fact, p)",
        "keyword_nodes": f"SELECT DISTINCT 'Keyword' AS label, hit AS name, 'legalCase' AS subgraph FROM train, {RULES_SQL} WHERE case_id IS NOT NULL AND regexp_matches(fact, p)",
        "place_edges": f"WITH {TOK}, {ALIASES}, o AS (SELECT DISTINCT word || '人民法院' AS name FROM t0 WHERE contains(type, 'LOC')) SELECT DISTINCT 'Organization' AS src_label, name AS src, '位于' AS type, 'Location' AS dst_label, canonical AS dst FROM o JOIN al ON contains(name, pattern) WHERE pattern <> ''",
        "relation_edges": RELATED + " SELECT la AS src_label, na AS src, '相关实体' AS type, 'LegalCase' AS dst_label, cn AS dst FROM rel UNION SELECT lb, nb, '相关实体', 'LegalCase', cn FROM rel UNION SELECT la, na, rw, lb, nb FROM rel",
        "relation_nodes": RELATED + " SELECT la AS label, na AS name, 'legalCase' AS subgraph FROM rel UNION SELECT lb, nb, 'legalCase' FROM rel",
        "node_prefixes": f"""WITH {TREE}, {NUMBERS}, p AS (SELECT case_id, sent_id, head AS idx, string_agg(word, '|' ORDER BY idx DESC) || '|' AS prefix FROM tok JOIN n ON tok.type = n.tag WHERE head > 0 AND penn NOT IN ('PU', 'P', 'U', '') GROUP BY 1, 2, 3),
            k AS (SELECT *, {KIND} AS label FROM tok JOIN p USING (case_id, sent_id, idx))
            SELECT label, CASE WHEN label = 'Person' THEN word || '_Case' || case_id ELSE word END AS name, arg_max(prefix, (case_id, sent_id, idx)) AS prefix FROM k WHERE label IS NOT NULL AND label <> 'Location' GROUP BY 1, 2""",
        "merged_nodes": """WITH o AS (SELECT name, max((short, code)) AS o FROM divisions GROUP BY 1), n AS (SELECT name, max((coalesce(short, ''), short)) AS n FROM dump_locations WHERE name IS NOT NULL GROUP BY 1)
            SELECT name, CASE WHEN o IS NULL THEN n[2] ELSE coalesce(n[2], o[1]) END AS short, CASE WHEN o IS NULL THEN 'typed' ELSE o[2] END AS seen FROM o FULL JOIN n USING (name)""",
        "ontology_build": MADE + " SELECT name, arg_max(level, (rank, code)) AS type, max((rank, code))[2] AS code, arg_max(made, (rank, code)) AS short, CASE WHEN max(rank) = 0 THEN NULL ELSE arg_max(coalesce(province_code, ''), (rank, code)) END AS province_code, CASE WHEN max(rank) < 2 THEN NULL ELSE arg_max(coalesce(city_code, ''), (rank, code)) END AS city_code FROM m GROUP BY 1",
        "ontology_targets": MADE + " SELECT pattern, arg_max(name, (rank, code)) AS canonical FROM (SELECT made AS pattern, name, rank, code FROM m UNION ALL SELECT name, name, rank, code FROM m) GROUP BY 1",
        "induced_patterns": f"WITH {TREE}, {AB_SQL}, {ARB_SQL} SELECT *, '(b)<-[:appos]-(a) ?is' AS pattern FROM ab UNION ALL SELECT *, '(r)<-[:nsubj]-(a),(r)<-[:dobj]-(b)' FROM arb",
        "pattern_store": f"WITH {TREE}, {AB_SQL}, {ARB_SQL} SELECT '(b)<-[:appos]-(a) ?is' AS pattern, 3 + (SELECT count(*) FROM ab) AS frequency UNION ALL SELECT '(r)<-[:nsubj]-(a),(r)<-[:dobj]-(b)', 3 + (SELECT count(*) FROM arb)",
        "without_breaks": "SELECT DISTINCT case_id, replace(replace(fact, chr(13) || chr(10), ''), chr(10), '') AS fact FROM train",
        "string_measures": f"""WITH t AS (SELECT DISTINCT name, short FROM dump_locations WHERE length(name) > 0 AND length(short) > 0),
            s AS (SELECT name, short, i, n, substr(name, i, n) AS s FROM t, unnest(range(1, length(name) + 1)) AS x(i), unnest(range(1, length(name) + 1)) AS y(n) WHERE i + n <= length(name) + 1 AND contains(short, substr(name, i, n))),
            c AS (SELECT t.name, t.short, coalesce(arg_max(s, (n, -i)), '') AS common FROM t LEFT JOIN s USING (name, short) GROUP BY 1, 2),
            d AS (SELECT *, common <> '' AND ends_with(name, common) AND ends_with(short, common) AND common <> name AND common <> short AS shared FROM c),
            e AS (SELECT *, CASE WHEN shared THEN left(name, length(name) - length(common)) ELSE name END AS n2, CASE WHEN shared THEN left(short, length(short) - length(common)) ELSE short END AS s2, string_split(name, '') AS x, string_split(short, '') AS y FROM d)
            SELECT name, short, round({ratio_sql('name', 'short')}, 9) AS ratio, common, round({ratio_sql('n2', 's2')}, 9) AS related, round(len(list_distinct(list_intersect(x, y))) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM e""",
        "indel_align_top1": "WITH " + _aligned("SELECT DISTINCT name FROM dump_locations WHERE length(name) > 0") + " SELECT name, canonical, score FROM best",
        "place_alignment": f"WITH {TOK}, " + _aligned("SELECT DISTINCT word AS name FROM t0 WHERE contains(type, 'LOC')") + " SELECT 'Location' AS src_label, name AS src, 'is' AS type, 'Location' AS dst_label, canonical AS dst FROM best",
        "subject_scan": "SELECT name AS a, level AS r, short AS b FROM divisions WHERE name = '新城区'",
        "usable_aliases": "SELECT DISTINCT short AS pattern, name AS canonical FROM dump_locations WHERE short IS NOT NULL AND short NOT IN ('', '县', '新城')",
        "incremental_upsert": f"SELECT label AS kind, count(*) AS count FROM ({NODES}) GROUP BY 1 UNION ALL SELECT type, count(*) FROM ({EDGES}) GROUP BY 1",
        "search_page": f"SELECT * FROM ({CASES}) ORDER BY case_id, accusation LIMIT 100 OFFSET 96",
    }
