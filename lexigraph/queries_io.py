"""Queries that write tables to files in the shared folder and read them again through the sources, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph import schemas
from lexigraph.functions import scalars as X
from lexigraph.operators import annotations, graph
from lexigraph.queries_reference import GRAPH, KEYS, TOK, TREE, segmented, tree_tokens
from lexigraph.session import scratch, table
from lexigraph.sources import readers, writers
from lexigraph.streaming import upsert

SHARDS = 6
SETTINGS = "# a remark\nport 8081\nhost localhost\na line of four\nretries -3\n"


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "train").where("fact is not null").select("case_id", X.strip_breaks("fact").alias("fact")).distinct()


def file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Facts as lines of text, with and without the line feed."""
    path = scratch(spark)
    _facts(spark, sf).select(F.col("fact").alias("value")).write.text(path)
    bare = readers.lines(spark, path).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))
    kept = readers.lines(spark, path, keep_break=True).agg(F.sum(F.length("value")).alias("with_breaks"))
    return bare.crossJoin(kept)  # one row each


def gbk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Names of divisions through a file in another encoding."""
    path = scratch(spark)
    writers.text_encoded(table(spark, sf, "divisions").where("name is not null"), "name", path, "GBK")
    return readers.lines(spark, path, "GBK").select(F.col("value").alias("name"))


def json_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles and their charges through JSON lines, appended in two parts."""
    path = scratch(spark)
    t = table(spark, sf, "train").select("fact", "meta", "case_id")
    for k in (0, 1):
        writers.json_lines(t.where(F.col("case_id") % 2 == k).drop("case_id"), path)
    read = readers.json_lines(spark, path)
    return read.where("_corrupt is null and meta is not null").select(F.explode("meta.accusation").alias("accusation")).groupBy("accusation").count()


def triples_file(spark: SparkSession, sf: str) -> DataFrame:
    """Triples through tab-separated lines; lines of another arity drop out."""
    path = scratch(spark)
    d = table(spark, sf, "divisions")
    line = F.concat_ws("\t", "name", F.when(F.col("level") != "ProvinceName", F.col("level")), "short")
    d.select(line.alias("value")).write.text(path)
    return readers.triples(spark, path)


def csv_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Divisions through CSV with a header."""
    path = scratch(spark)
    d = table(spark, sf, "divisions").select("level", "code", "name")
    d.write.option("header", True).csv(path)
    return readers.csv_table(spark, path, d.schema)


def rule_file(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword rules read from a file: names of peoples as alternatives, on the facts."""
    from lexigraph.operators import search

    path = scratch(spark)
    spark.createDataFrame([("自愿认罪==>认罪 # a remark",), ("泽族|岚族==>族",)], "value string").coalesce(1).write.text(path)
    hits = search.rule_hits("fact", search.parse_rules(readers.rule_lines(spark, path)))
    return table(spark, sf, "train").select("case_id", F.explode(hits).alias("hit")).distinct()


def embedding_file(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors through text lines of a word and its numbers, and on to the table of vectors."""
    base = scratch(spark)
    t = table(spark, sf, "tencent_word_embeddings").where("word is not null and vec is not null")
    t.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.text(f"{base}/text")
    writers.embeddings(readers.embeddings(spark, f"{base}/text"), f"{base}/table")
    return spark.read.parquet(f"{base}/table").groupBy("word").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("size"), (F.round(F.min(F.col("vec")[0].cast("double")), 5) + 0.0).alias("first"))


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Key and value of a settings file; numbers are integers."""
    return spark.createDataFrame([(k, str(v), isinstance(v, int)) for k, v in readers.settings(SETTINGS).items()], "key string, value string, number boolean")


def segmenter_records(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a case as the segmenter's wire records and back; every fiftieth word has a full stop stuck to it."""
    plain = segmented(spark, sf).where("type is not null and not word rlike '[ \\t。]' and not type rlike '[ \\\\t]'")
    stuck = F.when(F.col("pos") % 50 == 0, F.concat("word", F.lit("。"))).otherwise(F.col("word"))
    rec = F.concat_ws(" ", stuck, F.when(F.col("type") == "", "-").otherwise(F.col("type")), F.col("pos").cast("string"), F.length(stuck).cast("string"))
    # a case's tokens are bounded by its text
    wire = plain.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", rec.alias("r")))), lambda x: x["r"]), "\t").alias("wire"))
    return readers.segmented_records(wire, "wire").select("case_id", F.col("start").alias("pos"), "part", "word", "type")


def parser_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences as the parser's ten-column lines and back."""
    tok = tree_tokens(spark, sf).where("not word rlike '[\\\\t\\\\n]'")
    line = F.concat_ws("\t", F.col("idx").cast("string"), "word", F.lit("_"), F.lit("_"), F.coalesce("type", F.lit("_")), F.lit("_"), F.col("head").cast("string"), "dep", F.lit("_"), F.lit("_"))
    wire = tok.groupBy(*KEYS).agg(F.array_join(F.collect_list(line), "\n").alias("wire"))
    return readers.parser_rows(wire, "wire").select(*KEYS, "idx", "word", "pos", "head", "dep")


def redirects(spark: SparkSession, sf: str) -> DataFrame:
    """Typed short forms and the division that each is the short form of, the last by name."""
    r = table(spark, sf, "divisions").groupBy(F.col("short").alias("title")).agg(F.max("name").alias("target"))
    return readers.follow_redirects(table(spark, sf, "dump_locations").where("short is not null").select("short").distinct(), "short", r)


def line_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The words of each case as one line of text, and the words of all lines counted."""
    path = scratch(spark)
    words = segmented(spark, sf).where("not word rlike '\\\\s'").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))
    writers.line_sentences(words, "words", path)
    return readers.lines(spark, path).select(F.explode(F.split("value", " ")).alias("word")).groupBy("word").count()


def stored_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Person nodes out of the stored graph, of which only their folder is read."""
    path = scratch(spark)
    writers.graph_tables(*graph.case_graph(segmented(spark, sf)), path)
    return spark.read.parquet(f"{path}/nodes").where("label = 'Person'").select("name", "subgraph")


def stored_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of the places in the stored graph: name and short form of the nodes of the ontology."""
    path = scratch(spark)
    d = table(spark, sf, "divisions").select(F.lit("Location").alias("label"), "name", "short", F.lit("baike").alias("subgraph"))
    d.unionByName(d.limit(0)).write.partitionBy("label").parquet(path)
    return graph.aliases_of(spark.read.parquet(path).where("label = 'Location' and subgraph = 'baike'"))


def resumed_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each shard of the typed places after its worker has run twice."""
    base, source = scratch(spark), f"{sf}/dump_locations.parque[t]"
    schema = "loc_id long, name string"
    rows = [(k, upsert.resume_shard(spark, source, schema, k, SHARDS, "loc_id", f"{base}/out{k}", f"{base}/state{k}")) for k in (0, 1, 1)]
    return spark.createDataFrame(sorted(set(rows)), "shard int, n long")


def outside_segmenter(spark: SparkSession, sf: str) -> DataFrame:
    """Facts through an external process, which here counts their sentences."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"case_id": f["case_id"], "n": f["fact"].str.count("。")})

    return readers.through_process(_facts(spark, sf), run, "case_id long, n long")


def parsed_with_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a parser that leaves punctuation out, and the punctuation of the segmentation hung from 0."""
    tok = tree_tokens(spark, sf)
    return annotations.with_punctuation(tok.where("type is null or type <> 'w'"), tok, KEYS)


def annotation_records(spark: SparkSession, sf: str) -> DataFrame:
    """Words normalised from the nested records of an annotator: sentences of tokens, as JSON."""
    tok = tree_tokens(spark, sf)
    token = F.struct(F.col("idx").alias("index"), "word", F.col("type").alias("pos"))
    one = tok.groupBy(*KEYS).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    docs = one.groupBy("case_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("sent_id").alias("index"), "tokens"))).alias("sentences"))).alias("doc"))
    return readers.annotator_tokens(docs, "doc").select(*KEYS, "idx", "word", "pos")


def queries() -> dict:
    """All queries of this module by name."""
    own = [
        file_lines, gbk_lines, json_articles, triples_file, csv_dictionary, rule_file, embedding_file, settings, segmenter_records, parser_rows, redirects, line_sentences, stored_persons,
        stored_aliases, resumed_shards, outside_segmenter, parsed_with_marks, annotation_records,
    ]
    return {f.__name__: f for f in own}


FACTS = "f AS (SELECT DISTINCT case_id, replace(replace(fact, chr(13) || chr(10), ''), chr(10), '') AS fact FROM train WHERE fact IS NOT NULL)"


def oracle_sql() -> dict:
    """SQL of the queries above."""
    return {
        "file_lines": f"WITH {FACTS}, l AS (SELECT unnest(string_split(fact, chr(13))) AS v FROM f) SELECT count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS chars, CAST(sum(length(v)) + count(*) AS BIGINT) AS with_breaks FROM l",
        "gbk_lines": "SELECT name FROM divisions WHERE name IS NOT NULL",
        "json_articles": "SELECT accusation, count(*) AS count FROM (SELECT unnest(meta.accusation) AS accusation FROM train WHERE case_id IS NOT NULL) GROUP BY 1",
        "triples_file": "SELECT name AS a, level AS r, short AS b FROM divisions WHERE level <> 'ProvinceName'",
        "csv_dictionary": "SELECT level, code, name FROM divisions",
        "rule_file": "SELECT DISTINCT case_id, hit FROM train, (VALUES ('自愿认罪', '认罪'), ('泽族|岚族', '族')) AS r(p, hit) WHERE regexp_matches(fact, p)",
        "embedding_file": "SELECT left(word, 30) AS word, count(*) AS n, 200 AS size, round(min(CAST(vec[1] AS DOUBLE)), 5) + 0.0 AS first FROM tencent_word_embeddings WHERE word IS NOT NULL AND len(vec) = 200 AND NOT contains(word, ' ') GROUP BY 1",
        "settings": "SELECT * FROM (VALUES ('port', '8081', true), ('host', 'localhost', false), ('retries', '-3', true)) AS v(key, value, number)",
        "segmenter_records": f"""WITH {TOK}, k AS (SELECT case_id, pos, word, CASE WHEN type = '' THEN '-' ELSE type END AS type FROM t0 WHERE type IS NOT NULL AND NOT regexp_matches(word, '[ \t。]') AND NOT regexp_matches(type, '[ \t]'))
            SELECT case_id, pos, 0 AS part, word, type FROM k UNION ALL SELECT case_id, pos, 1, '。', 'w' FROM k WHERE pos % 50 = 0""",
        "parser_rows": f"WITH {TREE} SELECT case_id, sent_id, idx, word, coalesce(type, '_') AS pos, head, dep FROM tok WHERE NOT regexp_matches(word, '[\t\n]')",
        "redirects": "SELECT short, coalesce(target, '') AS canonical FROM (SELECT DISTINCT short FROM dump_locations WHERE short IS NOT NULL) LEFT JOIN (SELECT short AS s, max(name) AS target FROM divisions GROUP BY 1) ON s = short",
        "line_sentences": f"WITH {TOK} SELECT word, count(*) AS count FROM t0 WHERE NOT regexp_matches(word, '[\\s\\x0b]') GROUP BY 1",
        "stored_persons": GRAPH + " SELECT DISTINCT name, 'legalCase' AS subgraph FROM d WHERE label = 'Person'",
        "stored_aliases": "SELECT short AS pattern, name AS canonical FROM divisions UNION SELECT name, name FROM divisions",
        "resumed_shards": "SELECT CAST((loc_id + 1) % 6 AS INTEGER) AS shard, count(*) AS n FROM dump_locations WHERE (loc_id + 1) % 6 < 2 GROUP BY 1",
        "outside_segmenter": f"WITH {FACTS} SELECT case_id, CAST(length(fact) - length(replace(fact, '。', '')) AS BIGINT) AS n FROM f",
        "parsed_with_marks": f"WITH {TREE} SELECT case_id, sent_id, idx, word, CASE WHEN type = 'w' THEN 0 ELSE head END AS head, CASE WHEN type = 'w' THEN '-' ELSE dep END AS dep FROM tok",
        "annotation_records": f"WITH {TREE} SELECT case_id, sent_id, idx, word, type AS pos FROM tok",
    }
