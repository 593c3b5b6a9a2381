"""Sources: text lines, JSON lines, triples, CSV dictionaries, rule files, embeddings, parser output, settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph import schemas


def lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", keep_break: bool = False) -> DataFrame:
    """One row per line, column value; keep_break leaves the line feed at the end.

    Lines are split by byte in parallel, which is sound for UTF-8 and for encodings such as GBK that never use a line feed as a trailing
    byte; other encodings than UTF-8 are then decoded in Arrow batches, undecodable bytes as U+FFFD.
    """
    df = spark.read.text(path)
    if encoding.upper().replace("-", "") != "UTF8":

        @F.pandas_udf("string")
        def decoded(raw: pd.Series) -> pd.Series:
            return raw.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

        df = df.select(decoded(F.col("value").cast("binary")).alias("value"))
    return df.withColumn("value", F.concat("value", F.lit("\n"))) if keep_break else df


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.ARTICLE) -> DataFrame:
    """JSON lines by a declared schema; lines that don't parse are kept in _corrupt."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """a, r, b from tab-separated lines of exactly three fields; other lines drop out."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) == 3).select(*[parts[i].alias(c) for i, c in enumerate("arb")])


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and quotes, by a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def rule_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small rule file (a configuration, read on the driver)."""
    return [r["value"] for r in spark.read.text(path).collect()]


def embeddings(spark: SparkSession, path: str, dim: int = 200, word_chars: int = 30) -> DataFrame:
    """word and vec from lines of a word and dim numbers; lines of another arity drop out, words are cut."""
    parts = F.split("value", " ")
    whole = spark.read.text(path).where(F.size(parts) == dim + 1)
    return whole.select(F.substring(parts[0], 1, word_chars).alias("word"), F.transform(F.slice(parts, 2, dim), lambda x: x.try_cast("float")).alias("vec"))


def segmented_records(df: DataFrame, column: str) -> DataFrame:
    """Tokens of segmenter output: tab-separated records of `word type start length`; a 。 inside a longer word splits it.

    The part before keeps the tag, 。 becomes w, the part after BAD. Records of another arity drop out; a word of several
    。 is split at each.
    """
    rec = df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(column, "\t")).alias("rec", "r"))
    f = F.split("r", " ")
    ok = rec.where(F.size(f) == 4).select(*[c for c in rec.columns if c != "r"], f[0].alias("word"), f[1].alias("type"), f[2].try_cast("int").alias("start"), f[3].try_cast("int").alias("length"))
    split = F.when((F.length("word") > 1) & F.contains("word", F.lit("。")), F.filter(F.regexp_extract_all("word", F.lit("[^。]+|。"), F.lit(0)), lambda x: x != "")).otherwise(F.array("word"))
    parts = ok.withColumn("whole", F.col("word")).withColumn("at", F.instr("word", "。")).select(*[c for c in ok.columns if c != "word"], "at", "whole", F.posexplode(split).alias("part", "word"))
    cut = F.col("word") != F.col("whole")
    tag = F.when(cut & (F.col("word") == "。"), "w").when(cut & (F.col("at") > 0) & ((F.col("part") > 0) | (F.col("at") == 1)), "BAD").otherwise(F.col("type"))
    return parts.withColumn("type", tag).drop("at", "whole")


def parser_rows(df: DataFrame, column: str) -> DataFrame:
    """Tokens of dependency-parser output: lines of ten tab-separated columns; id, word, tag, head and label are used."""
    row = df.select(*[c for c in df.columns if c != column], F.explode(F.split(column, "\n")).alias("line"))
    f = F.split("line", "\t")
    keep = [c for c in df.columns if c != column]
    return row.where(F.size(f) == 10).select(*keep, f[0].try_cast("int").alias("idx"), f[1].alias("word"), f[4].alias("pos"), f[6].try_cast("int").alias("head"), f[7].alias("dep"))


def sentences_flat(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotated sentences (column s of schemas.SENTENCE, keys doc_id, sent_id) to flat tokens and gold relations."""
    tok = df.select("doc_id", "sent_id", F.explode("s.tokens").alias("k", "t"))
    tokens = tok.select("doc_id", "sent_id", F.col("t.index").try_cast("int").alias("idx"), "t.word", "t.pos", F.col("t.lac_pos").alias("type"), "t.dep", F.col("t.head").try_cast("int").alias("head"), "t.prefix", "t.begin", "t.end").where("idx > 0")
    rel = df.select("doc_id", "sent_id", F.explode("s.manual_relations").alias("m"))
    gold = rel.select("doc_id", "sent_id", *[F.col("m")[i].try_cast("int").alias(f"{c}_idx") for i, c in enumerate("arb")])
    return tokens, gold


def annotator_tokens(df: DataFrame, column: str) -> DataFrame:
    """Tokens of an annotator's JSON (sentences of tokens with index, word, pos): sent_id, idx, word, pos; text that is no such JSON gives no rows."""
    keep = [c for c in df.columns if c != column]
    sent = df.select(*keep, F.explode(F.from_json(column, schemas.ANNOTATED)["sentences"]).alias("s"))
    tok = sent.select(*keep, F.col("s.index").alias("sent_id"), F.explode("s.tokens").alias("t"))
    return tok.select(*keep, "sent_id", F.col("t.index").alias("idx"), "t.word", "t.pos")


def through_process(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through an external segmenter or parser: run is called once per partition, so one process serves a partition."""
    return df.mapInPandas(run, schema)


def follow_redirects(df: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """The column's canonical title by a table (title, target), empty where there is none."""
    r = redirects.select(F.col("title").alias(column), F.col("target").alias("canonical")).dropDuplicates([column])
    return df.join(r, column, "left").withColumn("canonical", F.coalesce("canonical", F.lit("")))


def settings(text: str) -> dict[str, str | int]:
    """Key and value of each line, integers where they are; # starts a remark line, lines of another shape drop out."""
    out: dict[str, str | int] = {}
    for line in text.splitlines():
        parts = line.split()
        if line.startswith("#") or len(parts) != 2:
            continue
        key, value = parts
        out[key] = int(value) if value.lstrip("+-").isdigit() else value
    return out
