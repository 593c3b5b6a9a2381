"""Sinks: JSON lines, line-sentence text, node and edge tables, embeddings, models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators import graph
from lexigraph.session import materialize


def json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def line_sentences(df: DataFrame, words: str, path: str) -> None:
    """One line per row: its words, blank-separated."""
    df.select(F.array_join(words, " ").alias("value")).write.mode("overwrite").text(path)


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes partitioned by label and edges by type, so that a lookup by label reads its folder only."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


#: Folders that a growing table is spread over by the hash of its key.
BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose key the table doesn't hold yet; only the folders that the new keys fall into are read."""
    spark = df.sparkSession
    new = materialize(df.dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")))
    if exists(spark, path):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        held = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)) if touched else None
        new = graph.new_rows(held, new, [*key, "bucket"]) if touched else new
    new.write.mode("append").partitionBy("bucket").parquet(path)


def text_encoded(df: DataFrame, column: str, path: str, encoding: str) -> None:
    """One line per value in any encoding: its bytes are written by way of the encoding that keeps every byte."""

    @F.pandas_udf("string")
    def as_bytes(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else t.encode(encoding, "replace").decode("iso-8859-1"))

    lines = df.select(as_bytes(F.col(column)).alias("value"))
    lines.write.mode("overwrite").option("encoding", "iso-8859-1").option("quote", "").option("escape", "").option("sep", "\x01").csv(path)


def embeddings(df: DataFrame, path: str) -> None:
    """Word vectors as parquet; the columnar writer batches."""
    df.select("word", "vec").write.mode("overwrite").parquet(path)


def jdbc(df: DataFrame, url: str, table: str, batch: int = 101, **options: str) -> None:
    """Rows to a database table in batches."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode("append").save()


def model(fitted, path: str) -> None:
    """A fitted Spark ML model; never pickled."""
    fitted.write().overwrite().save(path)
