"""Incremental graph upsert and resumable shards over file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigraph.operators import graph
from lexigraph.sources import writers


def upsert_tokens(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str) -> None:
    """Tokens that arrive as parquet files become nodes and edges; each batch appends only what isn't there yet.

    A batch that is replayed after a failure appends nothing twice, since what it wrote is found again. Tokens with a
    prefix set it anew on nodes that are there: every batch appends the prefixes it saw under its number, and
    prefixes() reads the latest.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.where(F.col("case_id").isNotNull() & (F.col("word") != ""))
        nodes, edges = graph.case_graph(df)
        writers.append_new(nodes, f"{target}/nodes", ["label", "name"])
        writers.append_new(edges, f"{target}/edges", graph.EDGE)
        if "prefix" in df.columns:
            order = [c for c in ("case_id", "sent_id", "idx", "pos") if c in df.columns]
            graph.node_prefixes(df, order).write.mode("overwrite").parquet(f"{target}/prefixes/epoch={epoch}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def prefixes(spark: SparkSession, target: str) -> DataFrame:
    """label, name and the prefix that the last batch with the node set."""
    return spark.read.parquet(f"{target}/prefixes").groupBy("label", "name").agg(F.max_by("prefix", "epoch").alias("prefix"))


def resume_shard(spark: SparkSession, source: str, schema: str, shard: int, shards: int, order: str, target: str, checkpoint: str) -> int:
    """Rows of one shard copied to target; a second call goes on where the first stopped. Returns the rows held."""
    stream = spark.readStream.schema(schema).parquet(source).where(F.pmod(F.col(order) + 1, F.lit(shards)) == shard)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target).count()
