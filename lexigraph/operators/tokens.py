"""Token tables: sentences, offsets, gaps, prefixes and the dependency surrogate of data that carries no parses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words that end a sentence and words that count as commas.
STOPS, COMMAS = ("。", "！", "？", "!", "?"), ("，", ",", "、")
LABELS = ("nsubj", "dobj", "appos", "conj", "nmod:tmod")


def segmented(cut: DataFrame, together: bool = False) -> DataFrame:
    """Usable tokens of a segmented table (case_id, pos, word, type), each once.

    together brings the tokens of a case into one partition first, so that windows over cases and sentences shuffle nothing more.
    """
    usable = cut.where(F.col("case_id").isNotNull() & F.col("word").isNotNull() & (F.col("word") != "")).select("case_id", "pos", "word", "type")
    return (usable.repartition("case_id") if together else usable).distinct()


def with_sentences(tokens: DataFrame) -> DataFrame:
    """sent_id from 0: the number of sentence ends before a token; idx from 1 within the sentence."""
    order = Window.partitionBy("case_id").orderBy("pos")
    ends = F.sum(F.col("word").isin(*STOPS).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sent = tokens.withColumn("sent_id", F.coalesce(ends, F.lit(0)).cast("int"))
    return sent.withColumn("idx", F.row_number().over(Window.partitionBy("case_id", "sent_id").orderBy("pos")))


def complete_sentences(tokens: DataFrame) -> DataFrame:
    """Tokens of sentences that have an end; text after the last end is dropped."""
    ended = Window.partitionBy("case_id", "sent_id")
    return tokens.withColumn("ended", F.max(F.col("word").isin(*STOPS)).over(ended)).where("ended").drop("ended")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """begin_at and end_at (inclusive) in characters: running sum of the lengths before."""
    order = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("word")).over(order), F.lit(0)).cast("int")
    return tokens.withColumn("begin_at", begin).withColumn("end_at", (F.col("begin_at") + F.length("word") - 1).cast("int"))


def surrogate_tree(tokens: DataFrame) -> DataFrame:
    """Head and label for tokens without a parse: a heap-shaped tree, labels by word length; head 0 is the root."""
    labels = F.array(*[F.lit(x) for x in LABELS])
    return tokens.withColumn("head", F.floor(F.col("idx") / 2).cast("int")).withColumn("dep", F.element_at(labels, (F.length("word") % len(LABELS)) + 1))


def gaps(tokens: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Indices missing between neighbours, one row each: dropped punctuation, read as commas."""
    before = F.lag(idx).over(Window.partitionBy(*keys).orderBy(idx))
    return tokens.select(*keys, idx, before.alias("before")).where(F.col(idx) > F.col("before") + 1).select(*keys, F.explode(F.sequence(F.col("before") + 1, F.col(idx) - 1)).alias("missing"))


def prefixes(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Dependents' words in front of their head: descending index, each followed by a bar; punctuation is left out."""
    dependents = tokens.where((F.col("head") > 0) & ~F.coalesce(F.col("penn"), F.lit("")).isin("PU", "P", "U", ""))
    # a head's dependents are bounded by its sentence
    listed = F.reverse(F.array_sort(F.collect_list(F.struct("idx", "word"))))
    joined = F.concat(F.array_join(F.transform(listed, lambda x: x["word"]), "|"), F.lit("|"))
    return dependents.groupBy(*keys, "head").agg(joined.alias("prefix")).withColumnRenamed("head", "idx")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: keys, run (from 1), value, first and last order value, n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "run", value).agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count("*").alias("n"))


def first_per_class(df: DataFrame, cls: str, order: str, shards: int, n: int) -> DataFrame:
    """The first n rows of every class in every shard of the order column (a sampling operator)."""
    shard = F.pmod(F.col(order), F.lit(shards))
    w = Window.partitionBy(cls, "shard").orderBy(order)
    return df.withColumn("shard", shard).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
