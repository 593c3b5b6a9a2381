"""Term statistics by class: frequencies, document frequency over classes, TF-IDF, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.session import broadcast_if_small, materialize

# Fixed value: tags whose rows are left out, every tag that is a part of this string.
LEFT_OUT = "mcfqurxcpwTIMEPERLOCORG"


def counted(tokens: DataFrame) -> DataFrame:
    """Tokens whose tag is not a part of LEFT_OUT; null tags are left out, empty ones too."""
    return tokens.where(F.col("type").isNotNull() & ~F.contains(F.lit(LEFT_OUT), F.col("type")))


def class_frequencies(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """Occurrences of each term (word and tag, joined) per class; a case counts for all its classes."""
    named = counted(tokens).select("case_id", F.concat("word", "type").alias("term"))
    # summed per case first: the join then meets one row per case and term
    per_case = named.groupBy("case_id", "term").agg(F.count("*").alias("n"))
    return per_case.join(classes, "case_id").groupBy("accusation", "term").agg(F.sum("n").alias("cnt"))


def tfidf(freq: DataFrame) -> DataFrame:
    """tf * ln(N / df) per (class, term): tf is the term's share of its class, df the classes with it, N all classes."""
    # one row per class: beyond a counted size the heavy classes are left to the join's skew handling
    total = broadcast_if_small(materialize(freq.groupBy("accusation").agg(F.sum("cnt").alias("total"))), 64)
    df = freq.groupBy("term").agg(F.count("*").alias("df"))
    n = total.select(F.count("*").alias("n_classes"))
    tf = F.col("cnt") / F.col("total")
    scored = freq.join(total, "accusation").join(df, "term").crossJoin(F.broadcast(n))
    return scored.select("accusation", "term", "cnt", "df", (tf * F.log(F.col("n_classes") / F.col("df"))).alias("score"))


def top(scored: DataFrame, by: str, n: int, ties: list[str], digits: int = 9) -> DataFrame:
    """The n best rows; rounding and the tie columns make the order total (a top-k report)."""
    return scored.withColumn(by, F.round(by, digits)).orderBy(F.col(by).desc(), *[F.col(t).desc() for t in ties]).limit(n)


def classes_of_terms(freq: DataFrame) -> DataFrame:
    """The classes that have each term, joined in order."""
    return freq.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("accusation")), ";").alias("classes"), F.count("*").alias("df"))
