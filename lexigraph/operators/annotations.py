"""Annotated sentences: record conversions, display, decoding and confirming of relations, trees as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.plans.patterns import CHARACTERS, IMPLIED

# Fixed value: every part of it confirms a suggestion, the empty answer too.
YES = "YESYesyes"


def tag_records(tokens: DataFrame) -> DataFrame:
    """Tokens with begin_at and end_at (inclusive) as segmenter records: start and length."""
    rest = [c for c in tokens.columns if c not in ("begin_at", "end_at")]
    return tokens.select(*rest, F.col("begin_at").alias("start"), (F.col("end_at") - F.col("begin_at") + 1).alias("length"))


def with_punctuation(parsed: DataFrame, segmented: DataFrame, keys: list[str]) -> DataFrame:
    """Parsed tokens (keys, idx, word, head, dep) and the punctuation of the segmentation that the parser dropped, hung from 0."""
    marks = segmented.where("type = 'w'").select(*keys, "idx", "word", F.lit(0).alias("head"), F.lit("-").alias("dep"))
    return parsed.select(*keys, "idx", "word", "head", "dep").unionByName(marks.join(parsed.select(*keys, "idx"), [*keys, "idx"], "left_anti"))


def display(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """A line per token: word, index, tag and the word of its head, PUNC where that is missing."""
    heads = tokens.select(*keys, F.col("idx").alias("head"), F.col("word").alias("head_word"))
    line = F.concat("word", F.lit("("), F.col("idx").cast("string"), F.coalesce("type", F.lit("")), F.lit("->"), F.coalesce("head_word", F.lit("PUNC")), F.lit(")"))
    return tokens.join(heads, [*keys, "head"], "left").select(*keys, "idx", line.alias("line"))


def _number(value: Column, names: dict[str, int]) -> Column:
    return F.coalesce(value.try_cast("int"), F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value])


def decode(relations: DataFrame) -> DataFrame:
    """a, r, b written as indices or names to a_idx, r_idx, b_idx; relations with an unknown name drop out."""
    made = relations.withColumns({"a_idx": _number(F.col("a"), CHARACTERS), "r_idx": _number(F.col("r"), IMPLIED), "b_idx": _number(F.col("b"), CHARACTERS)})
    return made.where(F.col("a_idx").isNotNull() & F.col("r_idx").isNotNull() & F.col("b_idx").isNotNull()).drop("a", "r", "b")


def confirm(candidates: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Relations to keep: candidates whose answer confirms them or is missing, and relations entered by hand.

    answers has keys, a_idx, r_idx, b_idx, answer, entered; an entered row is a relation of its own, whatever its answer.
    """
    cols = [*keys, "a_idx", "r_idx", "b_idx"]
    asked = answers.where(~F.col("entered")).groupBy(*cols).agg(F.max("answer").alias("answer"))
    kept = candidates.select(*cols).join(asked, cols, "left").where(F.col("answer").isNull() | F.contains(F.lit(YES), F.col("answer")))
    return kept.select(*cols).unionByName(answers.where("entered").select(*cols)).distinct()


def _render(tokens: list) -> str:
    """S-expression of one sentence, children in index order; an explicit stack, as chains may be long."""
    below: dict[int, list] = {}
    for t in sorted(tokens, key=lambda t: t["idx"]):
        below.setdefault(t["head"], []).append(t)
    out = ["(ROOT:[ROOT] "]
    todo = [")", *reversed(below.get(0, []))]
    while todo:
        t = todo.pop()
        if isinstance(t, str):
            out.append(t)
            continue
        out.append(f"({t['dep']}:{t['word']} ")
        todo.append(")")
        todo.extend(reversed(below.get(t["idx"], [])))
    return "".join(out)


@F.pandas_udf(T.StringType())
def _trees(sentences: pd.Series) -> pd.Series:
    return sentences.map(lambda s: _render(list(s)))


def tree_text(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The dependency tree of each sentence as text; tokens of one sentence only are gathered."""
    rows = tokens.groupBy(*keys).agg(F.collect_list(F.struct("idx", "head", "dep", "word")).alias("s"))
    return rows.select(*keys, _trees("s").alias("tree"))
