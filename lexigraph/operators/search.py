"""Searches and keyword rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_search(df: DataFrame, text: str, keyword: str, classes: str, exempt: list[str] | str = ()) -> DataFrame:
    """Rows whose text holds the keyword and none of whose classes is exempt (a string exempts classes within it)."""
    x = F.coalesce(F.col(classes), F.array().cast("array<string>"))
    if isinstance(exempt, str):
        barred = F.exists(x, lambda c: F.contains(F.lit(exempt), c) & (F.lit(exempt) != ""))
    elif exempt:
        barred = F.arrays_overlap(x, F.array(*[F.lit(e) for e in exempt]))
    else:
        barred = F.lit(False)
    return df.where(F.contains(F.col(text), F.lit(keyword)) & ~barred).withColumn("classes", F.array_join(x, ";"))


def triple_search(triples: DataFrame, word: str, subject_only: bool = True) -> DataFrame:
    """Triples (a, r, b) whose subject, or any part, holds the word."""
    hit = F.contains("a", F.lit(word))
    return triples.where(hit if subject_only else hit | F.contains("r", F.lit(word)) | F.contains("b", F.lit(word)))


def parse_rules(lines: list[str]) -> list[tuple[str, str]]:
    """(regex, name) pairs from rule lines: blank-separated `regex[==>name]`, a remark after #."""
    out = []
    for line in lines:
        for part in re.split(r"\s+", re.split(r"\s*#\s*", line.strip())[0]):
            bits = part.split("==>")
            if part and len(bits) <= 2:
                out.append((bits[0], bits[-1]))
    return out


def rule_hits(text: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Names of the rules that a text meets, in rule order (Java regular expressions, look-around included)."""
    t = F.col(text) if isinstance(text, str) else text
    if not rules:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(n)) for p, n in rules]), lambda x: x.isNotNull())


def usable_aliases(aliases: DataFrame, barred: list[str]) -> DataFrame:
    """Aliases that are neither null, empty nor barred."""
    return aliases.where(F.col("pattern").isNotNull() & (F.col("pattern") != "") & ~F.col("pattern").isin(*barred))


def page(df: DataFrame, order: list[str], skip: int, take: int) -> DataFrame:
    """Rows skip..skip+take in a given order (a paging operator)."""
    return df.orderBy(*order).offset(skip).limit(take)
