"""Mapping of typed place names to a reference list.

Token-level repair: typed texts are cut into name stems at level suffixes and separators. Every distinct stem that is no
word of the reference vocabulary is joined to it by edit distance: words of up to SHORT characters meet stems in deletion
neighbourhoods (two strings within one edit share a form with at most one character deleted), longer ones by pigeonhole
(a word cut into one piece more than its edits keeps a piece whole), so both joins are equi-joins. The repaired stems are
then combined with soft TF-IDF: an entry's score is the sum, over its own name and the parents named, of inverse document
frequency times the similarity of stem and word. The best entry that keeps to the row's type and parents wins.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.session import materialize

# Level suffixes of division names.
SUFFIX = re.compile(r"[一-鿿]族自治[县州旗]|自治[区州县旗]|地区|[省市县区州]")
REMARK = re.compile(r"[(（][^)）]*[)）]")
NOISE = re.compile(r"[^\w]+|_")
#: Words of up to so many characters are repaired within one edit, longer ones within an edit for every four characters.
SHORT = 7
#: Scores that differ by less are equal: sums of the same numbers in another order.
SAME = 1e-9
#: Parts that the rows of one question are spread over when they fetch its answer.
SALT = 8
#: What is known of an entry, beside its own word.
ENTRY = ["key", "level", "province", "city", "province_word", "city_word", "idf", "province_idf", "city_idf"]


def simplified(spark: SparkSession) -> dict[int, str]:
    """Traditional to simplified characters, from the transliterator of the ICU library that Spark ships."""
    chars = [chr(c) for c in [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)]]
    rules = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    made = rules.transliterate("\n".join(chars)).split("\n")
    return {ord(a): b for a, b in zip(chars, made) if a != b}


def clean(text: str | None, table: dict[int, str]) -> str:
    """Remarks dropped, one width, simplified characters, letters and digits only."""
    if not text:
        return ""
    return NOISE.sub("", unicodedata.normalize("NFKC", REMARK.sub("", text)).translate(table))


def cuts(text: str) -> list[str]:
    """Name stems of a cleaned text, outermost first, without their level suffixes; a run without suffixes is one stem."""
    runs, at = [], 0
    for m in SUFFIX.finditer(text):
        if m.start() > at:
            runs.append(text[at : m.start()])
        at = m.end()
    return [*runs, text[at:]] if at < len(text) else runs


def readings(runs: list[str], longest: int) -> list[tuple[str, list[str]]]:
    """(own stem, stems before it): every end of the last run may be the own name, and what it leaves belongs to the parents.

    Ends, and what they leave, have two characters or more; ends beyond `longest` characters are within reach of no word.
    """
    *before, last = runs
    n = len(last)
    out = [(last, before)] if n <= longest else []
    return out + [(last[i:], [*before, last[:i]]) for i in range(max(2, n - longest), n - 1)]


def edits(a: str, b: str, swaps: bool = True) -> int:
    """Edit distance; with swaps, two neighbours that change places count once."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def budget(n: int) -> int:
    """Edits that a word of n characters bears."""
    return 1 if n <= SHORT else n // 4


@lru_cache(maxsize=1 << 16)
def similar(stem: str, word: str) -> float:
    """Similarity of a stem to a word within its budget: the mean of the shares of unedited and of common characters; else 0."""
    if stem == word:
        return 1.0
    n = len(word)
    if abs(len(stem) - n) > budget(n) or edits(stem, word, n <= SHORT) > budget(n):
        return 0.0
    common = sum((Counter(stem) & Counter(word)).values())
    return (1 - edits(stem, word) / max(len(stem), n) + 2 * common / (len(stem) + n)) / 2


def forms(word: str) -> list[str]:
    """The word, each form with one character deleted, and, for swaps, its sorted characters."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) > 1), "\x00" + "".join(sorted(word))]))


def heads(word: str) -> list[str]:
    """First two characters of each of the pieces of a long word, one piece more than its edits."""
    pieces = budget(len(word)) + 1
    return list(dict.fromkeys(word[at : at + 2] for at in (k * len(word) // pieces for k in range(pieces))))


def _exploded(source: str, make):
    """Arrow function: each string of the column with every string that make gives for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(source).to_pylist()
            listed = [make(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, f in zip(words, listed) for _ in f], pa.string()), pa.array([x for f in listed for x in f], pa.string())], names=[source, "form"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = np.array([similar(s, w) for s, w in zip(b.column("stem").to_pylist(), b.column("word").to_pylist())], float)
        keep = pa.array(score > 0)
        yield pa.RecordBatch.from_arrays([b.column("stem").filter(keep), b.column("word").filter(keep), pa.array(score[score > 0])], names=["stem", "word", "similar"])


def repair(stems: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """Distinct stems to all vocabulary words within their budget of edits: stem, word, similar.

    longest is the length of the longest word; without long words the pigeonhole join isn't planned.
    """
    s, w = stems.select("stem").distinct(), words.select("word").distinct()
    n = F.length("stem")
    left = s.where(n <= SHORT + 1).mapInArrow(_exploded("stem", forms), "stem string, form string")
    right = w.where(F.length("word") <= SHORT).mapInArrow(_exploded("word", forms), "word string, form string")
    near = left.hint("merge").join(right, "form").select("stem", "word")
    if longest > SHORT:
        grams = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
        left = s.where((n > SHORT - budget(SHORT + 1)) & (n <= longest + budget(longest))).mapInArrow(_exploded("stem", lambda t: list(dict.fromkeys(grams(t)))), "stem string, form string")
        right = w.where(F.length("word") > SHORT).mapInArrow(_exploded("word", heads), "word string, form string")
        close = F.abs(n - F.length("word")) <= F.floor(F.length("word") / 4)
        near = near.unionByName(left.hint("merge").join(right, "form").where(close).select("stem", "word"))
    return near.distinct().mapInArrow(_compared, "stem string, word string, similar double")


def _typed(shared):
    """Rows to (id, ask: what is asked as text); the name decides, or the short form where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asks = []
            for kind, name, short, province, city in zip(*(b.column(c).to_pylist() for c in ("type", "name", "short", "province_code", "city_code"))):
                name, short = clean(name, shared.value), clean(short, shared.value)
                beside = (SUFFIX.sub("", short) or short) if name and short else None
                asks.append(json.dumps([kind, province, city, beside, cuts(name or short)], ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(asks, pa.string())], names=["id", "ask"])

    return run


READING = "q1 long, q2 long, type string, province_code string, city_code string, beside string, own string, parents array<string>"


def _read(longest: int):
    """Questions to their readings, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], [[] for _ in range(6)]
            for k, ask in enumerate(b.column("ask").to_pylist()):
                *given, runs = json.loads(ask)
                for own, parents in readings(runs, longest) if runs else ():
                    rows.append(k)
                    for c, v in zip(cols, (*given, own, parents)):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            text = [pa.array(c, pa.string()) for c in cols[:5]]
            yield pa.RecordBatch.from_arrays([b.column("q1").take(at), b.column("q2").take(at), *text, pa.array(cols[5], pa.list_(pa.string()))], names=[f.split()[0] for f in READING.split(", ")])

    return run


def named_parents(runs: list[str], chain: list[tuple[str, float]]) -> float | None:
    """Best weighted similarity of the runs to the parents of an entry, outermost first; null if a run is no parent.

    A run may hold several parents in a row; a parent may be named again, which adds nothing.
    """

    @lru_cache(maxsize=None)
    def best(r: int, at: int, used: int) -> float:
        if r == len(runs):
            return 0.0
        text, top = runs[r][at:], -np.inf
        for k, (word, weight) in enumerate(chain):
            gain = 0.0 if used >> k & 1 else weight
            # the whole rest of the run, or a head of it that leaves two characters or more
            for n in (len(text), *(i for i in range(max(2, len(word) - budget(len(word))), min(len(word) + budget(len(word)), len(text) - 2) + 1))):
                fit = similar(text[:n], word)
                if fit:
                    rest = best(r + 1, 0, used | 1 << k) if n == len(text) else best(r, at + n, used | 1 << k)
                    top = max(top, gain * fit + rest)
        return top

    found = best(0, 0, 0)
    return None if found == -np.inf else found


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = b.column("idf").to_numpy() * b.column("similar").to_numpy()
        keep = np.ones(b.num_rows, bool)
        cols = [b.column(c).to_pylist() for c in ("parents", "province_word", "province_idf", "city_word", "city_idf")]
        for k, (runs, p, pi, c, ci) in enumerate(zip(*cols)):
            if runs:
                more = named_parents(runs, [(w, i) for w, i in ((p, pi), (c, ci)) if w])
                keep[k] = more is not None
                score[k] += more or 0.0
        kept = pa.array(keep)
        yield pa.RecordBatch.from_arrays([*(b.column(c).filter(kept) for c in ("q1", "q2", "key")), pa.array(score[keep])], names=["q1", "q2", "key", "score"])


def match_places(df: DataFrame, reference: DataFrame, row_id: str) -> DataFrame:
    """One row per distinct row_id with a non-blank name or short: row_id, code (`none` if no entry is meant), score.

    df has type, name, short, province_code, city_code, loaded_at; reference has level, code, name, short, province_code,
    city_code. Of several deliveries of an id the last one with a text counts. Null ids and rows without any text give no row;
    an empty reference maps every row to `none`; an empty table gives no rows; two entries that fit equally well give
    `none`. A stem that is a word of the list is meant as it stands. Extra columns are ignored. Equal questions are answered once;
    both sides may have any size: they are met by equi-joins on flat rows only.
    """
    spark = df.sparkSession
    cols = ["type", "name", "short", "province_code", "city_code"]
    texts = F.struct("loaded_at", *cols)
    blank = r"^[\s　]*$"
    typed = df.where(F.col(row_id).isNotNull() & ((F.col("name").isNotNull() & ~F.col("name").rlike(blank)) | (F.col("short").isNotNull() & ~F.col("short").rlike(blank))))
    latest = typed.groupBy(F.col(row_id).cast("long").alias("id")).agg(F.max(texts).alias("t")).select("id", *[F.col(f"t.{c}").alias(c) for c in cols])
    asked = latest.mapInArrow(_typed(spark.sparkContext.broadcast(simplified(spark))), "id long, ask string")
    rows = materialize(asked.withColumns({"q1": F.xxhash64("ask"), "q2": F.xxhash64(F.lit(1), "ask")}))
    entries = materialize(_entries(reference))
    size = entries.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]
    questions = rows.groupBy("q1", "q2").agg(F.first("ask").alias("ask"))
    read = materialize(questions.mapInArrow(_read(size + budget(size)), READING))
    words = entries.select(F.col("word")).distinct()
    stems = read.select(F.col("own").alias("stem")).distinct()
    listed = stems.hint("merge").join(words, F.col("stem") == F.col("word")).select("stem", "word", F.lit(1.0).alias("similar"))
    others = stems.hint("merge").join(words.withColumnRenamed("word", "stem"), "stem", "left_anti")
    offers = materialize(listed.unionByName(repair(others, words, size)).hint("merge").join(entries, "word"))
    keeps = lambda given, own: F.col(given).isNull() | (F.col(given) == "") | F.col(own).isNull() | (F.col(given) == F.col(own))
    strict = lambda given, own: F.col(given).isNull() | (F.col(given) == "") | (F.col(given) == F.col(own))
    met = read.hint("merge").join(offers.hint("merge"), F.col("own") == F.col("stem")).where(keeps("type", "level") & strict("province_code", "province") & strict("city_code", "city") & (F.col("beside").isNull() | (F.col("beside") == F.col("word"))))
    scored = met.select("q1", "q2", "parents", "similar", *ENTRY).mapInArrow(_score, "q1 long, q2 long, key string, score double")
    best = scored.groupBy("q1", "q2", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), "key")
    two = best.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("q1", "q2").agg(F.min_by("key", "r").alias("key"), F.max("score").alias("score"), (F.max("score") - F.min("score")).alias("lead"), F.count("*").alias("n"))
    code = F.when((F.col("n") == 1) | (F.col("lead") > SAME), F.col("key")).otherwise("none")
    answers = two.select("q1", "q2", code.alias("code"), "score", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = rows.select("id", "q1", "q2", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
    out = salted.hint("merge").join(answers, ["q1", "q2", "salt"], "left")
    return out.select(F.col("id").alias(row_id), F.coalesce("code", F.lit("none")).alias("code"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _entries(reference: DataFrame) -> DataFrame:
    """Listed entries with the codes and words of their parents, and the inverse document frequencies of all three words."""
    r = reference.where(F.col("code").isNotNull() & F.col("short").isNotNull()).dropDuplicates(["code"])
    p = r.where("level = 'ProvinceName'").select(F.col("code").alias("province"), F.col("short").alias("province_word"))
    c = r.where("level = 'CityName'").select(F.col("code").alias("city"), F.col("short").alias("city_word"))
    own = r.select(
        F.col("code").alias("key"),
        "level",
        F.col("short").alias("word"),
        F.coalesce("province_code", F.when(F.col("level") == "ProvinceName", F.col("code"))).alias("province"),
        F.coalesce("city_code", F.when(F.col("level") == "CityName", F.col("code"))).alias("city"),
    )
    idf = r.groupBy(F.col("short").alias("word")).agg(F.count("*").alias("n")).crossJoin(r.agg(F.count("*").alias("all")))  # the total is one row
    idf = idf.select("word", F.log(1 + F.col("all") / F.col("n")).alias("idf"))
    parent = lambda col, level: F.when(F.col("level") != level, F.col(col))
    named = own.hint("merge").join(p, "province", "left").join(c.hint("merge"), "city", "left")
    named = named.withColumns({"province_word": parent("province_word", "ProvinceName"), "city_word": parent("city_word", "CityName")})
    for word in ("province", "city"):
        named = named.join(idf.select(F.col("word").alias(f"{word}_word"), F.col("idf").alias(f"{word}_idf")).hint("merge"), f"{word}_word", "left")
    return named.join(idf.hint("merge"), "word").select("word", *ENTRY)
