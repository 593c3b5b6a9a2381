"""Queries of the operators on training text, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm import languages, leaks, places, private, sentences, terms, tokens, vectors
from lexigraph.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct private values of every case."""
    return private.private_spans(table(spark, sf, "train"), "case_id", "fact").select("case_id", "kind", "value").distinct()


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every fact with typed placeholders in place of private values."""
    return private.redacted(table(spark, sf, "train"), "case_id", "fact")


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every charge with its divergence-from-randomness score, to six digits."""
    scored = terms.distinctive_terms(table(spark, sf, "lac_cut"), table(spark, sf, "train"), "case_id", "pos", "word", "accusation")
    return scored.withColumn("score", F.round("score", 6))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Tell-tale words: scored words in at least 20 % of a charge's cases (10 or more) and at most 2 % of the others'."""
    s = p2_scores(spark, sf)
    typical = (F.col("n_in") >= 10) & (F.col("df") * 5 >= F.col("n_in")) & (F.col("df_out") * 50 <= F.col("n_out")) & (F.col("score") > 0)
    return s.where(typical).select("accusation", "word")


def p3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar words of every word."""
    return vectors.nearest(table(spark, sf, "tencent_word_embeddings"), "word", "vec")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of words among each other's five most similar, with cosine 0.85 or more."""
    pairs = vectors.mutual_pairs(table(spark, sf, "tencent_word_embeddings"), "word", "vec", 0.85)
    return pairs.select(F.col("key_a").alias("word_a"), F.col("key_b").alias("word_b"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence spans of every distinct case."""
    return sentences.sentence_spans(table(spark, sf, "train"), "case_id", "fact")


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and cases of every term."""
    return terms.term_counts(table(spark, sf, "lac_cut"), "case_id", "pos", "word", "type")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that are too rare or too common to be useful."""
    return p6_counts(spark, sf).where(F.col("mark").isNotNull()).select("word", "type", "mark")


def p7_places(spark: SparkSession, sf: str) -> DataFrame:
    """The division meant by every typed place, with its score."""
    return places.match_places(table(spark, sf, "dump_locations"), table(spark, sf, "divisions"), "loc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The code of the division meant by every typed place, or none."""
    return p7_places(spark, sf).select("loc_id", "code")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of an item with at most one edit."""
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the items with which they share a run of 32 letters and digits."""
    return p9_leaks(spark, sf).where("exact").select("doc_id", "item_id")


def p10_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    return languages.language_stretches(table(spark, sf, "documents"), "doc_id", "text", "lang").drop("label")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong, or not the only language."""
    found = languages.language_stretches(table(spark, sf, "documents"), "doc_id", "text", "lang")
    return languages.mislabelled(found, "doc_id").select("doc_id", "language")


def queries() -> dict:
    """All queries of this subpackage by name."""
    return {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_scores": p2_scores, "p3_found": p3_found, "p3_nearest": p3_nearest, "p4_found": p4_found, "p6_found": p6_found, "p6_counts": p6_counts, "p7_found": p7_found, "p7_places": p7_places, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_stretches": p10_stretches}


P2 = """WITH c AS (SELECT DISTINCT case_id, accusation FROM train WHERE accusation IS NOT NULL AND case_id IN (SELECT case_id FROM lac_cut)),
    t AS (SELECT DISTINCT case_id, pos, word FROM lac_cut WHERE word IS NOT NULL AND word <> '' AND case_id IS NOT NULL),
    k AS (SELECT accusation, count(*) AS n_in FROM c GROUP BY 1),
    s AS (SELECT accusation, word, count(*) AS tf, count(DISTINCT case_id) AS df FROM t JOIN c USING (case_id) GROUP BY 1, 2),
    w AS (SELECT word, sum(df) AS all_df, sum(tf) AS all_tf FROM s GROUP BY 1),
    l AS (SELECT accusation, sum(tf) AS len FROM s GROUP BY 1),
    g AS (SELECT avg(len) AS mean_len, count(*) AS n_groups FROM l),
    r AS (SELECT s.accusation, s.word, s.tf, s.df, CAST(all_df - s.df AS BIGINT) AS df_out, n_in, CAST((SELECT sum(n_in) FROM k) - n_in AS BIGINT) AS n_out,
      all_tf / n_groups AS lam, s.tf * log2(1 + mean_len / len) AS tfn
      FROM s JOIN w USING (word) JOIN k USING (accusation) JOIN l USING (accusation), g)"""


P3 = """WITH v AS (SELECT word, min(vec) AS vec FROM tencent_word_embeddings WHERE word IS NOT NULL AND len(vec) = 200 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY word),
    u AS (SELECT word, CAST(vec AS DOUBLE[200]) AS d FROM v),
    s AS (SELECT a.word AS a, b.word AS b, array_cosine_similarity(a.d, b.d) AS c FROM u a, u b WHERE a.word <> b.word),
    r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
    SELECT x.a AS word_a, x.b AS word_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.k <= 5 AND y.k <= 5 AND x.a < x.b AND x.c >= 0.85"""
#: Full-width forms of the printable ASCII characters, in order.
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
LETTERS = f"regexp_replace(lower(translate(text, '{FULL}', '{HALF}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
P9 = f"""WITH d AS (SELECT doc_id, {LETTERS} AS t FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {LETTERS} AS t FROM benchmark WHERE text IS NOT NULL),
    x AS (SELECT DISTINCT item_id, t[k:k + 31] AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 30)) AS k FROM i)),
    y AS (SELECT DISTINCT doc_id, t[k:k + 31] AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 30)) AS k FROM d))
    SELECT DISTINCT doc_id, item_id FROM y JOIN x USING (g)"""


def oracle_sql() -> dict:
    """SQL of the queries above that SQL can express."""
    return {
        "p2_scores": P2 + " SELECT accusation, word, tf, df, df_out, n_in, n_out, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 6) AS score FROM r",
        "p2_found": P2 + " SELECT accusation, word FROM r WHERE n_in >= 10 AND df * 5 >= n_in AND df_out * 50 <= n_out",
        "p3_found": P3,
        "p9_found": P9,
        "p6_found": """WITH t AS (SELECT word, type, count(DISTINCT case_id) AS n FROM lac_cut
            WHERE word <> '' AND type <> '' AND case_id IS NOT NULL GROUP BY 1, 2), a AS (SELECT count(DISTINCT case_id) AS n_all FROM lac_cut)
            SELECT word, type, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark FROM t, a WHERE n < 3 OR n > 0.5 * n_all""",
        "p6_counts": """WITH t AS (SELECT word, type, count(DISTINCT (case_id, coalesce(pos, -1))) AS n_occurrences, count(DISTINCT case_id) AS n_records FROM lac_cut
            WHERE word <> '' AND type <> '' AND case_id IS NOT NULL GROUP BY 1, 2), a AS (SELECT count(DISTINCT case_id) AS n_all FROM lac_cut)
            SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.5 * n_all THEN 'common' END AS mark FROM t, a""",
    }
