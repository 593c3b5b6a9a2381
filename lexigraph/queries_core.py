"""Queries of the core operators for general data-processing problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators import balanced
from lexigraph.session import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Charges that hold at least 5 % of all rows of train."""
    return balanced.heavy_keys(table(spark, sf, "train"), "accusation", "filed_at", "case_id", F.length("fact"), 0.05)


def p5_per_charge(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered results of every charge: rows, distinct deliveries, first and last filing, longest pause, characters."""
    return balanced.per_key(table(spark, sf, "train"), "accusation", "filed_at", "case_id", F.length("fact"))


def queries() -> dict:
    return {"p5_found": p5_found, "p5_per_charge": p5_per_charge}


def oracle_sql() -> dict:
    return {
        "p5_found": """SELECT accusation FROM train WHERE accusation IS NOT NULL GROUP BY accusation
            HAVING count(*) >= 0.05 * (SELECT count(*) FROM train)""",
        "p5_per_charge": """WITH t AS (SELECT accusation, case_id, filed_at, coalesce(length(fact), 0) AS n FROM train),
            g AS (SELECT accusation, filed_at, epoch_us(filed_at) - lag(epoch_us(filed_at)) OVER (PARTITION BY accusation ORDER BY filed_at NULLS FIRST) AS gap FROM t)
            SELECT t.accusation, count(*) AS n_rows,
              (SELECT count(*) FROM (SELECT DISTINCT case_id, filed_at FROM t u WHERE u.accusation IS NOT DISTINCT FROM t.accusation)) AS n_distinct,
              min(filed_at) AS first_at, max(filed_at) AS last_at,
              CAST(coalesce((SELECT max(gap) FROM g WHERE g.accusation IS NOT DISTINCT FROM t.accusation), 0) AS BIGINT) AS max_gap_us,
              CAST(sum(n) AS BIGINT) AS total
            FROM t GROUP BY t.accusation""",
    }
