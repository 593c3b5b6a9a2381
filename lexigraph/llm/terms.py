"""Frequency of every distinct term, and how distinctive a term is of a record.

Both operators start from the same blockwise count. Rows are shuffled once on the hash of (record, term), so neither a
hot term nor a hot record meets in one task. Each partition encodes its terms as local integers, drops repeated
deliveries of a position, and sums occurrences and record presence into count arrays. Only one row per (partition,
term) leaves the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.session import BROADCAST_LIMIT, broadcast_if_small, materialize, spread

#: Parts that one record's rows are spread over when they meet the record's groups.
SALT = 16
#: Identifiers per count array.
BLOCK = 4096


def _partition(batches: Iterator[pa.RecordBatch], columns: list[str]) -> dict[str, pa.ChunkedArray]:
    """All rows of a shuffle partition; Spark's advisory partition size bounds them."""
    held = list(batches)
    if not held:
        return {}
    t = pa.Table.from_batches(held)
    return {c: t.column(c) for c in columns}


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Local integer codes of a column and the values they stand for."""
    d = column.combine_chunks()
    if isinstance(d, pa.ChunkedArray):
        d = pa.concat_arrays(d.chunks)
    d = d.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _dense(ids: np.ndarray) -> np.ndarray:
    """Small integers for record ids, in any order."""
    return np.unique(ids, return_inverse=True)[1].astype(np.int64)


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows sorted by the keys; the order and the sorted keys."""
    order = np.lexsort(keys[::-1])
    return order, [k[order] for k in keys]


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, pos, term) rows to (term, occ, pres), with repeated (record, pos, term) counted once."""
    cols = _partition(batches, ["record", "pos", "term"])
    if not cols or not len(cols["record"]):
        return
    term, names = _codes(cols["term"])
    record = _dense(cols["record"].to_numpy())
    pos = cols["pos"].to_numpy().astype(np.int64)
    pair = record * len(names) + term
    _, (pair, pos) = _first_of(pair, pos)
    new_pair = np.r_[True, pair[1:] != pair[:-1]]
    new_row = new_pair | np.r_[True, pos[1:] != pos[:-1]]
    term = pair % len(names)
    occ = np.bincount(term[new_row], minlength=len(names))
    pres = np.bincount(term[new_pair], minlength=len(names))
    yield pa.RecordBatch.from_arrays([names, pa.array(occ, pa.int64()), pa.array(pres, pa.int64())], names=["term", "occ", "pres"])


def _rows(df: DataFrame, record: str, pos: str, *terms: str) -> DataFrame:
    """Rows with a usable term, one shuffled string per term: parts are joined behind the length of the first, so any text comes apart again."""
    kept = df.where(F.col(record).isNotNull())
    for t in terms:
        kept = kept.where(F.col(t).isNotNull() & (F.col(t) != ""))
    term = F.col(terms[0]) if len(terms) == 1 else F.concat(F.length(terms[0]).cast("string"), F.lit(":"), *[F.col(t) for t in terms])
    return kept.select(F.col(record).cast("long").alias("record"), F.coalesce(F.col(pos).cast("int"), F.lit(-1)).alias("pos"), term.alias("term"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position of each term within its sorted range."""
    seen = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("term"), pa.array(np.arange(seen, seen + b.num_rows), pa.int64())], names=["part", "term", "at"])
        seen += b.num_rows


def dictionary(terms: DataFrame) -> DataFrame:
    """Global integer dictionary: ids 0.. in term order of the distinct terms.

    The terms are range-partitioned and numbered within each range; the driver sees one count per range.
    """
    ranged = terms.select("term").distinct().repartitionByRange(spread(terms), "term").sortWithinPartitions("term")
    numbered = materialize(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_number, "part int, term string, at long"))
    sizes = {r["part"]: r["count"] for r in numbered.groupBy("part").count().collect()}
    base, at = [], 0
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    first = terms.sparkSession.createDataFrame(base, "part int, base long")
    return numbered.join(F.broadcast(first), "part").select("term", (F.col("base") + F.col("at")).alias("id"))


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded partial counts to one pair of summed arrays per identifier range."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        ids = b.column("id").to_numpy()
        occ, pres = b.column("occ").to_numpy(), b.column("pres").to_numpy()
        block = ids // BLOCK
        order = np.argsort(block, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(block[order])) + 1, len(order)] if len(order) else np.array([0])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = order[s:e]
            sums = held.setdefault(int(block[rows[0]]), np.zeros((2, BLOCK), np.int64))
            np.add.at(sums[0], ids[rows] % BLOCK, occ[rows])
            np.add.at(sums[1], ids[rows] % BLOCK, pres[rows])
    for k, sums in held.items():
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(k * BLOCK + at, pa.int64()), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["id", "n_occurrences", "n_records"])


def term_counts(df: DataFrame, record: str, pos: str, word: str, kind: str, rare_below: int = 3, common_above: float = 0.5) -> DataFrame:
    """Occurrences and records of every term, with a mark for those too rare or too common.

    A term is (word, kind) as stored; rows with a null or empty part or a null record are no term. Occurrences are
    distinct positions of a record, so rows delivered again count once (a null position is one position). Out: word,
    kind, n_occurrences, n_records, n_all (records of the whole table, whatever their terms), mark (`rare`, `common` or null; a term that is
    both is `rare`). An empty table gives no rows. Extra columns are ignored.
    """
    rows = _rows(df, record, pos, word, kind)
    partial = materialize(rows.repartition(spread(df), "record", "term").mapInArrow(_count_block, "term string, occ long, pres long"))
    words = dictionary(partial)
    encoded = partial.join(words, "term").select("id", "occ", "pres")
    block = (F.col("id") / BLOCK).cast("long")
    sums = encoded.repartition(spread(df), block).mapInArrow(_sum_blocks, "id long, n_occurrences long, n_records long")
    n_all = df.select(F.count_distinct(F.col(record)).alias("n_all"))  # one row
    digits = F.substring_index("term", ":", 1)
    begin, length = F.length(digits) + 2, digits.cast("int")
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * F.col("n_all"), "common")
    return (
        sums.join(words, "id")
        .crossJoin(F.broadcast(n_all))
        .select(F.substr("term", begin, length).alias(word), F.substr("term", begin + length).alias(kind), "n_occurrences", "n_records", "n_all", mark.alias("mark"))
    )


def _class_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, record, pos, term) rows to (grp, term, tf, df) per partition."""
    cols = _partition(batches, ["grp", "record", "pos", "term"])
    if not cols or not len(cols["record"]):
        return
    term, names = _codes(cols["term"])
    grp, groups = _codes(cols["grp"])
    record = _dense(cols["record"].to_numpy())
    pos = cols["pos"].to_numpy().astype(np.int64)
    class_term = grp * len(names) + term
    _, (class_term, record, pos) = _first_of(class_term, record, pos)
    new_term = np.r_[True, class_term[1:] != class_term[:-1]]
    new_record = new_term | np.r_[True, record[1:] != record[:-1]]
    new_row = new_record | np.r_[True, pos[1:] != pos[:-1]]
    at = np.cumsum(new_term) - 1
    key = class_term[new_term]
    yield pa.RecordBatch.from_arrays(
        [groups.take(pa.array(key // len(names))), names.take(pa.array(key % len(names))), pa.array(np.bincount(at[new_row]), pa.int64()), pa.array(np.bincount(at[new_record]), pa.int64())],
        names=["grp", "term", "tf", "df"],
    )


def distinctive_terms(df: DataFrame, cases: DataFrame, record: str, pos: str, word: str, group: str, c: float = 1.0, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Score the terms of every group of records by divergence from randomness (geometric model, Laplace, H2).

    cases maps records to groups (repeated and null rows are ignored; a record of two groups counts in both). With F
    the occurrences of a term in all grouped records, N the number of groups and L the mean group length, lambda = F/N,
    tfn = tf * log2(1 + c * L / length of the group), and
    score = (log2(1 + lambda) + tfn * log2((1 + lambda) / lambda)) / (tfn + 1).
    Out: group, word, tf, df (records of the group with the word), df_out (records of other groups with it), n_in, n_out
    (records in the group, in all other groups), score. Rows with null record, null or empty word are no term; records
    without a group, or groups without terms, give no rows. An empty side gives no rows.
    """
    mapped = cases.where(F.col(group).isNotNull() & F.col(record).isNotNull()).select(F.col(record).cast("long").alias("record"), F.col(group).alias("grp")).distinct()
    mapped = materialize(mapped)
    rows, side = _rows(df, record, pos, word), broadcast_if_small(mapped, 48, broadcast_limit)
    if side is mapped:  # too large: rows meet the groups by (record, salt of the term) and are spread on (record, term) after that
        parts = mapped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")).hint("merge").join(parts, ["record", "salt"])
        joined = met.repartition(spread(df), "record", "term")
    else:
        joined = rows.repartition(spread(df), "record", "term").join(side, "record")
    partial = materialize(joined.select("grp", "record", "pos", "term").mapInArrow(_class_block, "grp string, term string, tf long, df long"))
    stats = materialize(partial.groupBy("grp", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))
    total = stats.groupBy("term").agg(F.sum("tf").alias("all_tf"), F.sum("df").alias("all_df"))
    length = stats.groupBy("grp").agg(F.sum("tf").alias("length"))
    present = df.select(F.col(record).cast("long").alias("record")).distinct()
    counts = present.join(side, "record").groupBy("grp").agg(F.count("*").alias("n_in"))
    sizes = materialize(counts.join(length, "grp"))
    overall = counts.agg(F.sum("n_in").alias("n_all")).crossJoin(sizes.agg(F.avg("length").alias("mean_length"), F.count("*").alias("n_groups")))
    lam = F.col("all_tf") / F.col("n_groups")
    tfn = F.col("tf") * F.log2(1 + c * F.col("mean_length") / F.col("length"))
    return (
        stats.join(total, "term")
        .join(broadcast_if_small(sizes, 64), "grp")
        .crossJoin(F.broadcast(overall))
        .withColumn("lam", lam)
        .withColumn("tfn", tfn)
        .select(
            F.col("grp").alias(group),
            F.col("term").alias(word),
            "tf",
            "df",
            (F.col("all_df") - F.col("df")).alias("df_out"),
            "n_in",
            (F.col("n_all") - F.col("n_in")).alias("n_out"),
            ((F.log2(1 + F.col("lam")) + F.col("tfn") * F.log2((1 + F.col("lam")) / F.col("lam"))) / (F.col("tfn") + 1)).alias("score"),
        )
    )
