"""Per-key results when a few keys hold most of the rows.

Rows are range-partitioned on the composite (key, order columns); Spark samples the quantiles, so a key that fills
many ranges is cut across as many partitions. Every partition is sorted and scanned once and yields one partial state
per key it touches; the few partial states of a key are then stitched in range order. No task ever holds a whole key,
and what is shuffled after the range exchange is one row per (key, partition).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigraph.session import materialize

STATE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_first", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("first_at", T.LongType()),
        T.StructField("last_at", T.LongType()),
        T.StructField("first_set", T.LongType()),
        T.StructField("max_gap", T.LongType()),
        T.StructField("total", T.LongType()),
    ]
)
NONE = np.iinfo(np.int64).min


def _states(part: int, keys: pa.Array, at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> list[dict]:
    """Partial states of one sorted batch; at holds NONE for a missing time, and those sort first."""
    n = len(keys)
    if not n:
        return []
    codes = keys.dictionary_encode(null_encoding="encode")
    k = codes.indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    end = np.r_[start[1:], n]
    out = []
    for s, e in zip(start.tolist(), end.tolist()):
        t = at[s:e]
        timed = t[t != NONE]
        same = (t[1:] == t[:-1]) & (ids[s + 1 : e] == ids[s : e - 1])
        out.append(
            {
                "key": codes.dictionary[int(k[s])].as_py(),
                "part": part,
                "n_rows": e - s,
                "n_first": int(1 + np.count_nonzero(~same)),
                "first_id": int(ids[s]),
                "last_id": int(ids[e - 1]),
                "first_at": int(t[0]),
                "last_at": int(t[-1]),
                "first_set": int(timed[0]) if len(timed) else NONE,
                "max_gap": int(np.diff(timed).max()) if len(timed) > 1 else 0,
                "total": int(size[s:e].sum()),
            }
        )
    return out


def _join(a: dict, b: dict) -> dict:
    """The state of a's rows followed by b's."""
    met = a["last_at"] == b["first_at"] and a["last_id"] == b["first_id"]
    gap = b["first_at"] - a["last_at"] if NONE not in (a["last_at"], b["first_at"]) else 0
    return a | {
        "n_rows": a["n_rows"] + b["n_rows"],
        "n_first": a["n_first"] + b["n_first"] - met,
        "last_id": b["last_id"],
        "last_at": b["last_at"],
        "first_set": b["first_set"] if a["first_set"] == NONE else a["first_set"],
        "max_gap": max(a["max_gap"], b["max_gap"], gap),
        "total": a["total"] + b["total"],
    }


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition to partial states; the batch in hand is all that is held."""
    held = None
    for b in batches:
        at = b.column("at").fill_null(NONE).to_numpy(zero_copy_only=False)
        out = _states(
            int(b.column("part")[0].as_py()) if b.num_rows else 0,
            b.column("key"),
            at,
            b.column("id").to_numpy(zero_copy_only=False),
            b.column("size").to_numpy(zero_copy_only=False),
        )
        for s in out:
            if held is not None and held["key"] == s["key"]:
                held = _join(held, s)
                continue
            if held is not None:
                yield pa.RecordBatch.from_pylist([held], schema=_ARROW)
            held = s
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], schema=_ARROW)


_ARROW = pa.schema([(f.name, pa.string() if f.name == "key" else pa.int64()) for f in STATE])


def per_key(df: DataFrame, key: str, order: str, row_id: str, size: Column, partitions: int | None = None) -> DataFrame:
    """Ordered per-key results without one task per key.

    Columns out: key (named as given), n_rows, n_distinct (rows that differ in (order, row_id)), first_at, last_at
    (extremes of the order column, null if none is set), max_gap_us (longest pause between neighbours in microseconds,
    0 with fewer than two times), total (sum of size). Rows with a null key form the null key's group. Repeated rows
    count in n_rows and total. A missing order value sorts first. An empty table gives no rows. Extra columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    slim = df.select(
        F.col(key).cast("string").alias("key"),
        F.unix_micros(F.col(order).cast("timestamp")).alias("at"),
        F.coalesce(F.col(row_id).cast("long"), F.lit(NONE + 1)).alias("id"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
    )
    # rows alike in key, time and id are told apart by their place in the input, so that they too can be cut
    slim = slim.withColumn("place", F.monotonically_increasing_id())
    ranged = slim.repartitionByRange(n, "key", "at", "id", "place").sortWithinPartitions("key", "at", "id").drop("place").withColumn("part", F.spark_partition_id().cast("long"))
    states = ranged.mapInArrow(_scan, STATE)
    # At most one state per (key, range): a key's list is as long as the ranges it fills.
    step = F.struct("part", *[c for c in STATE.names if c not in ("key", "part")])
    joined = states.groupBy("key").agg(F.array_sort(F.collect_list(step)).alias("s"))
    none = F.lit(NONE)

    def stitch(acc: Column, x: Column) -> Column:
        met = (acc["last_at"] == x["first_at"]) & (acc["last_id"] == x["first_id"])
        gap = F.when((acc["last_at"] != none) & (x["first_at"] != none), x["first_at"] - acc["last_at"]).otherwise(F.lit(0).cast("long"))
        return F.struct(
            x["part"].alias("part"),
            (acc["n_rows"] + x["n_rows"]).alias("n_rows"),
            (acc["n_first"] + x["n_first"] - met.cast("long")).alias("n_first"),
            acc["first_id"].alias("first_id"),
            x["last_id"].alias("last_id"),
            acc["first_at"].alias("first_at"),
            x["last_at"].alias("last_at"),
            F.when(acc["first_set"] == none, x["first_set"]).otherwise(acc["first_set"]).alias("first_set"),
            F.greatest(acc["max_gap"], x["max_gap"], gap).alias("max_gap"),
            (acc["total"] + x["total"]).alias("total"),
        )

    rest = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    whole = joined.select("key", F.aggregate(rest, F.element_at("s", 1), stitch).alias("w"))
    return whole.select(
        F.col("key").alias(key),
        F.col("w.n_rows").alias("n_rows"),
        F.col("w.n_first").alias("n_distinct"),
        F.when(F.col("w.first_set") != none, F.timestamp_micros("w.first_set")).alias("first_at"),
        F.when(F.col("w.last_at") != none, F.timestamp_micros("w.last_at")).alias("last_at"),
        F.col("w.max_gap").alias("max_gap_us"),
        F.col("w.total").alias("total"),
    )


def heavy_keys(df: DataFrame, key: str, order: str, row_id: str, size: Column, share: float) -> DataFrame:
    """The non-null keys that hold at least the given share of all rows, from per_key's results."""
    # one row per key, written once: both the total and the choice read it
    res = materialize(per_key(df, key, order, row_id, size).select(key, "n_rows"))
    total = res.agg(F.sum("n_rows").alias("all_rows"))  # one row
    return res.crossJoin(F.broadcast(total)).where(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("all_rows"))).select(key)
