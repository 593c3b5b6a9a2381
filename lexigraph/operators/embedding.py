"""Word vectors: cosine neighbours of stated words, skip-gram training, inputs of a relation classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexigraph.functions import scalars as X


#: Probes that are held together; more are compared in further blocks.
PROBES = 4096


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with dim numbers, not all zero, as unit rows, and where they stand."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    x = np.array([*column.take(pa.array(at)).to_pylist()], float).reshape(-1, dim) if len(at) else np.zeros((0, dim))
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good, None], at[good]


def similar_to(vectors: DataFrame, key: str, vec: str, probes: DataFrame, k: int) -> DataFrame:
    """The k most similar rows for each row of a stated set of probes (probe, pvec): probe, key, cosine, rank; ties go to the smaller key.

    Probes are compared in blocks of PROBES, each with all rows as blocked matrix products that keep the k best of a batch.
    Rows with vectors that are null, all zero, not finite or of another length than the probe are never similar.
    """
    slim = vectors.select(key, vec)
    schema = T.StructType([T.StructField("probe", probes.schema["probe"].dataType), slim.schema[key], T.StructField("exact", T.DoubleType())])
    spark, out = vectors.sparkSession, None

    def compare(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = pa.Table.from_batches([b]).sort_by(key).combine_chunks()
                keys, column = b.column(0).combine_chunks(), b.column(1).combine_chunks()
                for ids, unit in shared.value:
                    x, at = _unit(column, unit.shape[1])
                    cosine = np.round(x @ unit.T, 9)
                    own = np.array(keys.take(pa.array(at)).to_pylist(), object)[:, None] == np.array(ids, object)[None, :]
                    cosine[own] = -np.inf
                    best = np.argsort(-cosine, axis=0, kind="stable")[:k]
                    r, c = best.T.ravel(), np.repeat(np.arange(len(ids)), len(best))
                    some = cosine[r, c] > -np.inf
                    r, c = r[some], c[some]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in c], to_arrow_type(schema["probe"].dataType)), keys.take(pa.array(at[r])), pa.array(cosine[r, c], pa.float64())], names=["probe", key, "exact"])

        return run

    def blocks() -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for row in probes.where(F.col("pvec").isNotNull()).select("probe", "pvec").toLocalIterator():
            held.append((row["probe"], row["pvec"]))
            if len(held) == PROBES:
                yield held
                held = []
        if held:
            yield held

    for block in blocks():
        by_size: dict[int, list[tuple]] = {}
        for probe, v in block:
            by_size.setdefault(len(v), []).append((probe, v))
        units = []
        for size, rows in by_size.items():
            unit, at = _unit(pa.array([v for _, v in rows], pa.list_(pa.float64())), size)
            if len(at):
                units.append(([rows[i][0] for i in at], unit))
        one = slim.where(F.col(key).isNotNull()).mapInArrow(compare(spark.sparkContext.broadcast(units)), schema)  # at most PROBES vectors
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("probe").orderBy(F.col("exact").desc(), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("probe", key, F.round("exact", 6).alias("cosine"), "rank")


def skip_gram(sentences: DataFrame, words: str, size: int = 200, window: int = 7, least: int = 10, seed: int = 1):
    """A fitted skip-gram model over arrays of words."""
    from pyspark.ml.feature import Word2Vec

    parts = max(1, sentences.sparkSession.sparkContext.defaultParallelism)
    return Word2Vec(numPartitions=parts, vectorSize=size, windowSize=window, minCount=least, inputCol=words, outputCol="vector", seed=seed, maxIter=1).fit(sentences)


def last_position(words: Column, word: Column) -> Column:
    """Position from 0 of the last occurrence, null if there is none."""
    at = F.array_position(F.reverse(words), word)
    return F.when(at > 0, (F.size(words) - at).cast("int"))


def classifier_inputs(df: DataFrame, words: str, e1: str, e2: str, vocabulary: dict[str, int], size: int = 121) -> DataFrame:
    """ids, pos1, pos2 of fixed length: word ids with both entities masked by ids of their own, and clamped distances.

    Unknown words have id 0, fillers id 0 and position top. Rows in which an entity doesn't occur have null arrays.
    """
    ids = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv]) if vocabulary else None
    w, top = F.col(words), size - 1
    mask1, mask2 = len(vocabulary) + 1, len(vocabulary) + 2
    known = lambda x: F.coalesce(ids[x], F.lit(0)) if ids is not None else F.lit(0)
    one = F.transform(w, lambda x: F.when(x == F.col(e1), mask1).when(x == F.col(e2), mask2).otherwise(known(x)))
    p1, p2 = last_position(w, F.col(e1)), last_position(w, F.col(e2))
    both = p1.isNotNull() & p2.isNotNull()
    rel = lambda p: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: X.clamp_position(i - p, 60, top).cast("int"))
    return df.select(
        *df.columns,
        F.when(both, X.fixed_length(one, size, 0)).alias("ids"),
        F.when(both, X.fixed_length(rel(p1), size, top)).alias("pos1"),
        F.when(both, X.fixed_length(rel(p2), size, top)).alias("pos2"),
    )


def lookup(tokens: DataFrame, vectors: DataFrame, dim: int = 200) -> DataFrame:
    """Vector of each word, all ones where there is none."""
    return tokens.join(vectors.select("word", "vec"), "word", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(1.0).cast("float"), dim)))
