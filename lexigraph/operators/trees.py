"""Dependency trees as tables: edges, ancestors, induced path patterns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexigraph.plans.patterns import IMPLIED
from lexigraph.session import broadcast_if_small, materialize, merged


def edges(tokens: DataFrame, keys: list[str], by_text: bool = False) -> DataFrame:
    """Parent and child of every token with a head that exists; root tokens hang from 0.

    by_text keeps only the first edge of each (head word, label, word), as a de-duplication by surface text does.
    """
    heads = tokens.select(*keys, F.col("idx").alias("head"), F.col("word").alias("head_word"))
    found = tokens.where("head > 0").join(heads, [*keys, "head"]).select(*keys, "head", "idx", "dep", "head_word", "word")
    roots = tokens.where("head = 0").select(*keys, "head", "idx", "dep", F.lit("[ROOT]").alias("head_word"), "word")
    out = found.unionByName(roots)
    if by_text:
        w = Window.partitionBy(*keys, "head_word", "dep", "word").orderBy("idx")
        out = out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return out


#: Steps that are planned as one chain of joins before the tokens that are not at their root yet are looked for.
ROUND = 10


def ancestors(tokens: DataFrame, keys: list[str], depth: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Every token with itself and its ancestors: keys, idx, anc, steps, ups (labels on the way up).

    Without a depth every way is followed to its root, ROUND steps at a time, each written once; heads that form a ring
    are followed for as many steps as the largest sentence has tokens. A depth bounds the steps, in one chain of joins
    without a driver loop that waits for data. seeds (keys, idx) limits the tokens to start from.
    """
    parent = tokens.select(*keys, F.col("idx").alias("anc"), F.col("head").alias("up"), F.col("dep").alias("up_dep"))
    start = tokens if seeds is None else tokens.join(seeds.distinct(), [*keys, "idx"], "left_semi")
    level = start.select(*keys, "idx", F.col("idx").alias("anc"), F.lit(0).alias("steps"), F.array().cast("array<string>").alias("ups"))

    def climb(level: DataFrame, steps: int) -> list[DataFrame]:
        out = []
        for _ in range(steps):
            level = (
                level.join(parent, [*keys, "anc"])
                .where("up > 0")
                .select(*keys, "idx", F.col("up").alias("anc"), (F.col("steps") + 1).alias("steps"), F.concat("ups", F.array("up_dep")).alias("ups"))
            )
            out.append(level)
        return out

    if depth is not None:
        return reduce(DataFrame.unionByName, [level, *climb(level, depth)])
    last = materialize(reduce(DataFrame.unionByName, [level, *climb(level, ROUND)]))
    out, done, most = last, ROUND, None
    while not (level := last.where(F.col("steps") == done)).isEmpty():
        most = most or tokens.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if done >= most:
            break
        last = materialize(reduce(DataFrame.unionByName, climb(level, ROUND)))
        out, done = out.unionByName(last), done + ROUND
    return out


def _way(parent: dict[int, tuple[int, str]], left: int, right: int) -> tuple[list[str], list[str]] | None:
    """Labels up from left to the lowest common ancestor and up from right to it; null if there is none. A ring of heads is walked once."""

    def chain(at: int) -> dict[int, int]:
        seen: dict[int, int] = {}
        while at in parent and at not in seen:
            seen[at] = len(seen)
            at = parent[at][0]
        return seen

    up, down = chain(left), chain(right)
    met = [(up[k] + down[k], up[k], k) for k in up.keys() & down.keys()]
    if not met:
        return None
    top = min(met)[2]
    return [[parent[k][1] for k in ids if ids[k] < ids[top]] for ids in (up, down)]


def _text(left: str, up: list[str], down: list[str], right: str) -> str:
    """The walk goes up from left with `-[:dep]->` and down to right with `<-[:dep]-`; nodes in between carry no role."""
    steps = [f"-[:{d}]->" for d in up] + [f"<-[:{d}]-" for d in reversed(down)]
    return f"({left}){'()'.join(steps)}({right})"


def _sentences(tokens: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences that are asked about: keys, t (tokens), p (what is asked); both lists are bounded by the sentence."""
    trees = tokens.groupBy(*keys).agg(F.collect_list(F.struct("idx", "head", "dep")).alias("t"))
    rest = [c for c in asked.columns if c not in keys]
    return asked.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("p")).join(merged(trees), keys)


def _answered(df: DataFrame, keys: list[str], answers, schema: str) -> DataFrame:
    """Each sentence's rows out of answers(tree, asked), in Arrow batches."""
    types = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, made = [], []
            for k, (tree, asked) in enumerate(zip(b.column("t").to_pylist(), b.column("p").to_pylist())):
                found = answers({x["idx"]: (x["head"], x["dep"]) for x in tree}, asked)
                rows += [k] * len(found)
                made += found
            cols = list(zip(*made)) if made else [()] * len(types.fields)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), *(pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, types.fields))], names=[*keys, *types.names])

    out = T.StructType([*(df.schema[c] for c in keys), *types.fields])
    return df.select(*keys, "t", "p").mapInArrow(run, out)


def lca_paths(tokens: DataFrame, pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Canonical pattern of every pair (keys, <left>_idx, <right>_idx) through its lowest common ancestor.

    A sentence's tokens (keys, idx, head, dep) and pairs meet once, and the walks are made sentence by sentence, whatever the
    depth. Pairs of a token with itself, pairs without a common ancestor, and tokens that aren't there give no row.
    """
    asked = pairs.select(*keys, F.col(f"{left}_idx").cast("int").alias("l"), F.col(f"{right}_idx").cast("int").alias("r")).distinct()

    def answers(parent: dict, asked: list[dict]) -> list[tuple]:
        ways = [(x["l"], x["r"], _way(parent, x["l"], x["r"])) for x in asked]
        return [(i, j, _text(left, *way, right)) for i, j, way in ways if way and any(way)]

    return _answered(_sentences(tokens, asked, keys), keys, answers, f"{left}_idx int, {right}_idx int, pattern string")


def induce_relations(tokens: DataFrame, relations: DataFrame, keys: list[str], store: DataFrame | None = None) -> DataFrame:
    """Pattern of every relation (keys, a_idx, r_idx, b_idx): `a-b ?name` for an implied one (r_idx below 0), else `a-r,r-b`.

    Each path can be written from either end. The store (pattern, frequency) decides: the first writing that it holds is taken, in the
    order forward, backward (for two paths: both forward, second backward, first backward, both backward), and the first one where
    it holds none. Relations without a path give no row.
    """
    asked = relations.select(*keys, *[F.col(f"{r}_idx").cast("int").alias(f"{r}_idx") for r in "arb"]).distinct()
    names = {v: k for k, v in IMPLIED.items()}

    def both(parent: dict, i: int, j: int, left: str, right: str) -> list[str]:
        way = _way(parent, i, j)
        return [_text(left, *way, right), _text(right, *reversed(way), left)] if way and any(way) else []

    def answers(parent: dict, asked: list[dict]) -> list[tuple]:
        out = []
        for x in asked:
            a, r, b = x["a_idx"], x["r_idx"], x["b_idx"]
            if r < 0:
                written = [f"{p} ?{names[r]}" for p in both(parent, a, b, "a", "b")] if r in names else []
            else:
                written = [f"{p},{q}" for p in both(parent, a, r, "a", "r") for q in both(parent, r, b, "r", "b")]
            if written:
                out.append((a, r, b, written))
        return out

    made = _answered(_sentences(tokens, asked, keys), keys, answers, "a_idx int, r_idx int, b_idx int, written array<string>")
    if store is None:
        return made.select(*keys, "a_idx", "r_idx", "b_idx", F.col("written")[0].alias("pattern"))
    cols = [*keys, "a_idx", "r_idx", "b_idx"]
    held = broadcast_if_small(materialize(store.select("pattern").distinct()), 256)
    each = made.select(*cols, F.col("written")[0].alias("first"), F.posexplode("written").alias("at", "pattern"))
    known = each.join(held.withColumn("held", F.lit(True)), "pattern", "left")
    return known.groupBy(*cols).agg(F.coalesce(F.min_by(F.when(F.col("held"), F.col("pattern")), F.when(F.col("held"), F.col("at"))), F.max("first")).alias("pattern"))


def restock(store: DataFrame, induced: DataFrame) -> DataFrame:
    """The pattern store (pattern, frequency) with the induced patterns counted in, the most frequent first."""
    new = induced.groupBy("pattern").agg(F.count("*").alias("frequency"))
    both = store.select("pattern", "frequency").unionByName(new).groupBy("pattern").agg(F.sum("frequency").alias("frequency"))
    return both.orderBy(F.col("frequency").desc(), "pattern")


def pattern_frequency(patterns: DataFrame, least: int = 1) -> DataFrame:
    """Occurrences of every pattern, from a threshold on."""
    return patterns.groupBy("pattern").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
