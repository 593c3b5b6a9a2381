"""Candidate relations: features, labels, one decision tree per pattern, and the gate in front of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import scalars as X
from lexigraph.operators import trees
from lexigraph.operators.tokens import COMMAS, STOPS
from lexigraph.plans import patterns
from lexigraph.session import materialize, merged

FEATURES = ["pos_a", "pos_r", "pos_b", "ra", "ra_sign", "br", "br_sign", "ba", "ba_sign", "comma", "stop"]


def features(candidates: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Eleven numbers per candidate (keys, a_idx, r_idx, b_idx): tags, distances, signs, comma and stop in between.

    An implied relation (r_idx <= 0) has the tag of others, distances 0, and signs as its number gives them. Candidates and
    tokens of a sentence are brought together once, and the result is materialised.
    """
    tag = tokens.select(*keys, "idx", X.tag_number("type").alias("tag")).repartition(*keys)
    marks = tokens.where(F.col("word").isin(*COMMAS, *STOPS)).groupBy(*keys).agg(
        F.collect_set(F.when(F.col("word").isin(*COMMAS), F.col("idx"))).alias("commas"),  # bounded by a sentence
        F.collect_set(F.when(F.col("word").isin(*STOPS), F.col("idx"))).alias("stops"),
    )
    out = candidates.repartition(*keys).join(merged(marks), keys, "left")
    for role in "arb":
        side = tag.select(*keys, F.col("idx").alias(f"{role}_idx"), F.col("tag").alias(f"pos_{role}"))
        out = out.join(merged(side), [*keys, f"{role}_idx"], "left")
    a, r, b = F.col("a_idx"), F.col("r_idx"), F.col("b_idx")
    given = r > 0
    lo, hi = F.least(a, b, F.when(given, r)), F.greatest(a, b, F.when(given, r))
    between = lambda col: F.coalesce(F.exists(col, lambda x: (x > lo) & (x < hi)), F.lit(False))
    sign = lambda x: F.when(x > 0, 1).otherwise(-1)
    out = out.select(
        *candidates.columns,
        F.coalesce("pos_a", F.lit(X.OTHER_TAG)).alias("pos_a"),
        F.coalesce("pos_r", F.lit(X.OTHER_TAG)).alias("pos_r"),
        F.coalesce("pos_b", F.lit(X.OTHER_TAG)).alias("pos_b"),
        F.when(given, F.abs(r - a)).otherwise(0).alias("ra"),
        sign(r - a).alias("ra_sign"),
        F.when(given, F.abs(b - r)).otherwise(0).alias("br"),
        sign(b - r).alias("br_sign"),
        F.abs(b - a).alias("ba"),
        sign(b - a).alias("ba_sign"),
        between("commas").cast("int").alias("comma"),
        F.when(between("stops"), 1).otherwise(-1).alias("stop"),
    )
    return materialize(out, tidy=True, in_place=True)


def without_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The three tags and the direction from r to b: the features at places 0, 1, 2 and 6."""
    return rows.select(*keys, *[FEATURES[i] for i in (0, 1, 2, 6)])


def labelled(candidates: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """label 1 where (a, r, b) is a gold relation; all implied relations count as one."""
    one = lambda: F.when(F.col("r_idx") > 0, F.col("r_idx")).otherwise(-100)
    g = gold.select(*keys, "a_idx", one().alias("rk"), "b_idx").distinct().withColumn("hit", F.lit(1))
    return candidates.withColumn("rk", one()).join(merged(g), [*keys, "a_idx", "rk", "b_idx"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit", "rk")


def train_trees(rows: DataFrame, least: int = 10, depth: int = 5) -> dict[str, object]:
    """A decision tree per pattern with at least `least` candidates and both labels; the patterns are listed on the driver."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("pattern", "features", F.col("label").cast("double").alias("label"))
    names = [r["pattern"] for r in rows.groupBy("pattern").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).where((F.col("n") >= least) & (F.col("k") > 1)).orderBy("pattern").collect()]
    tree = DecisionTreeClassifier(maxDepth=depth, seed=1)
    return {n: tree.fit(assembled.where(F.col("pattern") == n)) for n in names}


def gate(rows: DataFrame, models: dict[str, object]) -> DataFrame:
    """Candidates that their pattern's tree accepts; candidates of patterns without a tree are kept."""
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    out = assembled.where(~F.col("pattern").isin(*models) if models else F.lit(True)).withColumn("accepted", F.lit(1.0))
    for name, model in models.items():
        one = model.transform(assembled.where(F.col("pattern") == name)).withColumnRenamed("prediction", "accepted")
        out = out.unionByName(one.select(*out.columns))
    return out.where("accepted = 1").select(*rows.columns)


def retrain(tokens: DataFrame, gold: DataFrame, store: DataFrame, keys: list[str], least: int = 3) -> tuple[DataFrame, dict[str, object]]:
    """One round of learning from confirmed relations: the store with their patterns counted in, and a tree for each of its patterns.

    gold has keys, a_idx, r_idx, b_idx. Patterns of a frequency of `least` or more are matched again; their candidates are labelled by gold.
    """
    store = materialize(trees.restock(store, trees.induce_relations(tokens, gold, keys, store)))
    known = [r["pattern"] for r in store.where(F.col("frequency") >= least).select("pattern").orderBy("pattern").collect()]  # a pattern becomes a plan, so all are listed
    if not known:
        return store, {}
    found = patterns.match_all(tokens, known, keys)
    rows = materialize(labelled(features(found, tokens, keys), gold, keys))
    return store, train_trees(rows)


def accuracy(predicted: DataFrame) -> DataFrame:
    """Share of right labels, and recall of labels other than 0."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return predicted.agg(F.avg(hit).alias("accuracy"), F.avg(F.when(F.col("label") != 0, hit)).alias("recall"))
