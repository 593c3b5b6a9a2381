"""Property-graph tables: nodes and edges of cases, alignment, hierarchy, and upserts with set semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import scalars as X
from lexigraph.operators import search
from lexigraph.plans.patterns import IMPLIED
from lexigraph.session import broadcast_if_small, materialize, merged

EDGE = ["src_label", "src", "type", "dst_label", "dst"]
# Part of a tag, the label it gives and the relation of a case to nodes of it; the first part found decides.
LADDER = [("LOC", "Location", "地理位于"), ("PER", "Person", "人物"), ("ORG", "Organization", "相关组织"), ("TIME", "Time", "相关时间")]
TO_TIME, KEYWORD, SAME, WITHIN, MEMBER = "相关时间", "监督关键短语", "is", "位于", "相关实体"


def case_name(case_id: str = "case_id") -> Column:
    return F.concat(F.lit("Case"), F.col(case_id).cast("string"))


def _ladder(value: int) -> Column:
    """Label (1) or relation (2) of a tag, null for a tag without one."""
    out = F.lit(None).cast("string")
    for part in reversed(LADDER):
        out = F.when(F.contains("type", F.lit(part[0])), F.lit(part[value])).otherwise(out)
    return out


def _own_name() -> Column:
    """Names of persons are their case's own."""
    return F.when(_ladder(1) == "Person", F.concat_ws("_", "word", case_name())).otherwise(F.col("word"))


def _times() -> Column:
    """Years, months and year-months written in a time, as (label, name)."""
    folded = X.fold_digits("word")
    node = lambda label: lambda name: F.struct(F.lit(label).alias("label"), name.alias("name"))
    found = F.concat(F.transform(X.years(folded), node("Year")), F.transform(X.months(folded), node("Month")), F.transform(X.year_months(folded), node("YearMonth")))
    return F.when(_ladder(1) == "Time", found).otherwise(F.slice(found, 1, 0))


def case_graph(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, name, subgraph) and edges of tokens (case_id, word, type), each once; tokens are read once for each.

    The first of LOC, PER, ORG, TIME that is a part of a token's tag decides; tokens with other or null tags give their case only.
    Times give year, month and year-month nodes besides, and year-months link to the years and months written in them.
    """
    label = _ladder(1)
    node = lambda kind, name: F.struct(kind.alias("label"), name.alias("name"))
    own = F.when(label.isNotNull(), F.array(node(label, _own_name()))).otherwise(F.array().cast("array<struct<label:string,name:string>>"))
    nodes = tokens.select(F.explode(F.concat(F.array(node(F.lit("LegalCase"), case_name())), own, _times())).alias("n")).select("n.*").distinct()

    def edge(*parts) -> Column:
        return F.struct(*[p.alias(n) for p, n in zip(parts, EDGE)])

    to_case = F.array(edge(F.lit("LegalCase"), case_name(), _ladder(2), label, _own_name()))
    to_time = F.transform(_times(), lambda t: edge(F.lit("LegalCase"), case_name(), F.lit(TO_TIME), t["label"], t["name"]))
    months = F.filter(_times(), lambda t: t["label"] == "YearMonth")
    parts = lambda m: F.filter(_times(), lambda t: (t["label"] != "YearMonth") & F.contains(m["name"], t["name"]))
    inner = F.flatten(F.transform(months, lambda m: F.transform(parts(m), lambda t: edge(F.lit("YearMonth"), m["name"], F.lit(TO_TIME), t["label"], t["name"]))))
    edges = tokens.where(label.isNotNull()).select(F.explode(F.concat(to_case, to_time, inner)).alias("e")).select("e.*").distinct()
    return nodes.withColumn("subgraph", F.lit("legalCase")), edges


def node_prefixes(tokens: DataFrame, order: list[str]) -> DataFrame:
    """label, name and prefix of persons, organisations and times: that of the last token of a name in the given order."""
    named = tokens.where(_ladder(1).isNotNull() & (_ladder(1) != "Location") & F.col("prefix").isNotNull())
    return named.groupBy(_ladder(1).alias("label"), _own_name().alias("name")).agg(F.max_by("prefix", F.struct(*order)).alias("prefix"))


def keyword_graph(articles: DataFrame, text: str, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Keyword nodes and the edges of cases to the keywords their text (case_id, text) meets."""
    hits = articles.where(F.col("case_id").isNotNull()).select(case_name().alias("src"), F.explode(search.rule_hits(text, rules)).alias("dst")).distinct()
    nodes = hits.select(F.lit("Keyword").alias("label"), F.col("dst").alias("name"), F.lit("legalCase").alias("subgraph")).distinct()
    return nodes, hits.select(F.lit("LegalCase").alias("src_label"), "src", F.lit(KEYWORD).alias("type"), F.lit("Keyword").alias("dst_label"), "dst")


def place_edges(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges of places to the listed place they are (the best alignment), and of organisations to every listed place they name."""
    near = align(nodes.where("label = 'Location'").select("name"), aliases)
    held = containing(nodes.where("label = 'Organization'").select("name"), aliases)

    def to_place(df: DataFrame, label: str, kind: str) -> DataFrame:
        return df.select(F.lit(label).alias("src_label"), F.col("name").alias("src"), F.lit(kind).alias("type"), F.lit("Location").alias("dst_label"), F.col("canonical").alias("dst"))

    return to_place(near, "Location", SAME).unionByName(to_place(held, "Organization", WITHIN)).distinct()


def relation_graph(relations: DataFrame, tokens: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of accepted relations (keys with case_id, a_idx, r_idx, b_idx): a to b by the word of r, both to their case.

    A relation one of whose tokens isn't there is left out; implied relations have their name for a word. Labels go by the
    whole tag, others are Entity; the names of persons are their case's own.
    """
    implied = F.create_map(*[F.lit(x) for name, k in IMPLIED.items() for x in (k, name)])
    out = relations.select(*keys, "a_idx", "r_idx", "b_idx").repartition(*keys).distinct()
    tokens = tokens.select(*keys, "idx", "word", "type").repartition(*keys)
    for role in "arb":
        side = tokens.select(*keys, F.col("idx").alias(f"{role}_idx"), F.struct("word", "type").alias(role))
        out = out.join(merged(side), [*keys, f"{role}_idx"], "left")
    out = materialize(out, tidy=True, in_place=True)
    told = lambda role: F.when(F.col(f"{role}_idx") < 0, F.struct(implied[F.col(f"{role}_idx")].alias("word"), F.lit(None).cast("string").alias("type"))).otherwise(F.col(role))
    out = out.withColumns({r: told(r) for r in "arb"}).where(F.col("a.word").isNotNull() & F.col("r.word").isNotNull() & F.col("b.word").isNotNull())
    case = case_name()
    name = lambda r: F.when(F.col(f"{r}.type") == "PER", F.concat_ws("_", f"{r}.word", case)).otherwise(F.col(f"{r}.word"))
    label = lambda r: X.node_label(F.col(f"{r}.type"))
    edge = lambda *parts: F.struct(*[p.alias(n) for p, n in zip(parts, EDGE)])
    own = [edge(label(r), name(r), F.lit(MEMBER), F.lit("LegalCase"), case) for r in "ab"]
    edges = out.select(F.explode(F.array(*own, edge(label("a"), name("a"), F.col("r.word"), label("b"), name("b")))).alias("e")).select("e.*").distinct()
    ends = [F.struct(label(r).alias("label"), name(r).alias("name")) for r in "ab"]
    nodes = out.select(F.explode(F.array(*ends)).alias("n")).select("n.*").distinct().withColumn("subgraph", F.lit("legalCase"))
    return nodes, edges


def upsert_nodes(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """One node per key: the latest by order of both sides, whole rows."""
    rest = [c for c in existing.columns if c not in key]
    both = existing.unionByName(new.select(*existing.columns))
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return latest.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_nodes(existing: DataFrame, new: DataFrame, key: list[str], on_match: list[str]) -> DataFrame:
    """Nodes of both sides, one per key: a node that was there takes the columns on_match from the new one where that has them, and keeps the rest."""
    rest = [c for c in existing.columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("new"))
    both = existing.groupBy(*key).agg(F.max(F.struct(*rest)).alias("old")).join(one, key, "full")
    pick = lambda c: F.when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(F.coalesce(f"new.{c}", f"old.{c}") if c in on_match else F.col(f"old.{c}"))
    return both.select(*key, *[pick(c).alias(c) for c in rest])


def new_rows(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows of new whose key isn't there yet: what an append has to write."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def link(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes of their label; several nodes of a name count once."""
    ends = nodes.select("label", "name").distinct()
    src = ends.select(F.col("label").alias("src_label"), F.col("name").alias("src"))
    dst = ends.select(F.col("label").alias("dst_label"), F.col("name").alias("dst"))
    return edges.join(src, ["src_label", "src"], "left_semi").join(dst, ["dst_label", "dst"], "left_semi").distinct()


def _char_pairs(col: str):
    """Ordered pairs of characters of a string; a string of one character is its own key."""
    n = F.length(col)
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.concat(F.substr(col, i, F.lit(1)), F.substr(col, j, F.lit(1))))))
    return F.when(n == 1, F.array(F.col(col))).otherwise(F.array_distinct(two))


def _rarest_pairs(strings: DataFrame, col: str, seen: DataFrame) -> DataFrame:
    """The pairs by which a string must be met: the rarest ones that leave out fewer pairs than any partner shares with it.

    A partner within half of the shorter length shares a subsequence of two thirds of a string at least. Where no character
    is repeated its pairs are all different, and so many less one of the commonest pairs can be left out.
    """
    n = F.length(col)
    common = F.ceil(2 * n / 3)
    shared = F.when((F.size(F.array_distinct(X.chars(F.col(col)))) == n) & (n > 1), common * (common - 1) / 2).otherwise(1)
    pairs = strings.select(col, F.explode(_char_pairs(col)).alias("pair")).join(seen, "pair", "left")
    ranked = pairs.groupBy(col).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("p"))
    kept = F.slice("p", 1, F.greatest(F.size("p") - shared.cast("int") + 1, F.lit(1)))
    return ranked.select(col, F.explode(kept).alias("x")).select(col, "x.pair")


def align(names: DataFrame, aliases: DataFrame, ratio: float = 0.5) -> DataFrame:
    """For each distinct name the best alias (pattern, canonical): least indel ratio, then canonical; never itself.

    A ratio of at most 0.5 leaves a common subsequence of at least three quarters of the shorter string, so two characters
    in order wherever that has two or more. Candidates therefore meet in an equi-join on ordered character pairs, of which
    those that most aliases hold are left out (exactly: see _rarest_pairs), and pass the length bound before any distance is
    computed. Null and empty names align with nothing.
    """
    if ratio > 0.5:
        raise ValueError("the candidate join is exact for ratios up to 0.5")
    a = names.select("name").where(F.length("name") > 0).distinct()
    b = aliases.select("pattern", "canonical").where(F.length("pattern") > 0).distinct()
    patterns = b.select("pattern").distinct()
    seen = patterns.select(F.explode(_char_pairs("pattern")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    seen = broadcast_if_small(materialize(seen), 48)
    shared = _rarest_pairs(a, "name", seen).join(_rarest_pairs(patterns, "pattern", seen), "pair")
    cand = shared.where(X.indel_may_reach("name", "pattern", ratio)).select("name", "pattern").distinct()
    least = F.greatest(F.least(F.length("pattern"), F.length("name")), F.lit(1))
    scored = cand.withColumn("score", X.indel_batch("pattern", "name") / least).where(F.col("score") <= ratio)
    best = scored.join(b, "pattern").where(F.col("canonical") != F.col("name")).groupBy("name").agg(F.min(F.struct("score", "canonical")).alias("b"))
    return best.select("name", F.col("b.canonical").alias("canonical"), F.col("b.score").alias("score"))


def containing(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names and the aliases that occur in them, by an equi-join on an alias's first two characters, or on its only one."""
    a = names.select("name").where(F.length("name") > 0).distinct()
    n = F.length("name")
    starts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array(F.substr("name", i, F.lit(1)), F.substr("name", i, F.lit(2))))
    left = a.select("name", F.explode(F.array_distinct(F.flatten(starts))).alias("gram"))
    right = aliases.where(F.length("pattern") > 0).select("pattern", "canonical", F.substring("pattern", 1, 2).alias("gram")).distinct()
    return left.join(right, "gram").where(F.contains("name", F.col("pattern"))).select("name", "canonical").distinct()


def hierarchy(divisions: DataFrame) -> DataFrame:
    """Division to the first parent given: city, else province; parents that aren't there drop out. Names, not codes."""
    up = F.coalesce("city_code", "province_code")
    parent = divisions.select(F.col("code").alias("up"), F.col("name").alias("parent"), F.col("level").alias("parent_level"))
    return divisions.withColumn("up", up).join(parent, "up").select("code", "name", "level", "parent", "parent_level").distinct()


def aliases_of(divisions: DataFrame) -> DataFrame:
    """short -> name and name -> name."""
    short = divisions.select(F.col("short").alias("pattern"), F.col("name").alias("canonical"))
    own = divisions.select(F.col("name").alias("pattern"), F.col("name").alias("canonical"))
    return short.unionByName(own).distinct()


def ontology(triples: DataFrame, targets: DataFrame) -> DataFrame:
    """Entities with the objects of each of their predicates (in triple order), and bare entities for targets never seen.

    triples has seq, a, r, b; targets has pattern, canonical. Out: name, props (map of predicate to joined objects).
    """
    seen = triples.join(broadcast_if_small(targets, 64), triples["a"] == targets["pattern"]).select("canonical", "r", "seq", "b")
    per = seen.groupBy("canonical", "r").agg(F.array_sort(F.collect_list(F.struct("seq", "b"))).alias("o"))
    per = per.select("canonical", "r", F.array_join(F.transform("o", lambda x: x["b"]), ";").alias("v"))
    full = per.groupBy(F.col("canonical").alias("name")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "v")))).alias("props"))
    bare = targets.select(F.col("canonical").alias("name")).distinct().join(full, "name", "left_anti")
    return full.unionByName(bare.withColumn("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def ontology_of(provinces: DataFrame, cities: DataFrame, areas: DataFrame, nations: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities and targets of the three levels of a division list (code, name, provinceCode, cityCode where there are such).

    Entities: name, type, code, short, province_code, city_code; of several divisions of a name the one of the lowest level and
    then of the greatest code stands for it. Targets: pattern (short or whole name) to canonical name, the same way.
    """
    levels = [(provinces, "ProvinceName"), (cities, "CityName"), (areas, "AreaName")]
    rows = None
    for k, (df, level) in enumerate(levels):
        code = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")  # noqa: B023, E731
        one = df.where(F.col("name").isNotNull()).select("name", F.lit(level).alias("type"), F.col("code"), code("provinceCode").alias("province_code"), code("cityCode").alias("city_code"), F.lit(k).alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("short", X.short_name("name", "type", nations))
    latest = F.struct("rank", "code")
    entities = rows.groupBy("name").agg(F.max_by(F.struct("type", "code", "short", "province_code", "city_code"), latest).alias("e")).select("name", "e.*")
    pairs = rows.select(F.explode(F.array("short", "name")).alias("pattern"), F.col("name").alias("canonical"), "rank", "code")
    return entities, pairs.groupBy("pattern").agg(F.max_by("canonical", latest).alias("canonical"))
