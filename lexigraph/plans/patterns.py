"""Path patterns over dependency trees, compiled to equi-joins.

A pattern is `(a)<-[:dep]-(b)` style text: `<-[:dep]-` steps to a child with that label, `-[:dep]->` to the parent of a token
with that label; `()` is a node without a role. `path ?name` gives a and b with an implied relation, `path1,path2` gives
a-r and r-b. The text is parsed on the driver; each step becomes one sort-merge join on (keys, idx).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.session import merged

# Numbers of the implied relations and of the default characters.
IMPLIED = {"is": -1, "has": -2, "in": -3, "with": -4, "at": -5}
CHARACTERS = {"jud": -6, "pol": -7, "pro": -8, "vic": -9, "cri": -10}
NODE = re.compile(r"\(([a-z]?)\)")
STEP = re.compile(r"<-\[:([\w:]+)\]-|-\[:([\w:]+)\]->")


@dataclass(frozen=True)
class Path:
    """Roles of the nodes (empty for none) and the steps between them: (child or parent, label)."""

    roles: tuple[str, ...]
    steps: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Pattern:
    text: str
    paths: tuple[Path, ...]
    implied: str | None


def parse_path(text: str) -> Path:
    at, roles, steps = 0, [], []
    text = text.replace(" ", "")
    while True:
        m = NODE.match(text, at)
        if not m:
            raise ValueError(f"no node at {at} of {text!r}")
        roles.append(m[1])
        at = m.end()
        if at == len(text):
            break
        m = STEP.match(text, at)
        if not m:
            raise ValueError(f"no step at {at} of {text!r}")
        steps.append(("child", m[1]) if m[1] else ("parent", m[2]))
        at = m.end()
    named = [r for r in roles if r]
    if len(named) != len(set(named)):
        raise ValueError(f"a role occurs twice in {text!r}")
    return Path(tuple(roles), tuple(steps))


def parse(text: str) -> Pattern:
    """A compiled pattern; raises ValueError for text that is none."""
    body, mark, implied = text.partition("?")
    paths = tuple(parse_path(p) for p in body.split(","))
    if mark:
        if len(paths) != 1 or implied.strip() not in IMPLIED or not {"a", "b"} <= set(paths[0].roles):
            raise ValueError(f"{text!r} is no path with an implied relation")
    elif len(paths) != 2 or not {"a", "r"} <= set(paths[0].roles) or not {"r", "b"} <= set(paths[1].roles):
        raise ValueError(f"{text!r} is no pair of paths a-r and r-b")
    return Pattern(text, paths, implied.strip() or None)


def match_path(tokens: DataFrame, path: Path, keys: list[str], known: str = "") -> DataFrame:
    """keys and <role>_idx of every full match; tokens has keys, idx, head, dep.

    Of the role `known`, if it opens the path, the token need not be there: the caller joins it to one that is.
    """
    slim = tokens.select(*keys, "idx", "head", "dep")
    cur = slim.select(*keys, *[F.col(c).alias(f"n0_{c}") for c in ("idx", "head", "dep")])
    for k, (way, dep) in enumerate(path.steps):
        here, there = f"n{k}", f"n{k + 1}"
        nxt = slim.select(*keys, *[F.col(c).alias(f"{there}_{c}") for c in ("idx", "head", "dep")])
        if way == "child":
            nxt = nxt.where(F.col(f"{there}_dep") == dep).withColumn(f"{here}_idx", F.col(f"{there}_head"))
            if not k and known and path.roles[0] == known:
                cur = nxt
                continue
            cur = cur.join(merged(nxt), [*keys, f"{here}_idx"])
        else:
            cur = cur.where(F.col(f"{here}_dep") == dep).withColumn(f"{there}_idx", F.col(f"{here}_head"))
            cur = cur.join(merged(nxt), [*keys, f"{there}_idx"])
    named = [(k, r) for k, r in enumerate(path.roles) if r]
    out = cur.select(*keys, *[F.col(f"n{k}_idx").alias(f"{r}_idx") for k, r in named])
    for i, (_, r) in enumerate(named):
        for _, q in named[i + 1 :]:
            out = out.where(F.col(f"{r}_idx") != F.col(f"{q}_idx"))
    return out.distinct()


def match(tokens: DataFrame, pattern: str | Pattern, keys: list[str]) -> DataFrame:
    """keys, a_idx, r_idx (negative for an implied relation), b_idx of every match, once; roles are bound by name."""
    p = parse(pattern) if isinstance(pattern, str) else pattern
    first = match_path(tokens, p.paths[0], keys)
    if p.implied:
        return first.select(*keys, "a_idx", F.lit(IMPLIED[p.implied]).alias("r_idx"), "b_idx")
    second = match_path(tokens, p.paths[1], keys, known="r")
    both = first.select(*keys, "a_idx", "r_idx").join(merged(second.select(*keys, "r_idx", "b_idx")), [*keys, "r_idx"])
    return both.where(F.col("a_idx") != F.col("b_idx")).select(*keys, "a_idx", "r_idx", "b_idx").distinct()


def match_all(tokens: DataFrame, patterns: list[str], keys: list[str]) -> DataFrame:
    """Matches of several patterns with the pattern's text."""
    out = None
    for text in patterns:
        one = match(tokens, text, keys).withColumn("pattern", F.lit(text))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no pattern given")
    return out
