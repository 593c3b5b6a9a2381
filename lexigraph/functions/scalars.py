"""Scalar functions as column expressions; all but indel_batch stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Part-of-speech tags of the segmenter and what they map to.
PENN = {
    "n": "NN", "nr": "NR", "nz": "NR", "a": "", "m": "", "c": "CC", "PER": "NR", "f": "", "ns": "NR", "v": "VV", "ad": "", "q": "M", "u": "",
    "LOC": "NR", "s": "", "nt": "NR", "vd": "", "an": "", "r": "PN", "xc": "", "t": "NT", "nw": "NR", "vn": "", "d": "AD", "p": "P", "w": "PU",
    "TIME": "NT", "[D:PROSECUTOR]": "NR", "[D:LEGAL_NOUN]": "NN", "[D:NOUN_LEGAL]": "NN", "[D:NR]": "NR", "ORG": "NR", "BAD": "",
}
TAG_NUMBER = {
    "n": 0, "nr": 1, "nz": 2, "a": 3, "m": 4, "c": 5, "PER": 6, "f": 7, "ns": 8, "v": 9, "ad": 10, "q": 11, "u": 12, "LOC": 13, "s": 14, "nt": 15,
    "vd": 16, "an": 17, "r": 18, "xc": 19, "t": 20, "nw": 21, "vn": 22, "d": 23, "p": 24, "w": 25, "TIME": 26, "[D:PROSECUTOR]": 27, "ORG": 28,
    "[D:LEGAL_NOUN]": 30, "[D:NOUN_LEGAL]": 30, "[D:NR]": 30,
}
OTHER_TAG = 99
LABEL = {"PER": "Person", "ORG": "Organization", "TIME": "Time", "n": "Entity", "nr": "Entity", "LOC": "Location", "nz": "Entity", "nw": "Entity", "v": "Action"}
# Fixed value: punctuation that a property key loses.
KEY_NOISE = "、，。?：/\\；”“{}[](),.?;:（）【】！@#￥%……&*!@#$%^&* ​"
#: Chinese digits and what they fold to; ten folds to 1.
DIGITS, FOLDED = "零一二三四五六七八九十", "01234567891"
PROVINCE_ENDS, CITY_ENDS, AREA_ENDS = ("自治区", "省", "市"), ("自治州", "地区", "市"), ("自治县", "市", "县")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars(x: Column) -> Column:
    """Characters of a string; empty for the empty string."""
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, ""))


def indel(a: Column | str, b: Column | str) -> Column:
    """Edit distance with insertions and deletions of 1 and substitutions of 2; null if either side is null.

    Row-wise dynamic programme: the fold over a's characters carries one row of the table, the fold over b's builds the next.
    """
    x, y = _col(a), _col(b)
    first = F.transform(F.sequence(F.lit(0), F.length(y)), lambda i: i.cast("int"))

    def step(row: Column, c: Column) -> Column:
        start = F.array((row[0] + 1).cast("int"))
        return F.aggregate(
            F.sequence(F.lit(1), F.length(y)),
            start,
            lambda made, j: F.concat(
                made,
                F.array(F.least(row[j] + 1, F.element_at(made, -1) + 1, row[j - 1] + F.when(F.substr(y, j, F.lit(1)) == c, 0).otherwise(2)).cast("int")),
            ),
        )

    table = F.aggregate(chars(x), first, step)
    return F.when(x.isNull() | y.isNull(), None).when(F.length(y) == 0, F.length(x)).otherwise(F.element_at(table, -1))


def _indel(a: str | None, b: str | None) -> int | None:
    """len a + len b - 2 * longest common subsequence, the latter from bit vectors over a."""
    if a is None or b is None:
        return None
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) + len(b) - 2 * (len(a) - v.bit_count())


@F.pandas_udf(T.IntegerType())
def indel_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel in Arrow batches: for many pairs it beats the expression, whose fold builds an array per cell."""
    return pd.Series([_indel(x, y) for x, y in zip(a, b)], dtype="Int32")


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """indel over the shorter length, at least 1."""
    return indel(a, b) / F.greatest(F.least(F.length(_col(a)), F.length(_col(b))), F.lit(1))


def indel_may_reach(a: Column | str, b: Column | str, ratio: float) -> Column:
    """False where the lengths alone put indel_ratio above ratio."""
    la, lb = F.length(_col(a)), F.length(_col(b))
    return F.abs(la - lb) <= ratio * F.greatest(F.least(la, lb), F.lit(1))


def common_substring(a: Column | str, b: Column | str) -> Column:
    """Longest common substring; the first in a where several are as long, empty where none is."""
    x, y = _col(a), _col(b)
    n = F.length(x)
    pieces = F.transform(
        F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct((j - i + 1).alias("size"), (-i).alias("at"), F.substr(x, i, j - i + 1).alias("s"))))),
        lambda p: p,
    )
    return F.coalesce(F.array_max(F.filter(pieces, lambda p: F.contains(y, p["s"])))["s"], F.when(x.isNotNull() & y.isNotNull(), F.lit("")))


def related_ratio(a: Column | str, b: Column | str) -> Column:
    """indel_ratio after a common suffix that is the longest common substring of both, and neither of them, is taken off."""
    x, y = _col(a), _col(b)
    s = common_substring(x, y)
    both = (F.length(s) > 0) & F.endswith(x, s) & F.endswith(y, s) & (x != s) & (y != s)
    cut = lambda v: F.when(both, F.substr(v, F.lit(1), F.length(v) - F.length(s))).otherwise(v)
    return indel_ratio(cut(x), cut(y))


def property_key(value: Column | str) -> Column:
    """A property key: an underscore before a leading ASCII digit, punctuation and blanks dropped; empty stays empty."""
    v = _col(value)
    led = F.when(v.rlike("^[0-9]"), F.concat(F.lit("_"), v)).otherwise(v)
    return F.translate(led, KEY_NOISE, "")


def short_name(name: Column | str, level: Column | str, nations: list[str], strip_districts: bool = False) -> Column:
    """Division name without its level's suffix and without names of peoples at its end, longest first.

    A name that would be left empty stays whole; 内蒙古 keeps its people. Districts keep 区 unless asked.
    """
    v, lv = _col(name), _col(level)

    def cut(ends: tuple[str, ...]) -> Column:
        return F.regexp_replace(v, f"(?:{'|'.join(ends)})$", "")

    areas = AREA_ENDS + (("(?<!发)区",) if strip_districts else ())
    bare = F.when(lv == "ProvinceName", cut(PROVINCE_ENDS)).when(lv == "CityName", cut(CITY_ENDS)).otherwise(cut(areas))
    bare = F.when(bare == "", v).otherwise(bare)
    if not nations:
        return bare
    people = "|".join(sorted(nations, key=lambda x: (-len(x), x)))
    without = F.regexp_replace(bare, f"(?:{people})+$", "")
    return F.when((bare == "内蒙古") | (without == ""), bare).otherwise(without)


def fold_digits(text: Column | str) -> Column:
    return F.translate(_col(text), DIGITS, FOLDED)


def years(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit("[0-9]{4}年"), F.lit(0))


def months(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit("[0-9]{1,2}月"), F.lit(0))


def year_months(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit("[0-9]{4}年[0-9]{1,2}月"), F.lit(0))


def _mapped(table: dict, key: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[_col(key)]


def penn_tag(tag: Column | str) -> Column:
    """Penn tag; null for an unknown tag, empty for one without a counterpart."""
    return _mapped(PENN, tag)


def tag_number(tag: Column | str) -> Column:
    return F.coalesce(_mapped(TAG_NUMBER, tag), F.lit(OTHER_TAG))


def node_label(tag: Column | str) -> Column:
    return F.coalesce(_mapped(LABEL, tag), F.lit("Entity"))


def render(word: Column | str, tag: Column | str) -> Column:
    """word/PENN, or the bare word where there is no Penn tag."""
    p = penn_tag(tag)
    return F.when(p.isNull() | (p == ""), _col(word)).otherwise(F.concat_ws("/", _col(word), p))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, e: s + e)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; null for a null, an all-zero vector, or unequal lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (F.size(_col(a)) == F.size(_col(b))), 1 - dot(a, b) / norm)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of distinct elements in common; null where both are empty."""
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union > 0, F.size(F.array_intersect(_col(a), _col(b))) / union)


def clamp_position(p: Column | str, shift: int = 60, top: int = 120) -> Column:
    """Relative position moved to 0..top."""
    return F.least(F.greatest(_col(p) + shift, F.lit(0)), F.lit(top))


def fixed_length(a: Column | str, size: int, fill: int) -> Column:
    """First size elements, filled up to size."""
    v = _col(a)
    return F.concat(F.slice(v, 1, size), F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(v), F.lit(0)).cast("int")))


def strip_breaks(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "\r\n|\n", "")


def scoped_name(word: Column | str, tag: Column | str, case: Column | str) -> Column:
    """Names of persons are scoped to their case."""
    return F.when(_col(tag) == "PER", F.concat_ws("_", _col(word), _col(case))).otherwise(_col(word))
