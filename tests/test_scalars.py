import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions import scalars as X


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else 2)))
        row = new
    return row[-1]


def substring(a, b):
    best = ""
    for i in range(len(a)):
        for j in range(i + 1, len(a) + 1):
            if j - i > len(best) and a[i:j] in b:
                best = a[i:j]
    return best


def one(spark, value, *cols):
    df = spark.createDataFrame([tuple(value)], ", ".join(f"c{i} string" for i in range(len(value))))
    return tuple(df.select(*cols).first())


@pytest.mark.parametrize(("a", "b", "want"), [("盘县", "六盘水市", 4), ("abc", "axc", 2), ("", "abc", 3), ("abc", "", 3), ("", "", 0), (None, "a", None)])
def test_indel_cases(spark, a, b, want):
    assert one(spark, [a, b], X.indel("c0", "c1")) == (want,)


def test_indel_ratio_rejects_at_half(spark):
    assert one(spark, ["盘县", "六盘水市"], X.indel_ratio("c0", "c1")) == (2.0,)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("ab县c", max_size=6), st.text("ab县c", max_size=6)), min_size=1, max_size=20))
def test_indel_and_substring_match_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.indel("a", "b").alias("d"), X.common_substring("a", "b").alias("s"), X.indel_may_reach("a", "b", 0.5).alias("m"), X.indel_batch("a", "b").alias("e"))
    for r in df.collect():
        assert r.d == r.e == indel(r.a, r.b)
        assert len(r.s) == len(substring(r.a, r.b)) and r.s in r.a and r.s in r.b
        if indel(r.a, r.b) / max(min(len(r.a), len(r.b)), 1) <= 0.5:
            assert r.m


def test_common_substring_is_the_right_one(spark):
    assert one(spark, ["aba", "ca"], X.common_substring("c0", "c1")) == ("a",)


def test_related_ratio_takes_off_a_common_suffix(spark):
    assert one(spark, ["甲开发区", "乙开发区"], X.related_ratio("c0", "c1")) == (2.0,)
    assert one(spark, ["开发区", "乙开发区"], X.related_ratio("c0", "c1")) == (pytest.approx(1 / 3),)


@pytest.mark.parametrize(("value", "want"), [("1a (b)", "_1ab"), ("", ""), ("甲，乙", "甲乙"), (None, None)])
def test_property_key(spark, value, want):
    assert one(spark, [value], X.property_key("c0")) == (want,)


def test_digits_and_dates(spark):
    assert one(spark, ["二零一六年十二月"], X.fold_digits("c0")) == ("2016年12月",)
    assert one(spark, ["二十"], X.fold_digits("c0")) == ("21",)
    assert one(spark, ["2016年4月8日"], X.years("c0"), X.months("c0"), X.year_months("c0")) == (["2016年"], ["4月"], ["2016年4月"])


@pytest.mark.parametrize(("name", "level", "want"), [("莲坞泽族自治县", "AreaName", "莲坞"), ("内蒙古自治区", "ProvinceName", "内蒙古"), ("城中区", "AreaName", "城中区"), ("市", "CityName", "市"), ("泽族自治州", "CityName", "泽族")])
def test_short_name(spark, name, level, want):
    assert one(spark, [name, level], X.short_name("c0", "c1", ["泽族", "蒙古"])) == (want,)


def test_tags(spark):
    assert one(spark, ["PER"], X.penn_tag("c0"), X.tag_number("c0"), X.node_label("c0")) == ("NR", 6, "Person")
    assert one(spark, ["??"], X.penn_tag("c0"), X.tag_number("c0"), X.node_label("c0")) == (None, 99, "Entity")
    assert one(spark, ["词", "n"], X.render("c0", "c1")) == ("词/NN",)
    assert one(spark, ["词", "m"], X.render("c0", "c1")) == ("词",)


def test_vectors_and_sequences(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1, 2]), ([0.0, 0.0], [1.0, 1.0], []), (None, [1.0], None)], "a array<float>, b array<float>, c array<int>")
    got = df.select(X.cosine_distance("a", "b").alias("d"), X.fixed_length("c", 3, 9).alias("f"), X.jaccard("a", "b").alias("j")).collect()
    assert [r.d for r in got] == [1.0, None, None]
    assert [r.f for r in got] == [[1, 2, 9], [9, 9, 9], None]
    assert got[0].j == 1.0
    assert [r[0] for r in spark.range(3).select(X.clamp_position((F.col("id") * 1000) - 100)).collect()] == [0, 120, 120]


def test_scoped_names_and_breaks(spark):
    assert one(spark, ["周某", "PER", "Case28"], X.scoped_name("c0", "c1", "c2")) == ("周某_Case28",)
    assert one(spark, ["a\r\nb\nc"], X.strip_breaks("c0")) == ("abc",)
