import datetime as dt

import pytest

from lexigraph.llm import places

T0 = dt.datetime(2020, 1, 1)
REF = [
    ("ProvinceName", "84", "桂坞省", "桂坞", None, None),
    ("CityName", "8401", "云滩市", "云滩", "84", None),
    ("AreaName", "840101", "桦崖区", "桦崖", "84", "8401"),
    ("AreaName", "840102", "梅谷泽族自治县", "梅谷", "84", "8401"),
    ("AreaName", "840103", "新城区", "新城", "84", "8401"),
    ("ProvinceName", "85", "菱寨省", "菱寨", None, None),
    ("CityName", "8501", "粟圩地区", "粟圩", "85", None),
    ("AreaName", "850101", "新城区", "新城", "85", "8501"),
    ("AreaName", "850102", "桦川县", "桦川", "85", "8501"),
]
RSCHEMA = "level string, code string, name string, short string, province_code string, city_code string"
SCHEMA = "loc_id long, type string, name string, short string, province_code string, city_code string, loaded_at timestamp, id string, stem string"

CASES = [
    ((None, "桦崖区", None, None, None), "840101"),
    (("AreaName", "桂坞省云滩市桦崖区", None, None, None), "840101"),
    (("AreaName", "云滩桦崖", None, None, None), "840101"),
    (("AreaName", "　“桦 崖”(原)?", None, "84", None), "840101"),
    (("AreaName", "樺崖区", None, None, None), "840101"),
    (("AreaName", "崖桦区", None, None, None), "840101"),
    (("AreaName", "桦桦崖区", None, None, None), "840101"),
    (("AreaName", "桦平崖", None, None, None), "840101"),
    (("AreaName", "平崖区", "桦崖", None, None), "840101"),
    (("AreaName", "梅古泽族自治县", None, "84", "8401"), "840102"),
    (("AreaName", "梅谷县", None, None, None), "840102"),
    (("AreaName", None, "新城区", "85", "8501"), "850101"),
    (("AreaName", "新城区", None, None, None), "none"),
    (("AreaName", "菱寨省新城区", None, None, None), "850101"),
    (("AreaName", "菱寨省桦崖区", None, None, None), "none"),
    (("CityName", "桂坞云滩", "云滩", None, None), "8401"),
    (("CityName", "桦崖区", None, None, None), "none"),
    (("AreaName", "桦崖区", None, "85", None), "none"),
    (("AreaName", "鲁布格洛镇", "鲁布", "84", None), "none"),
    ((None, "不详", "不详", None, None), "none"),
    ((None, "——", None, None, None), "none"),
    ((None, "长" * 3000, None, None, None), "none"),
]


def rows():
    return [(i, *c, T0, "clash", "clash") for i, (c, _) in enumerate(CASES)]


def test_cases(spark):
    df = spark.createDataFrame([*rows(), *rows()[:5]], SCHEMA)
    got = {r.loc_id: r.code for r in places.match_places(df, spark.createDataFrame(REF, RSCHEMA), "loc_id").collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_blank_rows_late_deliveries_and_empty_tables(spark):
    odd = [(1, None, " ", "　", None, None, T0, "", ""), (2, None, None, None, None, None, T0, "", ""), (None, None, "桦崖区", None, None, None, T0, "", ""), (3, None, "桦崖区", None, None, None, T0, "", ""), (3, None, "桦川县", None, None, None, T0 + dt.timedelta(1), "", "")]
    df, ref = spark.createDataFrame(odd, SCHEMA), spark.createDataFrame(REF, RSCHEMA)
    assert [tuple(r)[:2] for r in places.match_places(df, ref, "loc_id").collect()] == [(3, "850102")]
    assert places.match_places(df.limit(0), ref, "loc_id").collect() == []
    assert [tuple(r)[:2] for r in places.match_places(df, ref.limit(0), "loc_id").collect()] == [(3, "none")]


LONG = [("CityName", "8502", "古楼达坂托尔苏木州", "古楼达坂托尔苏木", "85", None), ("AreaName", "850201", "桦崖区", "桦崖", "85", "8502")]
FAR = [
    ("桂坞省云滩市桂坞省云滩市桦崖区", "840101"),  # five levels named
    ("桂坞省、云滩市、桂坞省、云滩市、桂坞省、云滩市、桦崖区", "840101"),
    ("桂坞云滩桂坞云滩桦崖", "840101"),  # ten characters without a suffix
    ("古楼达坂托尔苏木", "8502"),
    ("古楼坂托尔苏术", "8502"),  # two edits in eight characters
    ("菱寨古楼达板托尔苏木", "8502"),
    ("古楼坂托尔术", "none"),  # three
    ("古楼达坂托尔苏木桦崖区", "850201"),
    ("菱寨省古楼坂托尔苏木州桦崖区", "850201"),
    ("菱寨省云滩市桦崖区", "none"),  # no such chain of parents
    ("長" * 3000 + "省樺崖區", "none"),
]


def test_names_of_many_levels_and_long_names(spark):
    df = spark.createDataFrame([(i, None, t, None, None, None, T0, "", "") for i, (t, _) in enumerate(FAR)], SCHEMA)
    got = {r.loc_id: r.code for r in places.match_places(df, spark.createDataFrame(REF + LONG, RSCHEMA), "loc_id").collect()}
    assert got == {i: want for i, (_, want) in enumerate(FAR)}


def test_one_question_asked_by_most_rows(spark):
    df = spark.createDataFrame([(i, None, "桂坞省云滩市桦崖区", None, None, None, T0, "", "") for i in range(500)] + [(1000, None, "桦川县", None, None, None, T0, "", "")], SCHEMA)
    got = {r.loc_id: r.code for r in places.match_places(df, spark.createDataFrame(REF, RSCHEMA), "loc_id").collect()}
    assert got == {**{i: "840101" for i in range(500)}, 1000: "850102"}


def test_all_parts_of_a_name_are_kept():
    assert places.cuts("甲省乙市丙县丁区戊己") == ["甲", "乙", "丙", "丁", "戊己"]
    assert places.readings(["甲乙", "丙丁戊己"], 3) == [("戊己", ["甲乙", "丙丁"])]
    assert places.readings(["甲乙丙丁戊"], 3) == [("丙丁戊", ["甲乙"]), ("丁戊", ["甲乙丙"])]
    assert places.readings(["甲乙"], 3) == [("甲乙", [])]


def test_characters_of_the_whole_mapping(spark):
    table = places.simplified(spark)
    assert len(table) > 2000 and places.clean("廣東（舊）臺灣　龜龍", table) == "广东台湾龟龙"


@pytest.mark.parametrize(("a", "b", "least", "most"), [("ab", "ab", 1, 1), ("ba", "ab", 0.7, 0.8), ("axb", "ab", 0.7, 0.8), ("a", "ab", 0.5, 0.6), ("xb", "ab", 0.5, 0.5), ("xy", "ab", 0, 0), ("abcd", "ab", 0, 0), ("abcdefxx", "abcdefgh", 0.7, 0.8), ("abcdexxx", "abcdefgh", 0, 0)])
def test_similarity_comes_from_the_distance(a, b, least, most):
    assert least <= places.similar(a, b) <= most


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def one_edit(a, b):
    return plain(a, b) <= 1 or len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))


def test_repair_finds_every_word_within_its_edits(spark):
    import itertools
    import random

    rng = random.Random(3)
    words = ["".join(p) for p in itertools.product("abc", repeat=3)] + ["".join(rng.choice("abc") for _ in range(n)) for n in (7, 8, 8, 9, 11, 12, 13, 16) for _ in range(4)]
    stems = ["".join(p) for k in (2, 3, 4) for p in itertools.product("abd", repeat=k)]
    for w in words[27:]:
        for n in range(6):
            t = list(w)
            for _ in range(n):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["d"], [t[at], "d"]])
            stems.append("".join(t))
    got = places.repair(spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame([(w,) for w in words], "word string"), 16)
    want = {(s, w) for s in stems if s for w in words if (one_edit(s, w) if len(w) <= 7 else plain(s, w) <= len(w) // 4)}
    assert {(r.stem, r.word) for r in got.collect()} == want
