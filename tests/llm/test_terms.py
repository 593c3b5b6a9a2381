import math
from collections import defaultdict

import pytest

from lexigraph.llm import terms

SCHEMA = "case_id long, pos int, word string, type string, term string, record string"


def rows():
    out = []
    for c in range(30):
        words = ["，", "被告人", f"w{c % 7}", "，", f"u{c}", "", None]
        out += [(c, i, w, "n" if i % 2 else "w", "clash", "clash") for i, w in enumerate(words)]
    out += out[:40]  # delivered again
    out += [(7, 60, "a\x1fb:3", "n:\x1f", "", ""), (7, 61, "3:", "1:x", "", ""), (7, 62, "12:\n", "：", "", "")]
    out += [(None, 1, "x", "n", "", ""), (3, None, "，", "w", "", ""), (99, 0, "", "n", "", ""), (3, 50, "长" * 5000, None, "", "")]
    return out


def test_counts_equal_brute_force(spark):
    occ, pres = defaultdict(set), defaultdict(set)
    cases = set()
    for c, p, w, t, *_ in rows():
        if c is not None:
            cases.add(c)
            if w and t:
                occ[w, t].add((c, p))
                pres[w, t].add(c)
    want = {k: (len(occ[k]), len(pres[k]), len(cases), "rare" if len(pres[k]) < 3 else "common" if len(pres[k]) > len(cases) / 2 else None) for k in occ}
    got = terms.term_counts(spark.createDataFrame(rows(), SCHEMA), "case_id", "pos", "word", "type").collect()
    assert {(r.word, r.type): (r.n_occurrences, r.n_records, r.n_all, r.mark) for r in got} == want


def test_dictionary_numbers_terms_in_order(spark):
    df = spark.createDataFrame([(f"t{i % 500:03d}",) for i in range(2000)], "term string")
    got = sorted((r.id, r.term) for r in terms.dictionary(df).collect())
    assert got == [(i, f"t{i:03d}") for i in range(500)]


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert terms.term_counts(empty, "case_id", "pos", "word", "type").collect() == []
    cases = spark.createDataFrame([], "case_id long, accusation string")
    assert terms.distinctive_terms(empty, cases, "case_id", "pos", "word", "accusation").collect() == []


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_scores_equal_the_formula(spark, limit):
    cases = [(c, "A" if c < 10 else "B" if c < 25 else None) for c in range(30)] + [(1, "A"), (500, "C"), (None, "A")]
    tf, df, n_in = defaultdict(set), defaultdict(set), defaultdict(set)
    cls = {c: a for c, a in cases if c is not None and a}
    for c, p, w, *_ in rows():
        if c in cls:
            n_in[cls[c]].add(c)
            if w:
                tf[cls[c], w].add((c, p))
                df[cls[c], w].add(c)
    length = defaultdict(int)
    total = defaultdict(int)
    for (a, w), v in tf.items():
        length[a] += len(v)
        total[w] += len(v)
    mean = sum(length.values()) / len(length)
    got = terms.distinctive_terms(spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(cases, "case_id long, accusation string"), "case_id", "pos", "word", "accusation", broadcast_limit=limit).collect()
    assert {(r.accusation, r.word) for r in got} == set(tf)
    for r in got:
        k = r.accusation, r.word
        lam, tfn = total[r.word] / len(length), len(tf[k]) * math.log2(1 + mean / length[r.accusation])
        assert math.isclose(r.score, (math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1), rel_tol=1e-9)
        assert (r.tf, r.df, r.n_in) == (len(tf[k]), len(df[k]), len(n_in[r.accusation]))
        assert r.df_out == sum(len(v) for (a, w), v in df.items() if w == r.word and a != r.accusation)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_a_record_that_holds_most_rows(spark, limit):
    """Repeated deliveries count once, whichever way the records meet their groups."""
    hot = [(1, i, f"w{i % 50}", "n", "", "") for i in range(1000)]
    df = spark.createDataFrame([*hot, *hot, (2, 0, "w1", "n", "", "")], SCHEMA)
    cases = spark.createDataFrame([(1, "A"), (2, "B")], "case_id long, accusation string")
    got = {(r.accusation, r.word): (r.tf, r.df) for r in terms.distinctive_terms(df, cases, "case_id", "pos", "word", "accusation", broadcast_limit=limit).collect()}
    assert got == {**{("A", f"w{i}"): (20, 1) for i in range(50)}, ("B", "w1"): (1, 1)}
