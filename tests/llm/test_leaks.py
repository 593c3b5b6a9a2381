import random
import re
import unicodedata

from lexigraph.llm import leaks


def distance(pattern, text):
    """Least edit distance of the pattern to any stretch, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("ab中") for _ in range(rng.randint(0, 40)))
        t = "".join(rng.choice("ab中") for _ in range(rng.randint(0, 50)))
        assert leaks.myers(p, t) == distance(p, t)


def test_letters_and_digits():
    assert leaks.letters_digits("Ａｂ－１２ ｶﾞ《中》_é") == "ab12ガ中é"


def run_of(a, b, n):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


def test_found_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefgh中国法院") for _ in range(k))
    items = [(i, word(rng.randint(30, 120))) for i in range(12)] + [(20, None), (21, ""), (22, "short")]
    docs = []
    for d in range(60):
        t = items[rng.randrange(12)][1]
        s, n = rng.randrange(0, 20), rng.choice([20, 31, 32, 33, 60])
        part = t[s : s + n]
        part = " ".join(part[i : i + 7] for i in range(0, len(part), 7)).upper() if d % 2 else part
        docs.append((d, word(30) + "，" + part + "。" + word(25), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, items[0][1] * 50, "x"), (102, items[0][1] * 50, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item string")
    it = spark.createDataFrame(items, "item_id int, text string")
    norm = lambda t: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", t).lower())
    want = {(d, i) for d, t, _ in docs if t for i, x in items if x and run_of(norm(x), norm(t), 32)}
    got = leaks.leaked_items(df, it, "doc_id", "text", "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in got.where("exact").collect()} == want
    assert got.count() == got.select("doc_id", "item_id").distinct().count()


def test_one_edit_is_found_but_not_exact(spark):
    item = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".lower()[:40]
    doc = "zz" + item[:20] + "!" + item[21:32] + "qq"  # character 20 is missing
    df = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = leaks.leaked_items(df, it, "doc_id", "text", "item_id", "text").collect()
    assert [(r.distance, r.exact) for r in got] == [(1, False)]


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 50)
    items = [(i, chr(0x4E00 + i) * 3 + "abcdefghijklmnopqrstuvwxyz0123456789" + chr(0x4E00 + i)) for i in range(5)]
    it = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(1, items[2][1])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, it, "doc_id", "text", "item_id", "text").collect()} == {(1, i) for i in range(5)}
    assert leaks.leaked_items(df.limit(0), it, "doc_id", "text", "item_id", "text").collect() == []
    assert leaks.leaked_items(df, it.limit(0), "doc_id", "text", "item_id", "text").collect() == []


def edited(part, at, kind, new="é"):
    return {"change": part[:at] + new + part[at + 1 :], "drop": part[:at] + part[at + 1 :], "add": part[:at] + new + part[at:]}[kind]


def test_one_edit_is_found_at_every_offset_and_position():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(67))
    known = leaks.Items([(1, item)], 32, 1)
    missed = [
        (s, at, kind)
        for s in range(len(item) - 31)
        for at in range(32)
        for kind in ("change", "drop", "add")
        if known.search("ÄÖ" + edited(item[s : s + 32], at, kind) + "ÜÑ").get(1, (9, False))[0] > 1
    ]
    assert missed == []


def test_edits_equal_brute_force():
    rng = random.Random(9)
    for errors in (0, 1, 2, 3):
        for _ in range(60):
            item = "".join(rng.choice("abcdefgh中国法院") for _ in range(rng.randint(32, 50)))
            s = rng.randrange(len(item) - 31)
            text = item[s : s + 32]
            for _ in range(rng.randint(0, errors + 1)):
                text = edited(text, rng.randrange(len(text)), rng.choice(["change", "drop", "add"]))
            text = "ÄÖ" + text + "ÜÑ"
            least = min(distance(item[i : i + 32], text) for i in range(len(item) - 31))
            got = leaks.Items([(1, item)], 32, errors).search(text)
            assert {k: v[0] for k, v in got.items()} == ({1: least} if least <= errors else {})


def test_items_of_one_text_are_matched_once_and_all_reported(spark):
    text = "abcdefghijklmnopqrstuvwxyz0123456789"
    it = spark.createDataFrame([(i, text) for i in (5, 3, 9)] + [(5, text), (7, "another text, which nobody leaks to anyone at all")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x" + text), (2, "none")], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in leaks.leaked_items(df, it, "doc_id", "text", "item_id", "text").collect()) == [(1, 3), (1, 5), (1, 9)]
    assert sum(len(b) for b in leaks._blocks(it.groupBy("text").agg({"item_id": "min"}).toDF("text", "id"))) == 2
