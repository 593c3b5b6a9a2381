import random

import numpy as np
import pytest

from lexigraph.llm import private

SUR, GIVEN = "王李张刘陈杨黄周吴徐孙马", "佳宇雅思若子明国建文秀英"
STEM, STREET = "桂云桦梅松柏竹兰荷菊", "安宁和庆丰"


def name(rng):
    return rng.choice(SUR) + "".join(rng.choice(GIVEN) for _ in range(rng.randint(1, 2)))


def address(rng):
    stem = lambda: rng.choice(STEM) + rng.choice("坞谷崖滩沟")
    return f"{stem()}市{stem()}区{rng.choice(STEM)}{rng.choice(STREET)}{rng.choice('路街巷')}{rng.randint(1, 400)}号{rng.randint(1, 20)}栋{rng.randint(1, 2000)}室"


def phone(rng):
    d = f"1{rng.randint(30, 89)}{rng.randint(0, 10**8 - 1):08d}"
    return rng.choice([d, f"{d[:3]} {d[3:7]} {d[7:]}", f"+86 {d}", f"(0345){rng.randint(10**6, 10**7 - 1)}"])


def identity(rng):
    return f"{rng.randint(100000, 999999)}{rng.randint(1950, 2000)}0{rng.randint(1, 9)}1{rng.randint(0, 9)}{rng.randint(100, 999)}X"


def fact(rng):
    n, a, p, i, e = name(rng), address(rng), phone(rng), identity(rng), f"{rng.choice(['ab', 'kas.tor', 'dor_9'])}{rng.randint(1, 99)}@mail.example.com"
    parts = [
        (f"被告人{n}，公民身份号码{i}，户籍地{a}。", {(n, "name"), (i, "id_number"), (a, "address")}),
        (f"证人{n}证实，其联系电话为{p}。", {(n, "name"), (p, "phone")}),
        (f"其妻{n}从{e}转发了照片。", {(n, "name"), (e, "email")}),
        (f"被害人{n}（住{a}，手机{p}）报案。", {(n, "name"), (a, "address"), (p, "phone")}),
        (f"涉案银行卡号为{rng.randint(10**15, 10**16 - 1)}，被告人{rng.choice(SUR)}某手机尾号{rng.randint(1000, 9999)}。", set()),
        (f"订单编号DD{rng.randint(10**15, 10**16 - 1)}显示，{rng.choice(SUR)}家车行于2014年{rng.randint(1, 12)}月发出。", set()),
    ]
    rng.shuffle(parts)
    return "".join(t for t, _ in parts[:4]), set().union(*(v for _, v in parts[:4]))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    return private.train_tagger([fact(rng)[0] for _ in range(500)])


def test_held_out_precision_and_recall(net):
    rng = random.Random(77)
    asked = [fact(rng) for _ in range(150)]
    got = [{(t[s:e], k) for s, e, k in f} for (t, _), f in zip(asked, private.find_spans([t for t, _ in asked], net))]
    right = sum(len(g & w) for g, (_, w) in zip(got, asked))
    assert right / sum(map(len, got)) > 0.97
    assert right / sum(len(w) for _, w in asked) > 0.95


def test_long_texts_are_read_whole(net):
    rng = random.Random(5)
    filler = "上述事实有书证证言等证据证实足以认定。" * 40
    t, want = fact(rng)
    text = filler + t + filler + t
    got = private.find_spans([text], net)[0]
    assert {(text[s:e], k) for s, e, k in got} >= {w for w in want if w[1] != "name"}
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_gradients_agree_with_differences():
    net = private.Tagger(list("abc"))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(1, 5, (2, 6)).astype(np.int32), np.array([[0, 1, 2, 0, 0, 3], [1, 2, 2, 0, 5, 6]])

    def loss():
        e, _, _ = net.scores(ids)
        trans = np.where(net.banned, -1e30, net.p["t"])
        total = 0.0
        for b in range(2):
            a = e[0, b] + np.where(np.arange(private.TAGS) % 2 + (np.arange(private.TAGS) == 0) > 0, 0, -1e30)
            gold = e[0, b, tags[b, 0]]
            for t in range(1, 6):
                m = a[:, None] + trans
                a = m.max(0) + np.log(np.exp(m - m.max(0)).sum(0)) + e[t, b]
                gold += trans[tags[b, t - 1], tags[b, t]] + e[t, b, tags[b, t]]
            total += a.max() + np.log(np.exp(a - a.max()).sum()) - gold
        return total / 2

    g = net._gradients(ids, tags)
    for k in ("e", "xf", "hb", "cf", "o", "u", "t"):
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in net.p[k].shape)
            if k == "t" and net.banned[i]:
                continue
            old = net.p[k][i]
            net.p[k][i] = old + 1e-3
            up = loss()
            net.p[k][i] = old - 1e-3
            down = loss()
            net.p[k][i] = old
            assert abs((up - down) / 2e-3 - g[k][i]) < 2e-2 * max(1, abs(g[k][i])), k


def test_shapes():
    t = "电话０１２ 抄送 a.b@c.example，王某，欧阳 若兰"
    assert private.shaped(t, t.index("a.b"), t.index("a.b") + 4, "email") == (t.index("a.b"), t.index("，王"))
    assert private.shaped(t, t.index("王某"), t.index("王某") + 2, "name") is None
    assert private.shaped(t, t.index("欧阳"), len(t), "name") == (t.index("欧阳"), len(t))
    assert private.shaped("桂坞市新城区", 0, 6, "address") is None
    assert private.redact("a王佳b", [(1, 3, "name")]) == "a[NAME]b"


def test_table(spark):
    rng = random.Random(3)
    rows = [(i, fact(rng)[0], "clash") for i in range(200)]
    rows += [(1, rows[1][1], "clash"), (500, None, "x"), (501, "", "x"), (None, rows[0][1], "x"), (502, "平" * 3000, "x")]
    df = spark.createDataFrame(rows, "case_id long, fact string, value string")
    got = private.private_spans(df, "case_id", "fact").collect()
    texts = {c: t for c, t, _ in rows if t}
    assert got and all(texts[r.case_id][r.begin_at : r.end_at] == r.value for r in got)
    out = private.redacted(df, "case_id", "fact").collect()
    assert len(out) == len(rows) and {r.fact for r in out if r.case_id in (500, 501)} == {None, ""}
    assert any("[PHONE]" in (r.fact or "") for r in out)
    assert private.private_spans(df.limit(0), "case_id", "fact").collect() == []


def test_repeated_rows_do_not_use_up_the_sample(spark, monkeypatch):
    monkeypatch.setattr(private, "TEXTS", 20)
    monkeypatch.setattr(private, "LATIN_TEXTS", 5)
    taught = []
    monkeypatch.setattr(private, "train_tagger", lambda texts: taught.append(texts))
    once = [(i, f"案件{i}。") for i in range(60)] + [(i, f"this is the case {i}") for i in range(100, 120)]
    rows = once * 3 + [r for r in once if r[0] % 7 == 0] * 40
    for table in (once, rows):
        private._taught(spark.createDataFrame(table, "case_id long, fact string"), "case_id", "fact")
    assert taught[0] == taught[1] and len(set(taught[0])) == len(taught[0]) == 25


@pytest.mark.parametrize("place", ["石家庄市长安区建设路12号", "呼和浩特市新城区兴安街3号", "内蒙古自治区包头市和平路8号2栋", "雄县安宁路5号"])
def test_addresses_keep_their_first_name_whole(place):
    assert private.shaped(place, 0, len(place), "address") == (0, len(place))
    for lead in ("户籍地", "现住", "，", "开户地址为"):
        text = f"被告人{lead}{place}。"
        assert (place, "address") in {(text[s:e], k) for s, e, k in private.teach(text)}


def test_names_in_letters_of_any_script():
    for value in ("José García", "Łukasz Żak", "Nguyễn Thị Hương", "Иван Петров", "김민수", "สมชาย ใจดี", "Ludwig van Beethoven", "Jean-Luc Müller", "Mary Smith"):
        assert private.shaped(value, 0, len(value), "name") == (0, len(value)), value
    for value in ("J. S.", "Мария", "the house", "王某", "José 12", "A B"):
        assert private.shaped(value, 0, len(value), "name") is None, value


def test_labels_do_not_hang_on_the_sentence_frames():
    frame = ["律师张建国，发表意见。", "后来张建国曾到场。", "经查，刘海波曾借款。", "She moved to 12 Oakwood Avenue last year."] + ["余额不足。"] * 20
    tags = private.labels(frame)
    name, address = 1 + 2 * private.KINDS.index("name"), 1 + 2 * private.KINDS.index("address")
    assert list(tags[0][2:5]) == list(tags[1][2:5]) == [name, name + 1, name + 1]  # shown once, known elsewhere
    assert set(tags[2][3:6]) == {-1}  # rare and unsure: teaches nothing
    assert not tags[4].any()  # a frequent word
    at = frame[3].index("12")
    assert tags[3][at] == address and set(tags[3][at + 1 : at + len("12 Oakwood Avenue")]) == {address + 1}


def test_varied_texts_keep_their_labels():
    rng = np.random.default_rng(0)
    text = "被告人王某甲伙同李某来到桂坞市新城区安宁路5号。" * 20
    varied, tags = private.vary(text, private.labels([text])[0], rng)
    assert len(varied) == len(tags) and varied != text
    name = 1 + 2 * private.KINDS.index("name")
    starts = np.flatnonzero(tags == name)
    assert len(starts) and all(varied[i] in private.SURNAMES or varied[i : i + 2] in private.COMPOUND for i in starts)


def test_unsure_positions_teach_nothing():
    net = private.Tagger(list("abc"))
    ids = np.random.default_rng(0).integers(1, 5, (2, 6)).astype(np.int32)
    g = net._gradients(ids, np.full((2, 6), -1))
    assert all(np.abs(v).max() < 1e-5 for v in g.values())


def test_a_span_is_taken_to_the_ends_of_its_value_if_it_holds_enough_of_it():
    mail = "a" * 150 + "." + "b" * 80 + "@" + "c" * 60 + ".example.com"
    text = "寄往" + mail + "。"
    at, end = 2, 2 + len(mail)
    assert private.shaped(text, at + 100, end - 100, "email") == (at, end)
    assert private.shaped(text, at + 140, at + 141, "email") is None
    text = "电话 +86 139 1234 5678，证件 110101 19900101 123X。"
    assert private.shaped(text, 5, 14, "phone") == (3, 20)
    assert private.shaped(text, 6, 7, "phone") is None
    assert text[slice(*private.shaped(text, 26, 40, "id_number"))] == "110101 19900101 123X"


def test_a_long_text_teaches_with_any_of_its_parts(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(private, "PART", 100)
    monkeypatch.setattr(private, "train_tagger", lambda texts: taught.extend(texts))
    df = spark.createDataFrame([(1, "被告人周某到案。" * 40 + "末尾一段"), (1, "被告人周某到案。" * 40 + "末尾一段"), (2, None), (3, ""), (4, "短文")], "case_id long, fact string")
    private._taught(df, "case_id", "fact")
    assert sorted(map(len, taught)) == [2, 24, 100, 100, 100] and any("末尾" in t for t in taught)
