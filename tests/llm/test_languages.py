import random

import numpy as np
import pytest

from lexigraph.llm import languages

BASE = {
    "zh": ["被告人{}到案后如实供述。", "民警发现现金{}元。", "检察机关建议补充侦查{}日。"],
    "en": ["The guard locked the gate at {} p.m.", "The court finds that {} statements agree.", "Nothing else was taken from the yard."],
    "ja": ["重さは{}キログラムである。", "なぜ現場に戻ったのですか？", "裁判所は証拠{}号を採用した。"],
    "ko": ["증인은 {}시쯤 남자를 보았다.", "피고인은 잘못을 인정하고 있다.", "왜 현장으로 돌아왔습니까?"],
    "ru": ["Свидетель видел мужчину около {} часов.", "Суд принял доказательство.", "Зачем он вернулся?"],
    "vi": ["Nhân chứng nhìn thấy một người lúc {} giờ.", "Tại sao bị cáo quay lại hiện trường?", "Người bị hại đồng ý hòa giải."],
    "th": ["จำเลยรับสารภาพและสำนึกผิด", "ราคาของกลางประมาณ {} บาท", "ศาลรับฟังพยานหลักฐาน"],
    "es": ["El paquete pesaba {} kg según el acta.", "¿Por qué volvió al lugar de los hechos?", "El tribunal admitió la prueba y rechazó la petición."],
    "pt": ["O pacote pesava {} kg segundo o auto.", "Por que ele voltou ao local dos fatos?", "O tribunal admitiu a prova e negou o pedido."],
}


def text(rng, code, n=4):
    return " ".join(rng.choice(BASE[code]).format(rng.randint(2, 900)) for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    rows = [(text(rng, c), c) for c in languages.LANGUAGES for _ in range(60)]
    rows += [(text(rng, "zh"), "en") for _ in range(3)]  # wrong labels
    return languages.train_network(rows)


def test_held_out_accuracy(net):
    rng = random.Random(9)
    asked = [(c, text(rng, c, 2)) for c in languages.LANGUAGES for _ in range(20)]
    found = languages.stretches([t for _, t in asked], net)
    hits = [x[2] == c for (c, _), rows in zip(asked, found) for x in rows]
    assert np.mean(hits) > 0.97


def test_gradients_agree_with_differences():
    n = languages.Network(3)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 256, (4, languages.SIZE)), np.array([0, 1, 2, 3]), np.ones(9)

    def loss():
        q = n.predict(x)
        return -np.log(q[np.arange(4), y]).mean()

    g = n._gradients(x, y, w)
    for k in ("o", "w3", "b2"):
        i = tuple(0 for _ in n.p[k].shape)
        old = n.p[k][i]
        n.p[k][i] = old + 1e-3
        up = loss()
        n.p[k][i] = old - 1e-3
        down = loss()
        n.p[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3


@pytest.mark.parametrize(("label", "want"), [("zh_CN", "zh"), (" English ", "en"), ("pt-BR", "pt"), ("und", None), ("", None), (None, None), ("fr", "other"), ("JA", "ja")])
def test_labels(label, want):
    assert languages.label_language(label) == want


def test_single_words_links_and_markup_are_no_sentence(net):
    t = "被告人到案后如实供述。见 http://files.example/a?b=1 。<br/>&nbsp;卷宗页码在此处说明。民警使用Orvek软件查明事实。"
    assert {c for _, _, c, _, ok in languages.stretches([t], net)[0] if ok} == {"zh"}


def test_a_foreign_name_does_not_carry_its_sentence(net):
    assert [x[2:3] + x[4:] for x in languages.stretches(["涉案电脑装有Orvek-DataSuite软件，型号8.1.18。"], net)[0]] == [("zh", True)]


def test_table(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, c), c, "x") for i, c in enumerate(languages.LANGUAGES * 12)]
    rows += [(1000, "被告人到案后如实供述。The court finds that 12 statements agree with each other.", "zh", "x"), (1001, text(rng, "es"), "pt", "x"), (1002, text(rng, "ru"), None, "x"), (1003, text(rng, "ko"), "und", "x")]
    rows += [(1004, text(rng, "vi"), "Vietnamese", "x"), (1005, None, None, "x"), (1006, "", "zh", "x"), (1007, "12 34 !", None, "x"), (None, text(rng, "zh"), None, "x"), (1008, text(rng, "th", 400), "th", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    found = languages.language_stretches(df, "doc_id", "text", "lang")
    got = {(r.doc_id, r.language) for r in languages.mislabelled(found, "doc_id").collect()}
    assert got == {(1000, "zh"), (1000, "en"), (1001, "es"), (1002, "ru"), (1003, "ko")}
    assert all(0 < r.confidence <= 1 for r in found.collect())
    assert languages.language_stretches(df.limit(0), "doc_id", "text", "lang").collect() == []


def test_scripts_rule_out_only_what_is_absent(net):
    found = languages.stretches(["私は学生", "他说：“私は学生”，然后离开了现场。", "長い" + "<" + "a" * 500 + ">" + "民警发现现金3元。"], net)
    assert found[0][0][2] == "ja"
    assert found[1][0][2] == "zh"
    assert [r[2] for r in found[2]] == ["zh"]
    assert not languages.blanked("x <" + "a" * 500 + ">").strip("x ")


def test_script_counts_and_whole():
    text = "第二句 abc déf ghi абв гд еж 가나다라 かな\U00020001"
    at = [(0, len(text)), (4, 15), (0, 0)]
    assert languages.script_counts(text, at).tolist() == [[4, 2, 4, 0, 7, 9], [0, 0, 0, 0, 0, 9], [0] * 6]
    full = languages.whole([text[s:e] for s, e in at], languages.script_counts(text, at))
    assert {c for c, ok in zip(languages.LANGUAGES, full[0]) if ok} == {"en", "ja", "ko", "ru", "vi", "es", "pt"}
    assert {c for c, ok in zip(languages.LANGUAGES, full[1]) if ok} == {"en", "vi", "es", "pt"}


def test_a_long_text_teaches_with_any_of_its_parts(spark, monkeypatch):
    monkeypatch.setattr(languages, "PART", 50)
    df = spark.createDataFrame([(1, "被告人到案后如实供述。" * 30 + "末尾一段文字" * 4, "zh"), (2, None, "zh"), (3, "", "en")], "doc_id long, text string, lang string")
    parts = [t for t, _ in languages._labelled(df, "doc_id", "text", "lang")]
    assert len(parts) == 7 and any("末尾" in t for t in parts)  # a rest of fewer than 20 characters teaches nothing
