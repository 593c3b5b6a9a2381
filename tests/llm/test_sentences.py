from collections import Counter

import pytest

from lexigraph.llm import sentences


def split(text, corpus=None):
    return [text[s:e] for s, e in sentences.spans(text, sentences.Judge(sentences.evidence(text), corpus or {}))]


@pytest.mark.parametrize(
    ("parts", "glue"),
    [
        (["被告人认罪。", "你是否认罪？", "为何停留？！"], ""),
        (["被告人供述：“我只拿了刀。钱没动。”", "民警离开。"], ""),
        (["朱某问：“刀在哪儿？谁拿走的？”，被告人没有回答。", "完。"], ""),
        (["“你别走！”朱某追上喊道，随后争执。", "他走了。"], ""),
        (["杨某（已判刑。）也参与了行为。", "《内部规定。试行》第1条有说明。"], ""),
        (["被告人称“我……记不清了”，后又改口。", "被告人沉默不语……", "完。"], ""),
        (["三、处理意见", "（二）民警发现刀2件。", "1.被告人谢某认罪。", "2．完。"], "\n"),
        (["被告人谢某，\n户籍地某县。", "①完。"], ""),
        (["当庭自愿认罪.", "净重13.16克，误差3.5克｡", "型号3.4.17．", "完。"], ""),
        (["方式：a_b@c-d.example.com。", "12345678901的机主是谢某。"], ""),
        (["Mr. Sekpel gave it at 1 p.m.", "Counsel said, \"He was not there. He was at home.\"", "Dr. R. saw a cut of 37.9 cm."], " "),
        (["Reach him by e-mail at a.b_c@d-e.example.com.", "Counsel spoke.", "See www.some.example.org.", "No. 3 was missing."], " "),
        (["According to Art. 285, it is minor, e.g. a theft.", "The U.S. parcel weighed 5.3 kg, i.e. less.", "被告人认罪。"], " "),
        (["«No sé nada. Estaba en casa», declaró él.", "¿Por qué volvió?", "El Sr. X. llegó."], " "),
        (["Согласно ст. 123, т. е. общей норме, назначен штраф.", "Гр. Н. признал вину!", "Ушёл."], " "),
        (["「知りません。私ではありません。」と述べた。", "なぜですか？"], ""),
        (["\"저는 모릅니다. 집에 있었습니다.\"라고 말했다.", "왜 왔습니까?"], " "),
        (["โทรศัพท์มีข้อความ 61 ข้อความ", "ราคาประมาณ 17430 บาท", "จำเลยรับสารภาพ", "2.周某出具证明。"], " "),
        (["गवाह ने देखा।", "वह क्यों आया?"], " "),
        (["ئۇ كەلدى؟", "سوت قىلدى."], " "),
    ],
)
def test_rules(parts, glue):
    assert split(glue.join(parts)) == parts


def test_corpus_decides_where_the_document_is_silent():
    text = "He met Prov. Adams there. It rained."
    assert split(text) == ["He met Prov.", "Adams there.", "It rained."]
    assert split(text, Counter({("a", "prov"): 9, ("t", "prov"): 10, ("m", "adams"): 3})) == ["He met Prov. Adams there.", "It rained."]


def test_document_decides_first():
    text = "He met Prov. Adams there. The prov. court sat; prov. law holds."
    assert split(text)[0] == "He met Prov. Adams there."


@pytest.mark.parametrize(
    "parts",
    [
        ["He said no.", "Then we left.", "He said no.", "But we stayed."],
        ["See No. 12, there is no reason.", "Mr. Brown left."],
        ["It says so, cf. Sec. 75 and No. A-12.", "It rained."],
        ["The bill came at noon.", "98765的机主是谢某。"],
    ],
)
def test_lists_come_last(parts):
    assert split(" ".join(parts)) == parts


def test_document_goes_before_lists():
    # "art" is an ordinary word of this document, so it ends its sentence, though a list has it
    assert split("She loves art and music. He loves art. Then they met.") == ["She loves art and music.", "He loves art.", "Then they met."]
    # a long abbreviation, learnt from the corpus
    corpus = Counter({("a", "abteilung"): 9, ("t", "abteilung"): 10, ("m", "adams"): 3})
    assert split("He met Abteilung. Adams there.", corpus) == ["He met Abteilung. Adams there."]


@pytest.mark.parametrize(
    "parts",
    [
        ["The bill came at noon.", "①2019年9月21日，民警发现刀2件。"],
        ["The bill came at noon.", "²他没有回答。"],
        ["The bill came at noon.", "① The rest was paid.", "② It rained."],
        ["It says so, see No. ① of the list.", "It rained."],
        ["It rained.", "²"],
    ],
)
def test_digits_that_are_no_decimals(parts):
    assert split(" ".join(parts)) == parts


def test_many_open_marks_and_long_words():
    text = "“" + "（" * 100 + "甲。乙" + "）" * 100 + "。”他说。完。"
    assert split(text) == [text[:-2], "完。"]
    long = "x" * 40
    assert split(f"Der {long}. Das ist so, der {long}. a, {long}. b.")[0] == f"Der {long}. Das ist so, der {long}. a, {long}. b."


def test_a_word_that_all_documents_ask_for(spark):
    df = spark.createDataFrame([(i, f"He met Prov. Adams at {i} there.") for i in range(200)] + [(900, "The prov. court sat with Adams."), (901, "The prov. law of Adams holds."), *[(1000 + i, f"It was said that {w} Adams, prov., agreed.") for i, w in enumerate(["poor", "old", "young"] * 70)]], "case_id long, fact string")
    got = [tuple(r) for r in sentences.sentence_spans(df, "case_id", "fact").where("case_id < 200").collect()]
    assert len(got) == 200 and {b for _, b, _ in got} == {0}


def test_odd_texts():
    for text in ["", " ", "\n\n", "。", "“", "((((", '"' * 9, "a" * 3000, "。" * 500, "“" * 300 + "a。b"]:
        found = sentences.spans(text, sentences.Judge(sentences.evidence(text), {}))
        assert all(s < e and not text[s].isspace() and not text[e - 1].isspace() for s, e in found)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_table(spark):
    rows = [(1, "甲。乙。", "x"), (1, "甲。乙。", "x"), (2, None, "x"), (3, "", "x"), (4, "  \n", "x"), (None, "甲。", "x"), (5, "He saw Mr. Li. Mr. Li left.", "x")]
    df = spark.createDataFrame(rows, "case_id long, fact string, known string")
    got = sorted((r.case_id, r.begin_at, r.end_at) for r in sentences.sentence_spans(df, "case_id", "fact").collect())
    assert got == [(1, 0, 2), (1, 2, 4), (5, 0, 14), (5, 15, 27)]
    assert sentences.sentence_spans(df.limit(0), "case_id", "fact").collect() == []
