import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigraph.llm import tokens

VOC = tokens.Vocabulary()
REF = Tokenizer.from_file(tokens.VOCABULARY)
REF.encode_special_tokens = True


def ids(text):
    return tokens.encode_texts(VOC, [text], {})[0].tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_public_library(text):
    assert ids(text) == REF.encode(text, add_special_tokens=False).ids


def test_hard_texts_as_the_public_library():
    rng = random.Random(2)
    letters = list("aab  \t\n\r　\x1c\x85​中国的'st're'LL12٣½①éẽไทย<|endoftext|>😀🏽")
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert ids(text) == REF.encode(text, add_special_tokens=False).ids


def test_wide_pieces_are_merged_alike():
    for text in ("a" * 3000, "中国人民法院" * 500, "ab" * 5000):
        assert ids(text) == REF.encode(text, add_special_tokens=False).ids
    piece = "the whole thing".replace(" ", "").encode() * 4
    assert tokens.merge_rows(VOC, [piece], 64) == [tokens.merge_one(VOC, piece)]


def test_a_full_memo_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    memo = {}
    for text in ("one two three", "four five", "one six seven eight nine"):
        assert tokens.encode_texts(VOC, [text], memo)[0].tolist() == REF.encode(text, add_special_tokens=False).ids


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "刀 and knife", "x"), (3, "刀 and knife", "x")], "doc_id long, text string, id string")
    got = [(r.doc_id, r.ids) for r in tokens.token_ids(df, "doc_id", "text").collect()]
    want = REF.encode("刀 and knife", add_special_tokens=False).ids
    assert got == [(1, []), (2, []), (3, want), (3, want)]
    assert tokens.token_ids(df.limit(0), "doc_id", "text").collect() == []
