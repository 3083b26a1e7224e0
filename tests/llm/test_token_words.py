"""Words that are learnt together get the ids that the tokenizer gives each text."""

import numpy as np

from drapery.llm.common import tokenizer_path
from drapery.llm.token_store import WordEncoder

TEXTS = ["Plain words, with marks!! and Café ÉTÉ", "line inside \u0085 a\u001cb x y", "a\nb\r\nc\x0bd\x0ce", "", " ", "42 don't <|endoftext|> ß×÷",
         "same same, same. SAME! \U0001f600 你好", "�﻿ end"]


def test_words_learnt_together_have_the_tokenizers_ids():
    enc = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    got = enc.encode([t.encode() for t in TEXTS])
    for text, ids in zip(TEXTS, got):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text


def test_words_are_taken_apart_in_one_search(monkeypatch):
    import drapery.llm.token_store as T

    class Counted:
        calls = 0

        def findall(self, text):
            Counted.calls += 1
            return plain.findall(text)

    plain = T._PLAIN
    monkeypatch.setattr(T, "_PLAIN", Counted())
    enc = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    enc.encode([b"one two three", b"four, five"])
    enc.encode([b"one two three", b"four, five"])
    assert Counted.calls == 1


def test_a_block_is_looked_up_by_its_distinct_pieces():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    enc = WordEncoder(tokenizer_path("word_bpe_49k.json"))
    enc.known = Counted()
    texts = ["one two, three " * 500, "", "Café!! one× ÷! don't! ÉTÉ. <|endoftext|>! a!b ́x  y!"]
    got = enc.encode([t.encode() for t in texts])
    assert Counted.asked < 60
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text
    assert enc.encode([]) == [] and enc.encode([b"", b""]) == [b"", b""]
