"""What a worker remembers stays bounded, whatever the words are."""

import numpy as np

from drapery.llm import token_store
from drapery.llm.common import tokenizer_path


def test_pieces_remembered_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(token_store, "HELD_BYTES", 1 << 17)
    enc = token_store.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    for i in range(12):  # one long piece a text, each another one
        text = f"{i}-" * 5_000
        enc.block([text.encode()])
        assert sum(map(len, enc.known)) + 4 * len(enc.ids) <= (1 << 17) + 5 * len(text)
    text = "one two 3-4 one"
    assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_pieces_remembered_are_bounded_in_number():
    enc = token_store.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    for i in range(10):
        enc.block([b" ".join(b"w" + bytes(97 + int(d) for d in str(j)) for j in range(i * 40_000, (i + 1) * 40_000))])
        assert len(enc.known) <= 345_000
