"""Word hashes follow their formula wherever a word stands, and blocks share the powers they are made of."""

import numpy as np

import drapery.llm.textscan as T

TEXTS = [b"one two  three", b"", b" \t\n", "four été one".encode(), b"x" * (T.SLICE + 10) + b" y", b"a b " * 60_000 + b"one"]


def direct(word: bytes) -> int:
    value = sum(int(T._BYTE[b]) * pow(int(T._BASE), i, 2**64) for i, b in enumerate(word)) + len(word)
    return int(T.mix(np.array([value % 2**64], np.uint64))[0])


def test_word_hashes_follow_their_formula():
    w = T.Words(TEXTS)
    known = {}
    for h, word in zip(w.hash.tolist(), w.slice_bytes(0, len(w.hash))):
        assert h == known.setdefault(word, direct(word)), word[:20]
    assert np.diff(w.first).tolist() == [len(t.split()) for t in TEXTS]


def test_powers_are_made_once(monkeypatch):
    T.Grams(T.Words(TEXTS).hash, 1)
    calls = []
    monkeypatch.setattr(T, "powers", lambda *a: calls.append(a) or np.ones(a[1], np.uint64))
    T.Grams(T.Words(TEXTS[:4]).hash, 1)
    assert not calls
