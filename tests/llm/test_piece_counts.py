"""Token counts of pieces: from the library's model, once per distinct piece of a block."""

import random

from tokenizers import Tokenizer

from drapery.llm import token_counts
from drapery.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_a_block_asks_the_model_for_its_distinct_pieces_only():
    class Model:
        asked = 0

        def tokenize(self, chars):
            Model.asked += 1
            return tok.model.tokenize(chars)

    class Splitter:  # no encoding of texts or pieces, only the classes of characters
        pre_tokenizer = Tokenizer.from_file(PATH).pre_tokenizer

    tok, own = Tokenizer.from_file(PATH), token_counts.Transducer(PATH)
    own.tok, own.model = Splitter(), Model()
    texts = ["one two, it's three " * 500, "", "Café 日本語 ½ \U0001f600\n\n x", "a\n", "\n", "\nb<|endoftext|>\n"]
    expect = [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert own.count(texts).tolist() == expect
    first = Model.asked
    assert first < 40
    assert own.count(texts[::-1]).tolist() == expect[::-1] and Model.asked == first


def test_runs_longer_than_many_chunks():
    tok, own, rng = Tokenizer.from_file(PATH), token_counts.Transducer(PATH), random.Random(5)
    texts = [a + unit * n + b for a in ("", "x", "'") for unit in (" ", "\n", "\t ", "'", "l", "é", "1", "'l") for n in (1, 64, 129, 1000) for b in ("", "x", " y", "'ll", "\n")]
    rng.shuffle(texts)
    assert own.count(texts).tolist() == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert own.count([]).tolist() == [] and own.count(["", ""]).tolist() == [0, 0]
