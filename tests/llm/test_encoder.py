"""op10's encoder: letters go to a tokenizer without steps that would change nothing, and ids stay the library's."""

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from clearspan.llm import token_store  # noqa: E402


class Counted:
    def __init__(self, of):
        self.of, self.texts = of, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.of.encode_batch_fast(texts, **more)


def test_letters_skip_the_steps_that_leave_them_alone():
    made = token_store.Encoder(P.path("word_bpe_49k.json"))
    library = made.tokenizer
    made.tokenizer, made.letters = Counted(library), Counted(made.letters)
    text = "Wörter, zaßko Éclairÿ plain WORDS; plain"
    assert np.frombuffer(made.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert made.tokenizer.texts == [","] or sorted(made.tokenizer.texts) == [",", ";"]
    assert sorted(" ".join(made.letters.texts).split()) == ["plain", "words", "wörter", "zaßko", "éclairÿ"]


def test_ids_are_the_librarys_with_a_small_table_and_a_giant_text():
    made, r = token_store.Encoder(P.path("word_bpe_49k.json"), 40), np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(r.choice(list("abzAÉéßſıİÿ×÷'<|>ś  \x85\x1c\t\n.,!—中12-_ẞ́"), r.integers(0, 25)))
        assert np.frombuffer(made.encode(text), "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids
    giant = "one two three, " * 40_000  # its later parts bring no new words
    assert np.frombuffer(made.encode(giant), "<u4").tolist() == made.tokenizer.encode(giant, add_special_tokens=False).ids
    assert made.encode("") == made.encode(" \n") == b""
