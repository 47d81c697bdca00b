"""Words of token files: every distinct word of a step is looked up once, ids are the tokenizer's."""

import numpy as np
from tokenizers import Tokenizer

from ripple.llm import token_file


class Counted(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


def test_each_word_once():
    w = token_file.Words(token_file.tokenizer_path())
    w.table = Counted(w.table)
    w.texts([b"one two one", b"Two  one\n"] * 100)
    assert w.table.asked <= 3


def test_white_space_and_bounds():
    w, tk = token_file.worker_words(token_file.tokenizer_path()), Tokenizer.from_file(token_file.tokenizer_path())
    texts = ["", " ", "\n\n", "a", " a", "a ", "b\x00 \x00", "\x00", "it's  IT'S...\tend", "<|endoftext|> A", "!?", "0 0x0", "x" * 200, "word. Word.", "café! \U0001f600", ""]
    for some in (texts, texts[::-1], [""], [" "], []):
        got = w.texts([t.encode() for t in some])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [tk.encode(t, add_special_tokens=False).ids for t in some]
