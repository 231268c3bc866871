"""Ids of hostile strings equal the tokenizers library's, whatever is cached and however texts are cut."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from harborline.llm.word_ids import UnitIds, vocabulary

MARKS = "\t\n\x0b\x0c\r\x1c\x00\x7f"
PARTS = [*"aAbBzéÉßİıſ×÷'’\"!|<>-_.,09٣½ Σσς中文가ДЙǅⅧ²😀" + MARKS, "̧", "́", "̈", "하", " ", " ", "​", "ͅ", "ŉ"]
PARTS += ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'RE", "ction", "İ|", "Baİ!", "  "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("cached", [64, 1 << 14])
def test_ids_equal_the_library(name, cached):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, "", "é" * 3000, "plain words " * 5000, "İ|", "Baİ!"]
    path = vocabulary(name)
    library, ids = Tokenizer.from_file(path), UnitIds(path, cached)
    assert ids.cuts == name.startswith("word")
    for _ in range(2):
        rows = 0
        for row, got, begin in ids(pa.array(texts), 7, 1 << 12):
            for i in range(len(begin) - 1):
                assert got[begin[i] : begin[i + 1]].tolist() == [*library.encode(texts[row + i] or "", add_special_tokens=False).ids, 7], texts[row + i]
            rows += len(begin) - 1
        assert rows == len(texts)
