import random

import pytest

from stylograin.llm import token_counts
from stylograin.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \n b", "a\n\nb", "a\n \nb", "one two\nthree four", "x\ty \tz  w", "　wide space",
         "<|endoftext|>", "a<|endoftext|> b <|endoftext|>\nc", "don't we'll I'M", "naïve 😀 ñandú", "a" * 300, "1234567 89", "tail \x1c\x1d x", "\r\nwin\r\n",
         "it's  'quoted' (text)…", "a b  c", "\x00 \x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(library):
    random.seed(1)
    texts = TEXTS + ["".join(random.choice(["a", "the ", " ", "\n", "\t", "é", "'s", "12", "!", "<|endoftext|>", " ", "　"]) for _ in range(random.randint(0, 15)))
                     for _ in range(2000)]
    counter = token_counts.TokenCounter(PATH, ["the", "a", "\na"], 100)
    for _ in range(2):  # with and without what was remembered
        assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.counts([None]) == [0]


def test_table_of_frequent_pieces(spark):
    docs = spark.createDataFrame([("the cat the dog\nthe end",)] * 50 + [("rare word",), (None,)], "text string")
    found = token_counts.frequent_pieces(docs, "text", 8)
    assert found == {"the": 100, "cat": 50, "dog": 50, "\nthe": 50, "end": 50}
    assert len(token_counts.frequent_pieces(docs, "text", 3)) <= 3


def test_awkward_rows(awkward, nothing, library):
    rows = token_counts.with_token_counts(awkward, PATH).collect()
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False)) for r in rows) and len(rows) == awkward.count()
    assert token_counts.with_token_counts(nothing, PATH).count() == 0
