import base64
import random

import numpy as np
import pytest

from stylograin.llm import shards
from stylograin.llm.queries import tokenizer_path
from stylograin.session import scratch_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding(pattern):
    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 4097, 65_536, 65_537])
def test_order_is_a_permutation(n):
    order = shards.Order(n, 11)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.sequences(slots) == np.arange(n)).all()
    if n > 1000:
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1
        assert (shards.Order(n, 12).slots(np.arange(n)) != slots).mean() > 0.9


PIECES = ["'s", "'S", "'", "'ll", "'l", "'re", "'ve", "'d", " ", "  ", "\n", "\r\n", "\t", "\u3000", "\xa0", "\x85", "\x1c", "a", "Zz", "é", "ǅ", "中", "1", "²", "٣",
          "_", "!", "…", "😀", "e\u0301", "\u200d", "\ufeff", "\x00", "<|endoftext|>", "<|", "\U0010ffff", "word"]


def ids_again(tokens, text):
    """Ids of a text from its bytes and the lengths of its tokens."""
    n, packed = tokens.counted(text)
    lengths = tokens.unpacked(packed, n)
    assert len(lengths) == n - 1
    return tokens.ids(np.frombuffer((text or "").encode(), np.uint8), lengths).tolist()


def test_ids_are_the_library_s_for_the_given_pattern(pattern, encoding):
    rnd, tokens = random.Random(3), shards.Tokens(RANKS, pattern)
    assert tokens.encoding._pat_str != pattern == encoding._pat_str
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 14))) for _ in range(20_000)]
    for text in [*texts, " " * 5000 + "x", "\n" * 5000, "<|endoftext|>" * 50, None]:
        assert ids_again(tokens, text) == encoding.encode_ordinary(text or ""), repr(text)


def test_other_patterns_are_taken_as_they_are(encoding):
    assert ids_again(shards.Tokens(RANKS, r"\p{L}|[^\p{L}]"), "the word") == [encoding.encode_single_token(c) for c in "the word"]


def test_every_token_is_found_by_its_bytes(pattern, encoding, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK", 1000)
    tokens = shards.Tokens(RANKS, pattern)
    parts = [encoding.decode_single_token_bytes(i) for i in range(50256)]
    lengths = np.array([len(p) for p in parts])
    assert lengths.max() > 64
    assert tokens.ids(np.frombuffer(b"".join(parts), np.uint8), lengths).tolist() == list(range(50256))
    with pytest.raises(ValueError):
        tokens.ids(np.frombuffer(b"zqzqzq", np.uint8), np.array([6]))


def stream(encoding, rows, length):
    ids = []
    for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids += encoding.encode_ordinary(text or "") + [50256]
    n = -(-len(ids) // length)
    return np.array(ids + [50256] * (n * length - len(ids)), np.uint16).reshape(n, length)


TEXTS = ["one two  three", None, "", " lead\n\ntail ", "naïve 😀 <|endoftext|>", "word " * 300, "a\nb c\n d", "　wide space x"]


def test_shards_hold_the_stream_in_order_of_slots(spark, pattern, encoding):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "keyless"), (3, " lead\n\ntail ")]
    docs = spark.createDataFrame([(k, t, None) for k, t in rows], "doc_id bigint, text string, name string").repartition(3)
    meta = shards.write_shards(docs, scratch_path(spark, "shards"), RANKS, pattern, seed=5, length=16, shard_records=4)
    want = stream(encoding, rows, 16)
    got = shards.read_records(spark, meta).orderBy("slot").collect()
    assert meta["sequences"] == len(want) and [r.slot for r in got] == list(range(len(want)))
    assert sorted(r.sequence for r in got) == list(range(len(want)))
    assert all((np.frombuffer(r.ids, np.uint16) == want[r.sequence]).all() for r in got)
    rest = shards.read_records(spark, meta, from_slot=7).orderBy("slot").collect()
    assert [tuple(r) for r in rest] == [tuple(r) for r in got[7:]]
    sizes = sorted(r.length for r in spark.read.format("binaryFile").load(meta["folder"]).select("length").collect())
    assert sizes[-1] == 4 * (2 * 16 + 2) and sum(sizes) == len(want) * 34


def test_texts_that_share_a_key_are_all_written(spark, pattern):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "doc_id bigint, text string")
    assert shards.write_shards(docs, scratch_path(spark, "shards"), RANKS, pattern, length=8, shard_records=2)["tokens"] == 6


def test_repeated_and_keyless_rows_are_all_written(spark, pattern, encoding, monkeypatch):
    monkeypatch.setattr(shards, "SOME", 7)
    rows = [(k, f"text {k}") for k in range(5)] + [(None, "keyless")] * 40 + [(None, None)] * 9 + [(3, "text 3")] * 25
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    meta = shards.write_shards(docs, scratch_path(spark, "shards"), RANKS, pattern, length=16, shard_records=4)
    got = b"".join(r.ids for r in shards.read_records(spark, meta).orderBy("sequence").collect())
    ids = np.frombuffer(got, np.uint16)[:meta["tokens"]].tolist()
    found = [encoding.decode([i for i in part]) for part in "".join(chr(i) for i in ids).split(chr(50256))[:-1] for part in [[ord(c) for c in part]]]
    assert sorted(found) == sorted(t or "" for _, t in rows)


def test_awkward_and_no_rows(spark, awkward, nothing, pattern):
    meta = shards.write_shards(awkward, scratch_path(spark, "shards"), RANKS, pattern, length=256, shard_records=64)
    assert shards.read_records(spark, meta).count() == meta["sequences"] > 0
    empty = shards.write_shards(nothing, scratch_path(spark, "shards"), RANKS, pattern)
    assert empty["sequences"] == 0 and shards.read_records(spark, empty).count() == 0
    with pytest.raises(ValueError):
        shards.write_shards(awkward, "nowhere", RANKS, pattern, length=0)


def test_texts_are_written_from_the_lengths_that_were_counted(spark, pattern, encoding, monkeypatch):
    real, single = shards.layout, r"\p{L}|[^\p{L}]"
    monkeypatch.setattr(shards, "layout", lambda *given, **names: real(*given[:-1], single, **names))
    rows = [(k, f"the words {k}") for k in range(20)] + [(3, "the words 3")] * 3 + [(20, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    meta = shards.write_shards(docs, scratch_path(spark, "shards"), RANKS, pattern, length=16, shard_records=4)
    got = np.frombuffer(b"".join(r.ids for r in shards.read_records(spark, meta).orderBy("sequence").collect()), np.uint16)[:meta["tokens"]]
    want = [i for _, t in sorted(rows) for i in [*(encoding.encode_single_token(c) for c in t or ""), 50256]]
    assert got.tolist() == want
