import random

import pytest

from stylograin.llm import pieces
from stylograin.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", "a", " a", "Hello wörld, 😀 the  quick\nfoo \t x", "梦想 ééé", "x" * 500, "ab" * 300, "   ", "á \x00 b", "the cat sat on the mat."]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary(MODEL))


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The library over the same pieces and scores, told that they are a unigram model."""
    from sentencepiece import SentencePieceProcessor

    with open(MODEL, "rb") as file:
        data = file.read()
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")  # the trainer's model type, before its vocabulary size
    return SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2:])


def exhaustive(v, text):
    """Best score of any segmentation, over the whole lattice."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            known = v.pieces.get(text[begin:end])
            if known:
                best[end] = max(best[end], best[begin] + known[1])
        if not v.pieces.get(text[end - 1:end]):
            best[end] = max(best[end], best[end - 1] + v.least)
    return best[-1]


def score(v, ids):
    """Of ids whose unknown characters are single bytes."""
    scores = {i: s for i, s in v.pieces.values()}
    return sum(scores.get(i, v.least) for i in ids)


def test_best_segmentation_of_words(encoder):
    random.seed(1)
    for _ in range(300):
        word = pieces.BLANK + "".join(random.choice("theraningost") for _ in range(random.randint(1, 14)))
        assert score(encoder.v, encoder.search.feed(word, True)) == exhaustive(encoder.v, word)


def test_as_good_as_the_library_and_equal_where_it_is_exact(encoder, library):
    """Its lattice adds single-precision numbers, so it is exact while no lone blank (score -1e9) comes in."""
    for text in TEXTS[1:]:
        mine, theirs = encoder.encode(text).tolist(), library.nbest_encode(text, nbest_size=2, out_type=int)[0]
        assert score(encoder.v, mine) >= score(encoder.v, theirs)
        assert encoder.decode(encoder.encode(text)) == library.decode(theirs)
    for text in ["the cat sat on the mat.", "An example of plain words in a row", "x" * 500]:
        theirs = library.nbest_encode(text, nbest_size=2, out_type=int)[0]
        assert score(encoder.v, encoder.encode(text).tolist()) == score(encoder.v, theirs)


def test_feeding_in_parts_commits_the_same_ids(encoder):
    random.seed(2)
    text = encoder.v.normalised(" ".join("".join(random.choice("abcdeéthr") for _ in range(random.randint(1, 40))) for _ in range(300)))
    whole, search, parts, at, most = encoder._search(text), pieces.Search(encoder.v), [], 0, 0
    while at < len(text):
        step = random.randint(1, 30)
        parts += search.feed(text[at:at + step], at + step >= len(text))
        most = max(most, len(search.open))
        at += step
    assert parts == whole
    assert most < 12 * encoder.v.longest + 30  # what is not committed stays short
    assert encoder.encode(text.replace(pieces.BLANK, " ")[1:]).tolist() == whole


def test_round_trip(spark, awkward, nothing):
    out = pieces.decoded(pieces.encoded(awkward, MODEL), MODEL)
    for r in out.collect():
        if "▁" not in (r.text or ""):
            assert r.decoded == (r.text or ""), r.doc_id
        assert r.ids is not None
    assert out.columns == [c for c in awkward.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    assert pieces.decoded(pieces.encoded(nothing, MODEL), MODEL).count() == 0


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in pieces.decoded(df, MODEL).collect()] == ["", ""]


def test_memory_of_segments_is_bounded(encoder):
    small = pieces.Encoder(encoder.v, remember=50)
    texts = [" ".join(f"w{i}x{k}" for i in range(30)) for k in range(40)]
    assert all(small.encode(t).tolist() == encoder.encode(t).tolist() for t in texts)
    assert len(small.known) + len(small.before) < 50 * 2 + 60
