import pytest

#: Columns that operators use inside or give back: a table that has them must come through.
CLASHING = ["n_words", "kept", "removed", "ids", "key", "name", "secrets", "score", "n_tokens", "component", "slot", "file", "id", "part",
            "hit_spans", "decoded", "rule", "signature"]


@pytest.fixture
def awkward(spark):
    """Texts with nulls, nothing, blanks, one long text, ties and repeated rows, beside clashing columns."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (5, long), (None, "one two three four five six"),
             (1, "one two three four five six"), (7, "one two three four five six"), (9, " ".join(f"v{i}" for i in range(60))), (8, "naïve 😀 <|endoftext|> ▁x  y\n\n z q "), (None, None)]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *[None] * len(CLASHING)) for i, t in texts], schema)


@pytest.fixture
def nothing(awkward):
    return awkward.limit(0)
