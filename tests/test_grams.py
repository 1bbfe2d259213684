import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stylograin.functions.text import char_ngrams
from stylograin.operators import grams, terms
from stylograin.operators.features import TfidfVectors

ODD = ["", "ab", "abc", "Abc  abc\n\n\tabc", "ÄÖüß \U0001f600\U0001f600\U0001f600x", "a\x00b\x00\x00\x00", "\x00" * 7, None, "aaaaaa", "あいうえおか"]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("abc é\U0001f600") for _ in range(rng.randrange(80))) for _ in range(n)]


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "sample_id long, code string")


@pytest.mark.parametrize("sizes", [(3, 5), (1, 2), (3, 3), (2, 7)])
@pytest.mark.parametrize("held, piece", [(grams.HELD, grams.SLICE), (40, 100)])
def test_totals_equal_those_of_all_strings(spark, monkeypatch, sizes, held, piece):
    df = table(spark, texts())
    want = {tuple(r) for r in terms.term_totals(df, char_ngrams(F.col("code"), *sizes)).collect()}
    assert {tuple(r) for r in grams.gram_totals(df, F.col("code"), *sizes).collect()} == want
    monkeypatch.setattr(grams, "HELD", held)
    found = {}
    totals = grams.Totals(*sizes)
    clean = pa.array([r.c for r in df.select(grams.clean_text(F.col("code")).alias("c")).collect()], pa.string())
    monkeypatch.setattr(grams, "SLICE", piece)
    batches = [b for _, part in grams.slices(clean) for b in totals.add(part)] + list(totals.flush())
    for term, tf, df_ in (r.values() for b in batches for r in b.to_pylist()):
        found[term] = tuple(x + y for x, y in zip(found.get(term, (0, 0)), (tf, df_)))
    assert {(k, *v) for k, v in found.items()} == want


def test_more_characters_than_an_alphabet_has_room_for(spark):
    every = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 6000))
    values = [every, every[:3000], every[3000:], "abc" + every[:4100], "abcabc"]
    df = table(spark, values)
    want = {tuple(r) for r in terms.term_totals(df, char_ngrams(F.col("code"))).collect()}
    assert {tuple(r) for r in grams.gram_totals(df, F.col("code")).collect()} == want


@pytest.mark.parametrize("sublinear", [False, True])
@pytest.mark.parametrize("scaled", [False, True])
def test_vectors_equal_those_of_all_strings(spark, sublinear, scaled):
    df = table(spark, texts()).coalesce(1)
    tokens = df.withColumn("tokens", char_ngrams(F.col("code"))).where("tokens is not null")
    slow = TfidfVectors("tokens", "features", 150, 2, sublinear, scaled).fit(tokens)
    fast = grams.GramVectors("code", "features", 150, 2, sublinear, scaled).fit(tokens)
    assert fast.terms == slow.terms and fast.idf == slow.idf
    want = {r.sample_id: r.features for r in slow.transform(tokens).collect()}
    got = {r.sample_id: r.features for r in fast.transform(tokens.drop("tokens")).collect()}
    assert want.keys() == got.keys()
    for key, vector in want.items():
        assert got[key].size == vector.size and got[key].toArray() == pytest.approx(vector.toArray())


def test_stored_vectors_are_read_in_small_batches(spark):
    """A batch of 4,096 rows of n-gram vectors, and a row group of 128 MB, were more than an executor's memory."""
    import glob

    import pyarrow.parquet as pq

    from stylograin import session

    before = spark.conf.get(session.READER_SETTING)
    try:
        spark.conf.set(session.READER_SETTING, "4096")
        rows = spark.range(0, 1200, 1, 1).selectExpr("id", "transform(sequence(1, 5000), x -> sqrt(x * 7.0D + id)) AS v")
        got = session.stored_vectors(rows, rows.schema)
        assert spark.conf.get(session.READER_SETTING) == str(session.VECTOR_ROWS)
        assert got.selectExpr("count(*)", "sum(size(v))").first() == (1200, 6_000_000)
        file = pq.ParquetFile(glob.glob(got.inputFiles()[0].removeprefix("file://"))[0]).metadata
        assert max(file.row_group(k).total_byte_size for k in range(file.num_row_groups)) < 2 * session.VECTOR_BYTES
    finally:
        spark.conf.set(session.READER_SETTING, before)
