import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stylograin.functions import arrays, labels, text
from stylograin.operators import terms

SNIPPET = "for i in x:\n    if i:\n        y = 1;\n\n# if //\n"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def test_surface_example(spark):
    features = text.surface_features(F.col("v"))
    row = spark.createDataFrame([(SNIPPET,)], "v string").select(*[c.alias(n) for n, c in features.items()]).first()
    want = dict(num_lines=6, num_chars=46, avg_line_length=6.833333, num_for=1, num_while=0, num_if=2, num_def=0,
                num_function=0, num_open_brace=0, num_close_brace=0, num_semicolon=1, num_hash_comment=1,
                num_slash_comment=1, blank_lines=2, indent_std=3.316625)
    assert len(want) == len(features) == 15
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name
    assert one(spark, SNIPPET, text.word_count(F.col("v"))) == 12


def test_surface_of_empty_text(spark):
    features = text.surface_features(F.col("v"))
    row = spark.createDataFrame([("",)], "v string").select(*[c.alias(n) for n, c in features.items()]).first()
    assert (row.num_lines, row.num_chars, row.blank_lines, row.indent_std) == (1, 0, 1, 0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n\té𝒳", max_size=30))
def test_char_ngrams_of_any_text(spark, value):
    import re
    clean = re.sub(r"\s\s+", " ", value.lower())
    want = [clean[i:i + n] for n in (3, 4, 5) for i in range(len(clean) - n + 1)]
    assert one(spark, value, text.char_ngrams(F.col("v"))) == want


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="a \n", max_size=30))
def test_line_features_of_any_text(spark, value):
    lines = value.split("\n")
    indents = [len(line) - len(line.lstrip(" ")) for line in lines if line.strip()]
    row = spark.createDataFrame([(value,)], "v string").select(
        text.line_count(F.col("v")).alias("n"), text.blank_lines(F.col("v")).alias("b"),
        text.indent_std(F.col("v")).alias("s"), text.mean_line_length(F.col("v")).alias("m")).first()
    assert row.n == len(lines) and row.b == sum(not line.strip() for line in lines)
    assert row.s == pytest.approx(float(np.std(indents)) if indents else 0.0)
    assert row.m == pytest.approx(float(np.mean([len(line) for line in lines])))


def test_bigrams(spark):
    assert one(spark, "a b_1 c", text.words_and_bigrams(F.col("v"))) == ["a", "b_1", "c", "a b_1", "b_1 c"]
    assert one(spark, "a", text.words_and_bigrams(F.col("v"))) == ["a"]
    assert one(spark, "", text.words_and_bigrams(F.col("v"))) == []


def documents(spark):
    return spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "b")], "sample_id long, code string")


def test_tfidf_example(spark):
    docs, tokens = documents(spark), text.words(F.col("code"))
    assert [r.term for r in terms.vocabulary(docs, tokens, 1, 2).collect()] == ["b", "a"]
    idf = {r.term: r.idf for r in terms.with_idf(terms.vocabulary(docs, tokens), docs).collect()}
    assert idf == pytest.approx({"a": 1.693147, "b": 1.0, "c": 1.693147}, abs=1e-6)
    weights = {(r.sample_id, r.term): r.weight for r in terms.tfidf(docs, docs, tokens).collect()}
    assert weights[1, "a"] == pytest.approx(0.959056, abs=1e-6)
    assert weights[1, "b"] == pytest.approx(0.283217, abs=1e-6)


def test_vector_stage_agrees_with_long_table(spark):
    from pyspark.ml.functions import vector_to_array
    from stylograin.operators.features import TfidfVectors
    docs = documents(spark).withColumn("tokens", text.words(F.col("code")))
    for sublinear in (False, True):
        model = TfidfVectors("tokens", "f", 10, 1, sublinear).fit(docs)
        rows = model.transform(docs).select("sample_id", F.posexplode(vector_to_array("f")).alias("i", "w")).collect()
        got = {(r.sample_id, model.terms[r.i]): r.w for r in rows if r.w}
        long = terms.tfidf(docs, docs, F.col("tokens"), 1, 10, sublinear)
        assert got == pytest.approx({(r.sample_id, r.term): r.weight for r in long.collect()})


def test_unknown_terms_keep_the_vector_row(spark):
    from stylograin.operators.features import TfidfVectors
    docs = documents(spark).withColumn("tokens", text.words(F.col("code")))
    other = spark.createDataFrame([(9, ["zzz"])], "sample_id long, tokens array<string>")
    row = TfidfVectors("tokens", "f", 10).fit(docs).transform(other).first()
    assert row.f.numNonzeros() == 0


def test_truncation(spark):
    cut = arrays.head_and_tail(F.col("v"), F.lit(-1), F.lit(-2))
    got = one(spark, list(range(1, 601)), cut, "array<int>")
    assert got == [-1, *range(1, 256), *range(346, 601), -2] and len(got) == 512
    short = arrays.head_and_tail(F.col("v"), F.lit(-1), F.lit(-2), 8)
    row = spark.createDataFrame([([1, 2, 3],)], "v array<int>").select(short.alias("m")).select(
        arrays.padded(F.col("m"), F.lit(8), F.lit(0)).alias("p"), arrays.attention_mask(F.col("m"), F.lit(8)).alias("a")).first()
    assert row.p == [-1, 1, 2, 3, -2, 0, 0, 0] and row.a == [1, 1, 1, 1, 1, 0, 0, 0]


def test_segments_and_positions(spark):
    row = spark.createDataFrame([([1, 2, 3, 4], [7, 8])], "a array<int>, b array<int>").select(
        arrays.two_segments(F.col("a"), F.col("b"), F.lit(0), F.lit(9), 8).alias("s")).first()
    assert row.s == [0, 1, 2, 3, 9, 7, 8, 9]
    assert one(spark, [0, 2, 9], arrays.clamped_positions(F.col("v"), F.lit(4)), "array<int>") == [1, 3, 4]
    assert one(spark, [5, 6], arrays.positions(F.col("v")), "array<int>") == [0, 1]


def test_argmax_and_softmax(spark):
    assert one(spark, [1.0, 3.0, 3.0], arrays.argmax(F.col("v")), "array<double>") == 1
    got = one(spark, [1000.0, 1000.0], arrays.softmax(F.col("v")), "array<double>")
    assert got == [0.5, 0.5]


def test_names_and_rules(spark):
    short = labels.short_name(F.col("v"))
    assert [one(spark, v, short) for v in (" x/Phi-3-medium ", "a/b/c", "plain")] == ["Phi-3-medium", "c", "plain"]
    family = labels.lookup(F.col("v"), labels.GENERATOR_FAMILIES, "Other")
    assert [one(spark, v, family) for v in ("phi-2", "who")] == ["Microsoft Phi", "Other"]
    rule = labels.rule_prediction(F.col("v"))
    assert [one(spark, v, rule) for v in ('x = """d"""', "def f(a: int)", "x = 1", None)] == [1, 1, 0, 0]
    many = "\n".join("abcdefg")
    assert one(spark, many, labels.preview(F.col("v"), 3)) == "a\nb\nc\n... [4 more lines]"
