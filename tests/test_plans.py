"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from stylograin.catalog import all_sql
from stylograin.catalog.tables import Tables
from stylograin.functions.text import words
from stylograin.operators import terms
from stylograin.operators.models import random_forest
from stylograin.operators.trees import shape_features
from stylograin.plans import studies

QUERIES = driver.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, folder):
    text = plan(QUERIES["p01_equality_filter"](spark, folder))
    assert "EqualTo(lang,en)" in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>", text)


def test_keys_only_for_samples(spark, folder):
    text = plan(QUERIES["g11_simple_sample"](spark, folder))
    assert "text" not in re.findall(r"ReadSchema: struct<([^>]*)>", text)[0]


def test_tree_features_cost_one_shuffle(spark, folder):
    text = plan(shape_features(Tables(spark, folder).nodes()))
    assert text.count("Exchange hashpartitioning") == 1


def test_term_totals_cost_one_shuffle(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = plan(terms.term_totals(docs, words(F.col("text"))))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


@pytest.mark.parametrize("name", ["t05_vocabulary", "t06_idf", "t09_tfidf", "j04_vocabulary_lookup", "tr18_path_tfidf"])
def test_vocabularies_are_not_cut_in_one_task(name, spark, folder):
    limits = [int(n) for n in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan(QUERIES[name](spark, folder)))]
    assert all(n <= 1000 for n in limits)


def test_shares_read_the_table_once(spark, folder):
    assert plan(QUERIES["a02_value_shares"](spark, folder)).count("FileScan") <= 2  # the kept counts, shown on either side


def test_large_vocabulary_is_not_broadcast(spark, folder):
    docs = Tables(spark, folder).documents()
    vocab = terms.vocabulary(docs, words(F.col("code")))
    counted = terms.counts_in_vocabulary(docs, words(F.col("code")), vocab, 10 ** 6)
    assert "hint" not in counted._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("name", sorted(n for n in all_sql() if not n.startswith(("ml", "s0", "s1"))))
def test_no_cross_join_and_no_python(name, spark, folder):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


def test_an_explanation_builds_its_trees_once(spark, folder, monkeypatch):
    made, path_tokens = [], studies.path_tokens
    monkeypatch.setattr(studies, "path_tokens", lambda *a, **k: made.append(1) or path_tokens(*a, **k))
    tables = Tables(spark, folder)
    report = studies.explanation(tables.pages(), tables.nodes(), random_forest(5, 4))
    assert report.count() > 0 and made == [1]
