"""Every registered query against its SQL twin; the others must give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def sorted_rows(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted_rows([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted_rows([tuple(plain(r[i]) for i in at) for r in relation.fetchall()])
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


FAST_MODELS = ["ml03_balanced_logistic_regression", "ml05_random_forest", "ml08_calibrated_svm", "ml11_feature_importance",
               "ml12_permutation_importance", "ml18_fusion_study", "ml19_explanation_report", "ml20_cluster_summary"]


@pytest.mark.parametrize("name", FAST_MODELS)
def test_model_queries_give_rows(name, spark, folder):
    rows = QUERIES[name](spark, folder).collect()
    assert rows
    for row in rows:
        for metric in ("accuracy", "macro_f1", "roc_auc", "pr_auc", "fnr"):
            if metric in row.asDict() and row[metric] is not None:
                assert 0 <= row[metric] <= 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
