import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stylograin.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [line for line in text.split("\n") if WORD.search(line)]
    windows, repeated = Counter(zip(words, words[1:], words[2:])), set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeated |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(repeated))


def test_counts_against_brute_force():
    random.seed(4)
    texts = [None, "", " \n", "a b c a b c a b c", "x\n\nx\n x\ny\r\nx", "é😀 #*&", "a b", "a b c", "\x0b\x0c\x1f\x85 "]
    texts += ["".join(random.choice(["a", "b ", "c ", "\n", " ", "|", "ü", "A"]) for _ in range(random.randint(0, 80))) for _ in range(200)]
    found = quality.counts(pa.array(texts))
    got = list(zip(*[found[c].tolist() for c in quality.COUNTS[:6]]))
    assert got == [brute(t) for t in texts]
    assert found["n_upper"].tolist() == [len(re.findall("[A-Z]", t or "")) for t in texts]


def table(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = {"a": rng.random(n), "b": rng.random(n), "noise": rng.random(n)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.3) & (x["a"] > 0.4))
    return x, bad, np.arange(n) % 3 == 0


def test_learns_conjunctions_in_order():
    x, bad, prune = table()
    rules = quality.learn(x, bad, prune, precision=0.9)
    fresh, truth, _ = table(3000, 9)
    assert (rules.rejects(fresh) == truth).mean() > 0.95
    assert not any(c.feature == "noise" for c in rules.rules[0])
    assert str(rules) == str(quality.learn(x, bad, prune, precision=0.9))


def test_nothing_to_learn():
    x, bad, prune = table()
    assert quality.learn(x, np.zeros(len(bad), bool), prune).rules == []
    assert quality.learn(x, np.random.default_rng(0).random(len(bad)) < 0.5, prune).rules == []
    assert quality.learn({"a": np.empty(0)}, np.empty(0, bool), np.empty(0, bool)).rules == []


def test_expression_equals_list(spark):
    x, bad, prune = table()
    rules = quality.learn(x, bad, prune, precision=0.9)
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in x.values()])), list(x))
    number = df.select(rules.rule_number({c: F.col(c) for c in x}).alias("r")).toPandas().r
    assert (number.notna().to_numpy() == rules.rejects(x)).all()


def test_verdicts_agree_with_labels(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judged(docs, labels, least=2).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.97 * len(good)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, "x"), (None, 1, "x"), (2, None, "x"), (5, 1, "x"), (99, 0, "x")], "doc_id bigint, quality int, text string")
    rows = quality.judged(awkward.drop("key"), labels).collect()
    assert len(rows) == awkward.count()
    assert [r.doc_id for r in rows if r.kept] == [9]
    kept = quality.kept_documents(awkward, labels)
    assert kept.columns == awkward.columns and [r.doc_id for r in kept.collect()] == [9]
    assert quality.judged(nothing, labels.limit(0)).count() == 0 and quality.kept_documents(nothing, labels).count() == 0
