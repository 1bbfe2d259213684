import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograin.llm import kneser_ney as kn

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Brute:
    def __init__(self, texts):
        rows = [self.tokens(t) for t in texts]
        self.words = Counter(x for r in rows for x in r)
        self.pairs = Counter(p for r in rows for p in zip(["<s>", *r], r))
        self.before = Counter(b for _, b in self.pairs)
        self.first = Counter()
        for (a, _), n in self.pairs.items():
            self.first[a] += n
        self.d_pair, self.d_word = self.discounts(self.pairs), self.discounts(self.before)
        self.weight = defaultdict(float)
        for (a, _), n in self.pairs.items():
            self.weight[a] += self.d_pair[min(n, 3)]

    @staticmethod
    def tokens(text):
        return [w + " " for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))] + ["</s>"]

    @staticmethod
    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)]

    def word(self, w):
        left = sum(self.d_word[min(n, 3)] for n in self.before.values()) / max(len(self.pairs), 1) if self.pairs else 1.0
        return max(self.before[w] - self.d_word[min(self.before[w], 3)], 0) / max(len(self.pairs), 1) + left / (len(self.words) + 1)

    def pair(self, w, v):
        if not self.first[v]:
            return self.word(w)
        n = self.pairs[v, w]
        return max(n - self.d_pair[min(n, 3)], 0) / self.first[v] + self.weight[v] / self.first[v] * self.word(w)

    def score(self, text):
        t = self.tokens(text)
        n, v = sum(self.words.values()), len(self.words)
        return (len(t), sum(x in self.words for x in t), sum(math.log10((self.words[x] + 1) / (n + v + 1)) for x in t),
                sum(math.log10(self.pair(b, a)) for a, b in zip(["<s>", *t], t)))


def check(spark, train, texts):
    brute = Brute(train)
    model = kn.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    assert model.total == sum(brute.words.values()) and model.vocabulary == len(brute.words) and model.pairs == len(brute.pairs)
    rows = kn.with_scores(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), model).collect()
    for r in rows:
        want = brute.score(texts[r.k])
        assert (r.n_tokens, r.n_known) == want[:2]
        assert r.base_score == pytest.approx(want[2], rel=1e-9) and r.score == pytest.approx(want[3], rel=1e-9)
    return brute


def test_against_brute_force(spark):
    random.seed(8)
    vocabulary = [f"w{int(random.paretovariate(0.6))}" for _ in range(500)]
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 60))) for _ in range(200)] + [None, "", "\n", "The the THE éÉ é"]
    brute = check(spark, texts[:150] + texts[-4:], texts + ["never seen words", "w1 never w1"])
    for v in ("<s>", "w1 "):
        unseen = (brute.word("unknown"), brute.pair("unknown", v))
        assert sum(brute.pair(w, v) for w in brute.words) + unseen[1] == pytest.approx(1.0)


def test_frequent_words_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(kn, "PART_BYTES", 64)
    random.seed(9)
    texts = [" ".join(random.choice(["the", "of", f"x{random.randint(0, 300)}"]) for _ in range(40)) for _ in range(60)]
    check(spark, texts, texts[:20])


def test_little_and_nothing_to_learn_from(spark):
    check(spark, ["a b a b", "a"], ["a b", "c", None])
    model = kn.train(spark.createDataFrame([], "text string"))
    row = kn.with_scores(spark.createDataFrame([("a b",)], "text string"), model).first()
    assert (row.n_tokens, row.n_known, row.score) == (3, 0, 0.0)


def test_awkward_rows(awkward, nothing):
    model = kn.train(awkward)
    out = kn.with_scores(awkward, model)
    assert out.count() == awkward.count() and out.columns[-4:] == list(kn.RESULTS)
    assert kn.with_scores(nothing, model).count() == 0


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(200), None]], "doc_id bigint").select("doc_id", kn.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2) for r in rows)


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (kn.unpacked(kn.packed(keys)) == keys).all() and (kn.unpacked_counts(kn.packed_counts(keys.view(np.int64))) == keys.view(np.int64)).all()
    assert kn.added_up(np.array([3, 1, 3], np.uint64), np.array([1, 2, 4]))[1].tolist() == [2, 5]


def test_perplexity_beats_the_word_model_on_held_out_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("held_out", kn.held_out("doc_id"))
    scored = kn.with_scores(docs, kn.train(docs.where("NOT held_out"))).where("held_out")
    row = scored.agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


class BruteOfOrder(Brute):
    """Grams as tuples; a text starts with one <s>, and grams that begin with it keep their own counts in the lower orders."""

    def __init__(self, texts, order):
        super().__init__(texts)
        rows = [("<s>", *self.tokens(t)) for t in texts]
        raw = {k: Counter(r[i:i + k] for r in rows for i in range(len(r) - k + 1)) for k in range(2, order + 1)}
        self.counts = {order: raw[order]}
        for k in range(2, order):
            self.counts[k] = Counter(g[1:] for g in raw[k + 1])
            self.counts[k].update({g: n for g, n in raw[k].items() if g[0] == "<s>"})
        self.d = {k: self.discounts(c) for k, c in self.counts.items()}
        self.sums, self.left = Counter(), defaultdict(float)
        for k, c in self.counts.items():
            for g, n in c.items():
                self.sums[g[:-1]] += n
                self.left[g[:-1]] += self.d[k][min(n, 3)]
        self.order = order

    def gram(self, w, context):
        lower = self.gram(w, context[1:]) if context else 0
        if not context:
            return self.word(w)
        if not self.sums[context]:
            return lower
        k, n = len(context) + 1, self.counts[len(context) + 1][(*context, w)]
        return max(n - self.d[k][min(n, 3)], 0) / self.sums[context] + self.left[context] / self.sums[context] * lower

    def score(self, text):
        t = ["<s>", *self.tokens(text)]
        return super().score(text)[:3] + (sum(math.log10(self.gram(t[i], tuple(t[max(0, i - self.order + 1):i]))) for i in range(1, len(t))),)


@pytest.mark.parametrize("order, part_bytes", [(2, 8 << 20), (3, 8 << 20), (3, 64), (4, 1 << 10)])
def test_orders_against_brute_force(spark, monkeypatch, order, part_bytes):
    monkeypatch.setattr(kn, "PART_BYTES", part_bytes)
    random.seed(10)
    vocabulary = [f"w{int(random.paretovariate(0.8))}" for _ in range(60)]
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 40))) for _ in range(80)] + [None, "", "a b", "a b", "a b c", "x"]
    brute = BruteOfOrder(texts[10:], order)
    model = kn.train(spark.createDataFrame([(t,) for t in texts[10:]], "text string").repartition(3), order=order)
    assert sorted(model.levels) == list(range(2, order + 1)) and model.levels[order].size == len(brute.counts[order])
    wanted = [*texts, "never seen words", "w1 never w1 w1 w2", "a b d"]
    for r in kn.with_scores(spark.createDataFrame(list(enumerate(wanted)), "k int, text string"), model).collect():
        want = brute.score(wanted[r.k])
        assert (r.n_tokens, r.n_known) == want[:2]
        assert r.base_score == pytest.approx(want[2], rel=1e-9) and r.score == pytest.approx(want[3], rel=1e-9)
    seen = random.Random(1).choice([c for c in brute.sums if len(c) == order - 1])
    assert sum(brute.gram(w, seen) for w in [*brute.words, "unknown"]) == pytest.approx(1.0)


def test_op8_uses_two_words_of_context(spark, tmp_path):
    from stylograin.llm.queries import QUERIES

    texts = ["a x b", "c x d", "a x b", "c x d", "a x d"] * 4
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op8_language_model"](spark, str(tmp_path)).collect()
    brute = BruteOfOrder([texts[r.doc_id] for r in rows if not r.held_out], 3)
    assert all(r.score == pytest.approx(brute.score(texts[r.doc_id])[3], rel=1e-9) for r in rows)


def test_a_large_corpus_has_few_parts():
    assert kn.text_per_part(1 << 30) == kn.PART_BYTES
    assert (12 << 30) / kn.text_per_part(12 << 30) <= 512


def test_a_look_up_asks_each_part_once(spark, monkeypatch):
    monkeypatch.setattr(kn, "PART_BYTES", 64)
    random.seed(12)
    texts = [" ".join(f"x{random.randint(0, 200)}" for _ in range(40)) for _ in range(60)]
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    asked, files = [], model.files
    monkeypatch.setattr(model, "files", lambda name: asked.append(name) or files(name))
    word = np.arange(-1, model.vocabulary)
    context = np.arange(model.vocabulary + 1)[::-1].copy()
    follows = context != model.numbers(np.array([kn.END]))[0]  # an end has nothing behind it
    word, context = word[follows], context[follows]
    asked.clear()
    found = model.looked_up(2, context, word)
    assert max(Counter(asked).values()) <= 3 and (found[0] >= 0).any()
    one_by_one = [model.looked_up(2, context[i:i + 1], word[i:i + 1]) for i in range(len(word))]
    for k in range(4):
        assert found[k].tolist() == [x[k][0] for x in one_by_one]
