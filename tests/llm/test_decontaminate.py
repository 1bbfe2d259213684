import random

import pytest

from stylograin.llm import decontaminate as d


def brute(doc, items, window):
    """Hit words and hit items of a text."""
    words, hit, found = d.words(doc), set(), set()
    for item_id, item in items:
        w = d.words(item)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == w[i:i + size]:
                    hit |= set(range(j, j + size))
                    found.add(item_id)
    return hit, sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    random.seed(seed)

    def text(n, alphabet="abcdef"):
        return " ".join(random.choice(alphabet) for _ in range(n)).encode()

    items = [(k, text(random.choice([0, 1, 2, 3, 4, 5, 8, 12]), "abc")) for k in range(8)]
    for window in (1, 3, 5):
        automaton = d.Automaton([(k, d.words(t)) for k, t in items], window)
        for _ in range(60):
            doc = text(random.randint(0, 25), "abcz")
            spans, found = automaton.matches(d.words(doc))
            assert ({i for a, b in spans for i in range(a, b)}, sorted(found)) == brute(doc, items, window)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def docs_and_items(spark):
    item = "Alpha beta, gamma delta; epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, f"before it {item.upper()} after it, and more words of its own so that it stays: a b c d e f g", None), (2, None, "x"), (3, "", None),
            (4, "clean text"), (5, "short item"), (6, "a short   ITEM, here and some other words"), (1, "clean text"), (None, item)]
    docs = spark.createDataFrame([(k, t, None, None) for k, t, *_ in docs], "doc_id bigint, text string, hit_items string, item_id string")
    items = spark.createDataFrame([(10, item, 1), (11, "Short item!", 1), (10, item, 1), (12, None, 1), (13, "", 1), (None, "clean text", 1)],
                                  "item_id bigint, text string, doc_id int")
    return docs, items


@pytest.mark.parametrize("block_words", [1000, 1])
def test_hits_whatever_the_blocks(spark, block_words):
    docs, items = docs_and_items(spark)
    rows = d.benchmark_hits(docs, items, block_words=block_words).collect()
    got = sorted((r.doc_id or 0, r.n_words, [(s.start, s.end) for s in r.hit_spans], r.hit_items) for r in rows)
    assert got == [(0, 12, [(0, 12)], [10]), (1, 2, [(0, 2)], [None]), (1, 33, [(2, 14)], [10]), (2, 0, [], []), (3, 0, [], []), (4, 2, [(0, 2)], [None]),
                   (5, 2, [(0, 2)], [11]), (6, 8, [(1, 3)], [11])]


def test_spans_are_cut_and_made_up_documents_go(spark):
    docs, items = docs_and_items(spark)
    kept = {(r.doc_id, r.text) for r in d.without_hits(docs, items).collect()}
    assert kept == {(1, "before it  after it, and more words of its own so that it stays: a b c d e f g"), (2, None), (3, ""),
                    (6, "a , here and some other words")}  # "clean text" is an item without an id


def test_no_items_and_no_documents(spark, awkward, nothing):
    _, items = docs_and_items(spark)
    assert {tuple(r.hit_items) for r in d.benchmark_hits(awkward, items.limit(0)).collect()} == {()}
    assert d.benchmark_hits(nothing, items).count() == 0
    assert d.without_hits(awkward, items).count() == awkward.count()


def test_items_without_an_id_hit_and_are_cut(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "a b d"), (3, "z")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "a b c"), (None, "a b d"), (7, "x a b")], "item_id bigint, text string")
    got = {r.doc_id: r for r in d.benchmark_hits(docs, items, window=3).collect()}
    assert got[1].hit_items == [7, None] and got[2].hit_items == [None] and got[3].hit_items == []
    assert [(s.start, s.end) for s in got[1].hit_spans] == [(0, 4)] and [(s.start, s.end) for s in got[2].hit_spans] == [(0, 3)]
