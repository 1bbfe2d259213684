import random
import re
from collections import Counter, defaultdict

import pytest

from stylograin.llm import common, near_dup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size=4, percent=80):
    """Per row: size of its set and component."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n) and rows[i][0] is not None and rows[j][0] is not None:
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(len(s), None if rows[i][0] is None else least[root(i)]) for i, s in enumerate(sets)]


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dup.near_duplicates(df, **how).collect())
    want = sorted((k or -1, n, c or -1, k is None or c == k) for (k, _), (n, c) in zip(rows, brute(rows, how.get("size", 4))))
    assert got == want


def families(seed, n=40, copies=8, size=(8, 120)):
    random.seed(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n):
        base = [random.choice(words) for _ in range(random.randint(*size))]
        for _ in range(random.randint(1, copies)):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
                text[random.randrange(len(text))] = random.choice(words)
            rows.append((len(rows) + 1, random.choice([" ", "\n", "\t "]).join(text)))
    random.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = families(1) + [(9001, None), (9002, ""), (9003, "  "), (9004, "one two"), (9005, "ONE two"), (9006, "one two three four"), (None, "one two"), (9004, "one two")]
    check(spark, rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    check(spark, families(2, n=3, copies=40), size=5)


def test_hub_whose_copies_are_linked_only_with_it(spark):
    random.seed(3)
    base = [f"b{i}" for i in range(80)]
    rows = [(500, " ".join(base))]
    for k in range(30):
        text = list(base)
        for at in random.sample(range(80), 2):
            text[at] = f"z{k}x{at}"
        rows.append((k + 1, " ".join(text)))
    check(spark, rows)


def test_passage_that_many_share(spark):
    random.seed(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k + 1, " ".join(f"u{k}x{i}" for i in range(random.randint(5, 30))) + " " + passage) for k in range(120)]
    check(spark, rows)


def test_pigeonhole_numbers():
    sizes = [b - a for a, b in zip(near_dup.CUTS, near_dup.CUTS[1:])]
    assert sum(sizes) == near_dup.SYMBOLS and min(sizes) >= 3 and near_dup.ERRORS < 2 * near_dup.CHUNKS


def test_awkward_rows(awkward, nothing):
    rows = near_dup.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    kept = near_dup.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 8, 9]
    assert near_dup.near_duplicates(nothing).count() == 0 and near_dup.without_near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(awkward, similarity=0.5)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 200), (155, 300)]
    random.shuffle(edges)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and all(got[100 + k] == 100 for k in range(50)) and got[200] == 200 and got[300] == 155
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
