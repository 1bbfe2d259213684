import random

import numpy as np
import pytest
from test_near_dup import brute, families

from stylograin.llm import set_join


def check(spark, rows, size=4, percent=85):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in set_join.jaccard_components(df, size=size, percent=percent).collect())
    assert got == sorted((k or -1, n, c or -1) for (k, _), (n, c) in zip(rows, brute(rows, size, percent)))
    return got


def test_against_brute_force(spark):
    rows = families(11) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE two"), (9006, "one two three four"), (None, "one two"), (9004, "one two")]
    got = check(spark, rows)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_sizes_at_the_threshold(spark):
    rows, k = [], 0
    for n in (7, 8, 12, 13, 20, 40, 41, 100, 333):  # texts that differ in a tail of each possible length around the threshold
        base = [f"n{n}w{i}" for i in range(n + 3)]
        for cut in range(0, max(2, n // 6) + 2):
            k += 1
            rows.append((k, " ".join(base[:len(base) - cut] + [f"x{k}y{i}" for i in range(cut % 3)])))
    check(spark, rows)
    check(spark, rows, percent=60, size=2)


def test_large_clusters_in_blocks_and_pieces(spark, monkeypatch):
    rows = families(12, n=4, copies=60, size=(30, 60))
    random.seed(13)  # a chain: each text is linked with the next few only
    chain = [f"c{i}" for i in range(400)]
    rows += [(5000 + k, " ".join(chain[2 * k:2 * k + 60])) for k in range(120)]
    plain = check(spark, rows)

    monkeypatch.setattr(set_join, "BLOCK", 7)
    assert check(spark, rows) == plain


def test_hot_passage_and_short_texts(spark):
    random.seed(14)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k + 1, " ".join(f"u{k}x{i}" for i in range(random.randint(0, 30))) + " " + passage) for k in range(150)]
    rows += [(1000 + k, f"a b c d e f g{k % 7}") for k in range(40)]
    check(spark, rows)


def test_awkward_rows(awkward, nothing):
    rows = set_join.jaccard_components(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2, 3, 4}
    assert set_join.jaccard_components(nothing).count() == 0
    with pytest.raises(ValueError):
        set_join.jaccard_components(awkward, percent=100)


def test_partners_share_a_family_and_an_unspared_bucket():
    rng = np.random.default_rng(1)
    bands = set_join.Bands(85)
    for n in [7, 9, 14, 30, 77, 200, 1500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
            most = 15 * n // 100  # the smaller set is a part of the larger
            b = np.sort(rng.choice(a, n - rng.integers(0, most + 1), replace=False))
            found, begin = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            band = bands.of(np.diff(begin))
            shared = set()
            for family in (band, band - 1):
                tile, of = set_join.tiles_of(found, begin, family, bands)
                shared |= {(0, x) for x in tile[of == 0].tolist()} | {(1, x) for x in tile[of == 1].tolist()}
            assert len(a) == len(b) or {x for w, x in shared if w == 0} & {x for w, x in shared if w == 1}


def test_bitmaps_never_underestimate_the_overlap():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (5, 60, 64, 65, 700)]
    sets += [np.unique(np.concatenate([s[:-2], rng.integers(0, 2 ** 63, 1, dtype=np.uint64)])) for s in sets]
    for a in sets:
        for b in sets:
            for bits in (64, 1024):
                wide = set_join.narrowed(set_join.bitmap(a, 4096), bits // 64)
                assert (wide == set_join.bitmap(a, bits)).all()
                differ = int(np.bitwise_count(wide ^ set_join.bitmap(b, bits)).sum())
                assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) / 2
