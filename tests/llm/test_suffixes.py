import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stylograin.llm import suffixes


def brute(rows, window=suffixes.WINDOW):
    """Per row: removed byte spans."""
    least = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        if k is not None:
            for j in range(len(b) - window + 1):
                w = b[j:j + window]
                least[w] = min(least.get(w, k), k)
    out = []
    for k, b in data:
        gone = np.zeros(len(b) + 2, int)
        for j in range(len(b) - window + 1):
            if k is not None and least[b[j:j + window]] < k:
                gone[j + 1:j + window + 1] = 1
        edge = np.flatnonzero(np.diff(gone))
        out.append([tuple(x) for x in edge.reshape(-1, 2).tolist()])
    return out


def check(spark, rows):
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id bigint, text string, kept int").repartition(3)
    got = {r.n: r for r in suffixes.without_repeats(df.withColumnRenamed("kept", "n")).collect()}
    for n, ((_, text), spans) in enumerate(zip(rows, brute(rows))):
        assert [(s.start, s.end) for s in got[n].removed] == spans, n
        data, parts, at = (text or "").encode(), [], 0
        for a, b in spans:
            parts.append(data[at:a])
            at = b
        assert bytes(got[n].kept) == b"".join([*parts, data[at:]])


def test_against_brute_force(spark):
    random.seed(3)
    words = ["".join(random.choice("abé") for _ in range(random.randint(1, 5))) for _ in range(40)]

    def text(n):
        return " ".join(random.choice(words) for _ in range(n))

    passages = [text(25) for _ in range(6)]
    rows = []
    for k in random.sample(range(100), 60):
        parts = [text(random.randint(0, 60)) for _ in range(3)]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            a = random.randint(0, len(p) // 2)
            parts.insert(random.randint(0, 3), p[a:a + random.randint(10, len(p))])
        rows.append((k, "".join(parts)))
    rows += [(200 + k, t) for k, t in rows[:10]] + [rows[0], (5, rows[3][1]), (None, rows[4][1]), (301, None), (302, ""), (303, "a" * 49)]
    rows += [(310, "ab" * 200), (311, "ab" * 150 + "c"), (312, "a" * 300), (313, "a" * 120 + "b" + "a" * 70), (314, "x" * 50), (315, "x" * 50), (316, "x" * 51)]
    check(spark, rows)


def test_long_text_over_several_chunks(spark, monkeypatch):
    random.seed(5)
    long = "".join(random.choice("abcdefgh \n") for _ in range(30_000))
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    data = np.frombuffer((long + long[100:400]).encode(), np.uint8)
    offsets = np.array([0, len(long), len(data)])
    cut = suffixes.Anchors(data, offsets)
    monkeypatch.setattr(suffixes, "CHUNK", 1 << 20)
    whole = suffixes.Anchors(data, offsets)
    covered = [{(t, a - o) for t, a, lo, hi in zip(x.text, x.at, x.low, x.high) for o in range(lo, hi + 1)} for x in (cut, whole)]
    assert covered[0] == covered[1] and len(covered[1]) == len(long) - 49 + 300 - 49
    check(spark, [(1, long), (2, long[500:900] + "zz" + long[20_000:20_100]), (3, long)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), max_size=9))
def test_loser_tree_merges_and_gives_common_prefixes(runs):
    runs = [sorted(r) for r in runs]
    coded = [(r, [0] + [suffixes.common(a, b, 0) for a, b in zip(r, r[1:])] if r else []) for r in runs]
    source, prefix = suffixes.loser_tree(coded)
    place, merged = [0] * len(runs), []
    for s in source:
        merged.append(runs[s][place[s]])
        place[s] += 1
    assert merged == sorted(x for r in runs for x in r)
    assert [suffixes.common(a, b, 0) for a, b in zip(merged, merged[1:])] == prefix[1:].tolist()


def test_awkward_rows(awkward, nothing):
    out = suffixes.without_repeats(awkward.drop("key"))
    assert out.columns == [c for c in awkward.columns if c not in ("key", "removed", "kept")] + ["removed", "kept"]
    assert out.count() == awkward.count()
    assert suffixes.without_repeats(nothing).count() == 0


def test_digest_of_a_text_without_repeats(spark):
    row = suffixes.without_repeats(spark.createDataFrame([(1, "é" * 60)], "doc_id bigint, text string")).first()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == hashlib.sha256(("é" * 60).encode()).hexdigest() and row.removed == []


def test_keys_must_be_integers(spark):
    with pytest.raises(Exception):
        suffixes.without_repeats(spark.createDataFrame([("x", "t" * 60)], "doc_id string, text string")).collect()


def test_anchors_of_a_text_do_not_depend_on_the_texts_beside_it(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (0, 40, 120, 1000, 299, 300, 301, 70, 650)]

    def anchors(joined, which):
        found = suffixes.Anchors(np.frombuffer(b"".join(joined), np.uint8), np.cumsum([0, *map(len, joined)]))
        mine = found.text == which
        start = sum(map(len, joined[:which]))
        return sorted(zip((found.at[mine] - start).tolist(), found.low[mine].tolist(), found.high[mine].tolist(), found.context[mine].tolist()))

    for k, text in enumerate(texts):
        assert anchors(texts, k) == anchors([text], 0) == anchors([texts[4], text], 1)
    assert suffixes.chunk_edges(np.cumsum([0, *map(len, texts)]))[-1] == sum(map(len, texts))
    assert suffixes.chunk_edges(np.zeros(1, np.int64)) == [0]


def test_each_part_is_opened_once_for_many_batches(monkeypatch, spark, tmp_path):
    """With more parts than mapped files, every slice of a text opened every file again."""
    assert suffixes.part_bytes(1 << 30) == suffixes.PART_BYTES
    assert 12 * (1 << 30) / suffixes.part_bytes(12 * (1 << 30)) <= 512
    bits = 6
    heads = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 4000).astype(np.uint64) << np.uint64(1))
    for part, mine in enumerate(np.split(heads, np.searchsorted(heads >> np.uint64(64 - bits), np.arange(1, 1 << bits)))):
        suffixes.save_arrays(str(tmp_path), f"heads-{part}", {"values": mine})
        suffixes.save_arrays(str(tmp_path), f"windows-{part}", {"contexts": mine, "from": mine % 3, "to": mine % 5, "documents": mine % 7})
    arrays, calls = suffixes._Arrays(str(tmp_path), bits), []
    files = arrays.files
    monkeypatch.setattr(arrays, "files", lambda name: calls.append(name) or files(name))
    assert arrays.repeated(np.append(heads[::2], heads[0] + np.uint64(1))).tolist() == [True] * 2000 + [False]
    row, start, end, document = arrays.shared_windows(heads, heads)
    assert len(calls) == 2 * (1 << bits)
    assert (document == (heads[row] % 7).astype(np.int64)).all() and (start == (heads[row] % 3).astype(np.int64)).all() and sorted(row) == list(range(4000))


def test_slices_join_over_batches():
    import pyarrow as pa

    batches = pa.table({"k": range(100), "text": ["x" * 50] * 99 + ["y" * 5000]}).to_batches(max_chunksize=7)
    found = list(suffixes.joined(iter(batches), "text", 1000))
    assert [r for b in found for r in b.column("k").to_pylist()] == list(range(100)) and len(found) == 5
