import os

import numpy as np
import pyarrow as pa
import pytest

from stylograin.llm import common, wordhash


def test_raw_of_slices_nulls_and_kinds():
    texts = ["ab", None, "", "é", "xyz"]
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        column = pa.array([t.encode() if t is not None else None for t in texts], pa.binary()).cast(kind)
        data, offsets = common.raw(column.slice(1, 4))
        assert data.tobytes().decode() == "éxyz" and offsets.tolist() == [0, 0, 0, 2, 5]
    assert common.raw(pa.array([], pa.string()))[1].tolist() == [0]
    assert common.raw(pa.array([None, None], pa.string()))[1].tolist() == [0, 0, 0]


def test_slices_hold_about_as_many_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10] * 5 + ["b" * 100] + ["c"] * 3 + [None]})
    parts = list(common.slices([batch, batch.slice(0, 0)], "t", 25))
    assert sum(p.num_rows for p in parts) == 10 and [p.column(0).to_pylist() for p in parts][0] == ["a" * 10] * 2
    assert ["b" * 100] in [p.column(0).to_pylist() for p in parts]


def test_words_and_hashes_do_not_depend_on_their_place(monkeypatch):
    texts = ["one two one", "", " two  one ", "x" * 50 + " one", None, "\n"]
    data, offsets = common.raw(pa.array(texts))
    starts, ends, first = wordhash.spans(data, offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert words == [w.encode() for t in texts if t for w in t.split()] and np.diff(first).tolist() == [3, 0, 2, 2, 0, 0]
    whole = wordhash.hashes(data, starts, ends)
    monkeypatch.setattr(wordhash, "CHUNK", 8)
    assert (wordhash.hashes(data, starts, ends) == whole).all()
    by_word = {w: set() for w in words}
    for w, h in zip(words, whole.tolist()):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({h for v in by_word.values() for h in v}) == len(by_word)
    runs, begin = wordhash.runs(whole, first, 3)
    assert np.diff(begin).tolist() == [1, 0, 1, 1, 0, 0] and len(set(runs.tolist())) == 3


def test_look_up_in_sorted_arrays(spark):
    rows = [(k * 3 - 50, k) for k in range(100)] + [(None, 5)]
    parts = common.saved_sorted(spark.createDataFrame(rows, "k bigint, v bigint"), "k", ["v"], "arrays")
    arrays = common.SortedArrays(parts, "k")
    keys = np.array([-50, 1, 247, 248, -1000, 10 ** 12, 1])
    found, (values,) = arrays.look_up(keys, ["v"])
    assert found.tolist() == [True, True, True, False, False, False, True] and values[found].tolist() == [0, 17, 99, 17]
    nothing = common.SortedArrays(common.saved_sorted(spark.createDataFrame([], "k bigint, v bigint"), "k", ["v"], "arrays"), "k")
    assert not nothing.look_up(keys, ["v"])[0].any()


def test_files_need_a_mounted_folder(spark, monkeypatch):
    monkeypatch.setattr(common, "scratch_path", lambda *_: "hdfs://host/folder")
    with pytest.raises(ValueError):
        common.shared_files(spark, "x")


def test_mapped_arrays_keep_few_files_open(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "OPEN_FILES", 3)
    for k in range(10):
        common.save_arrays(str(tmp_path), f"a{k}", {"x": np.arange(k, dtype=np.uint8), "y": np.full((2, k), k / 2), "empty": np.empty((0, 4), np.uint32)})
    files = common.MappedArrays(str(tmp_path))
    for k in [*range(10), 3, 0, 9]:
        held = files(f"a{k}")
        assert held["x"].tolist() == list(range(k)) and held["y"].shape == (2, k) and (held["y"] == k / 2).all() and held["empty"].shape == (0, 4)
        assert len(files.open) <= 3
    assert sum("a" in os.path.basename(os.readlink(f"/proc/self/fd/{d}")) and ".arrays" in os.readlink(f"/proc/self/fd/{d}")
               for d in os.listdir("/proc/self/fd") if os.path.exists(f"/proc/self/fd/{d}")) <= 4


@pytest.mark.skipif(not common.MappedArrays.without_handles, reason="mappings keep handles before Python 3.13")
def test_more_files_than_a_thousand_stay_mapped(tmp_path):
    for k in range(1100):
        common.save_arrays(str(tmp_path), f"a{k}", {"x": np.array([k])})
    files, handles = common.MappedArrays(str(tmp_path)), len(os.listdir("/proc/self/fd"))
    held = [files(f"a{k}") for k in range(1100)]
    assert all(files(f"a{k}") is x for k, x in enumerate(held)) and len(os.listdir("/proc/self/fd")) <= handles + 1
