"""Helpers of the corpus operators: Arrow batches as numpy arrays, and tables kept in the shared folder."""

from __future__ import annotations

import json
import mmap
import os
import resource
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograin.session import scratch_path

SLICE_BYTES = 2 << 20
OPEN_FILES = 1 << 14
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow``, with this package's folder on the path of the workers, where they can see it.

    Batches are counted in rows, and rows hold whole texts: where the session leaves the
    size of a batch at Spark's 10,000 rows, it is set to ``BATCH_ROWS``.
    """
    if df.sparkSession.conf.get(BATCH_SETTING) == "10000":
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return df.mapInArrow(fn, schema)


def shared_files(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder, for files that workers map into memory.

    The shared folder must be mounted in the file system of all machines; a folder in an
    object store cannot be mapped, and is refused.
    """
    url = urlparse(scratch_path(spark, name))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {url.scheme}://")
    folder = unquote(url.path)
    os.makedirs(folder, exist_ok=True)
    return folder


def save_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write several arrays into one file, all of it or nothing: their bytes, a table of contents, and its length."""
    partial, at, contents = f"{folder}/.{name}-{uuid.uuid4().hex}", 0, {}
    with open(partial, "wb") as out:
        for key, array in arrays.items():
            data = np.ascontiguousarray(array)
            contents[key] = (data.dtype.str, data.shape, at)
            out.write(data.tobytes())
            pad = -data.nbytes % 8
            out.write(bytes(pad))
            at += data.nbytes + pad
        end = json.dumps(contents).encode()
        out.write(end + len(end).to_bytes(8, "little"))
    os.replace(partial, f"{folder}/{name}.arrays")


class MappedArrays:
    """Files of ``save_arrays`` mapped into memory: one mapping per file, and only of the ``OPEN_FILES`` files used last.

    Before Python 3.13 a mapping keeps a file handle: then at most a quarter of those that the process may have.
    """

    without_handles = sys.version_info >= (3, 13)

    def __init__(self, folder: str):
        self.folder, self.most, self.open = folder, OPEN_FILES, OrderedDict()
        if not self.without_handles:
            self.most = min(1024, OPEN_FILES, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 4)

    def __call__(self, name: str) -> dict[str, np.ndarray]:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        with open(f"{self.folder}/{name}.arrays", "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if self.without_handles else {}))
        length = int.from_bytes(data[-8:], "little")
        contents = json.loads(data[-8 - length:-8])
        plain = np.frombuffer(data, np.uint8)
        found = {key: plain[at:at + int(np.prod(shape)) * np.dtype(kind).itemsize].view(kind).reshape(shape) for key, (kind, shape, at) in contents.items()}
        self.open[name] = found
        if len(self.open) > self.most:
            self.open.popitem(last=False)
        return found


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, index, data = column.buffers()
    if len(column) == 0 or index is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(index, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if column.null_count:
        empty = ~column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[empty] > 0).any():  # bytes below a null
            return raw(column.fill_null(b"" if pa.types.is_binary(column.type) else ""))
    return body, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds about ``most`` bytes; one long text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to


def joined(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose ``column`` holds about ``most`` bytes, over the batches' edges.

    What is looked up for many rows at once opens each part's file once.
    """
    held, size = [], 0
    for batch in slices(batches, column, most):
        held.append(batch)
        size += int(raw(batch.column(column))[1][-1])
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def saved_sorted(df: DataFrame, key: str, values: list[str], name: str) -> list[tuple[str, int, int]]:
    """Write a table as sorted arrays in the shared folder, for ``SortedArrays``; returns the parts (path, first, last).

    Each range of keys is written by one task under the name of its first key, so a task
    that runs twice writes the same file again. Null keys are left out.
    """
    folder = shared_files(df.sparkSession, name)
    ranged = df.where(df[key].isNotNull()).select(key, *values)
    ranged = ranged.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)

    def save(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            keys = table.column(key).to_numpy()
            part = f"{int(keys[0]) & (1 << 64) - 1:016x}"
            save_arrays(folder, part, {c: table.column(c).to_numpy() for c in (key, *values)})
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{part}"], "first": [int(keys[0])], "last": [int(keys[-1])]})

    rows = mapped(ranged, save, "path string, first bigint, last bigint").collect()
    return sorted((r.path, r.first, r.last) for r in rows)


class SortedArrays:
    """Look-up in the arrays of ``saved_sorted``, mapped into memory part by part."""

    def __init__(self, parts: list[tuple[str, int, int]], key: str):
        self.parts, self.key = sorted(parts, key=lambda p: p[1]), key
        self.files = MappedArrays(os.path.dirname(self.parts[0][0]) if parts else "")
        self.lasts = np.array([p[2] for p in self.parts], np.int64)

    def array(self, part: int, column: str) -> np.ndarray:
        return self.files(os.path.basename(self.parts[part][0]))[column]

    def look_up(self, keys: np.ndarray, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is there, and the values of its first row (0 where it is not)."""
        found = np.zeros(len(keys), bool)
        out = [None] * len(columns)
        if len(self.parts) and len(keys):
            order = np.argsort(keys, kind="stable")
            wanted = keys[order]
            part_of = np.searchsorted(self.lasts, wanted, "left")
            for part in np.unique(part_of[part_of < len(self.parts)]).tolist():
                a, b = np.searchsorted(part_of, [part, part + 1])
                held = self.array(part, self.key)
                at = np.minimum(np.searchsorted(held, wanted[a:b]), len(held) - 1)
                hit = held[at] == wanted[a:b]
                rows = order[a:b][hit]
                found[rows] = True
                for k, column in enumerate(columns):
                    values = self.array(part, column)
                    if out[k] is None:
                        out[k] = np.zeros(len(keys), values.dtype)
                    out[k][rows] = values[at[hit]]
        return found, [np.zeros(len(keys), np.int64) if x is None else x for x in out]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest id that each id is linked with, over any number of links: columns ``id`` and ``component``.

    Each round takes the least label among an id's neighbours and then the label of that
    label, so the rounds grow with the logarithm of the longest chain. Both sides of every
    join are stored tables, whose shuffles Spark can split where an id has very many links.
    """
    spark = edges.sparkSession
    both = stored(edges.select(F.col(a).alias("id"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = stored(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("component"))
        lower = stored(labels.withColumn("before", F.col("component")).unionByName(near, allowMissingColumns=True)
                       .groupBy("id").agg(F.min("component").alias("component"), F.max("before").alias("before")), "labels")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = stored(lower.join(jump, "component").select("id", F.least("component", "further").alias("component")), "labels")
        if lower.where("component <> before").isEmpty():
            return lower.select("id", "component")
