"""Blocks of training rows as arrays in the shared folder, and sums over them.

A fit asks for many sums over the same rows. Tasks map a block's arrays into memory, so a sum moves nothing but
what it asks with and what it returns: no rows go through the JVM. A block belongs to no executor, so a lost one
takes nothing along. The shared folder must be mounted on all machines; one in an object store is refused.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import SparkSession

from stylograin.session import importable_on_workers, scratch_path

#: Partial sums that the driver adds up by itself; more are first added up in tasks.
DIRECT = 32
#: Bytes of what is shared that go with each task.
WITH_TASKS = 1 << 16


def block_folder(spark: SparkSession) -> str:
    url = urlparse(scratch_path(spark, "blocks"))
    if url.scheme not in ("", "file"):
        raise ValueError(f"blocks of training rows need a mounted shared folder, not {url.scheme}://")
    folder = unquote(url.path)
    os.makedirs(folder, exist_ok=True)
    return folder


def save_block(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a block under a name that no other attempt has used, and return it as a path."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}"
    for name, array in arrays.items():
        save_array(path, name, array)
    return path


def save_array(path: str, name: str, array: np.ndarray) -> None:
    """Write or replace one array of a block, all of it or nothing."""
    partial = f"{path}.{name}-{uuid.uuid4().hex}"
    with open(partial, "wb") as out:
        np.save(out, np.ascontiguousarray(array))
    os.replace(partial, f"{path}.{name}.npy")


def load_array(path: str, name: str) -> np.ndarray:
    file = f"{path}.{name}.npy"
    # A file of a header alone cannot be mapped.
    return np.load(file, mmap_mode="r" if os.path.getsize(file) > 4096 else None).view(np.ndarray)


def block_count(total: int, largest: int, cores: int) -> int:
    """One block up to ``largest`` entries; beyond it, enough blocks for all cores, of a quarter of that at least."""
    return 1 if total <= largest else max(-(-total // largest), min(cores, -(-4 * total // largest)))


def summed(spark: SparkSession, paths: Sequence[str], fn: Callable[..., np.ndarray], *shared: np.ndarray) -> np.ndarray:
    """The sum over all blocks of ``fn(path, *shared)``, an array whose length does not depend on the rows."""
    importable_on_workers(spark)
    sc = spark.sparkContext
    # What is small goes with the tasks: a broadcast costs more than the rest of a short job.
    small = all(isinstance(a, np.ndarray) for a in shared) and sum(a.nbytes for a in shared) <= WITH_TASKS
    held = None if small else sc.broadcast(shared)
    sent = shared if small else ()

    def add_up(part):
        total, asked = None, sent if held is None else held.value
        for path in part:
            found = fn(path, *asked)
            total = found if total is None else np.add(total, found, out=total)
        if total is not None:
            yield total

    tasks = min(len(paths), sc.defaultParallelism)
    found = sc.parallelize(paths, tasks).mapPartitions(add_up)
    out = found.treeReduce(np.add, 2) if tasks > DIRECT else found.reduce(np.add)
    if held is not None:
        held.destroy()
    return out


def over_blocks(spark: SparkSession, paths: Sequence[str], fn: Callable[[str], object]) -> list:
    """``fn`` of each block, a small result."""
    importable_on_workers(spark)
    return spark.sparkContext.parallelize(paths, len(paths)).map(fn).collect()
