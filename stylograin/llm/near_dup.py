"""Near-duplicates by a multi-index Hamming join of MinHash signatures.

A text's set of word shingles is drawn down to ``SYMBOLS`` minimum hashes of 16 bits. Two
signatures within ``ERRORS`` differing symbols agree, by pigeonhole, on at least one of
``CHUNKS`` chunks up to one symbol; so every signature is filed under each chunk with each
one of its symbols left out, and all pairs within the distance meet in some file. Two sets
of Jaccard similarity 0.8 exceed that distance with a chance of 1.2 in a million.

Texts with equal sets are one class from the start. Within a file signatures are compared
in numpy, and of each connected part of the pairs within the distance a star is kept, never
the pairs. The components of these stars are then linked on their full sets. Files and components
of more than ``BLOCK`` members are cut into blocks, and each pair of blocks is a group of
its own: all pairs are compared, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import SortedArrays, components, mapped, mix, raw, saved_sorted, slices, stored
from stylograin.llm.wordhash import LOWER, hashes, runs, spans

SYMBOLS = 64
CHUNKS = 15
ERRORS = 29  # 2 * CHUNKS - 1: if every chunk had two errors or more, there would be 30
BLOCK = 1024

#: Odd multipliers and masks of the hash functions, by a fixed rule.
MASKS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)).astype(np.uint32)
FACTORS = mix(np.arange(1001, SYMBOLS + 1001, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
CUTS = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles, sorted and distinct within a text, and each text's first (one more than texts)."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets)
    found, begin = runs(hashes(data, starts, ends), first, size)
    text = np.repeat(np.arange(len(column)), np.diff(begin))
    order = np.lexsort([found, text])
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(column)))])


def signatures(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of ``SYMBOLS`` minimum hashes per non-empty set."""
    filled = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(filled), SYMBOLS), np.uint16)
    if len(filled):
        short = (found >> np.uint64(32)).astype(np.uint32)
        for k in range(SYMBOLS):
            x = (short ^ MASKS[k]) * FACTORS[k]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            x ^= x >> np.uint32(13)
            least = np.minimum.reduceat(x, filled)
            out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Per row: its key, the size of its set, 128 bits that name the set, and its signature (null for an empty set)."""
    def sketch(batches):
        for batch in slices(batches, text):
            found, begin = shingles(batch.column(text), size)
            n = np.diff(begin)
            filled = n > 0
            names = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
            if filled.any():
                at = begin[:-1][filled]
                names[0][filled] = np.add.reduceat(mix(found), at)
                names[1][filled] = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), at)
            signed = iter(signatures(found, begin))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n, pa.int64()), *[pa.array(x.view(np.int64)) for x in names],
                 pa.array([next(signed).tobytes() if f else None for f in filled], pa.binary())],
                names=["key", "n_shingles", "name1", "name2", "signature"])

    key_type = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), sketch, f"key {key_type}, n_shingles bigint, name1 bigint, name2 bigint, signature binary")


def files(classes: DataFrame) -> DataFrame:
    """One row per class and file: the file's hash and the class."""
    def file(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            rows = np.arange(len(signed))
            keys = []
            for chunk in range(CHUNKS):
                begin, end = CUTS[chunk], CUTS[chunk + 1]
                for out in range(begin, end):
                    x = np.full(len(signed), out + 1, np.uint64)
                    for k in range(begin, end):
                        if k != out:
                            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + signed[:, k] + np.uint64(1))
                    keys.append(x.view(np.int64))
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[part] for k in keys])),
                                                  batch.column("id").take(pa.array(np.tile(part, len(keys))))], names=["file", "id"])

    return mapped(classes.select("id", "signature"), file, "file bigint, id bigint")


def in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (with the group's size ``n``) in groups (``group``, ``first``, ``second``): all of a small group, or two blocks of a large one."""
    n_blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(17)), n_blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.struct(F.least(own, k).alias("first"), F.greatest(own, k).alias("second")))
    return rows.withColumn("_pair", F.explode(others)).select("*", "_pair.first", "_pair.second").drop("_pair", "n")


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in ``names``, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in names]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        if held:
            new[0] = any(held[-1].column(n)[held[-1].num_rows - 1] != batch.column(n)[0] for n in names)
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:]):
            if held and (begin or new[0]):
                yield pa.Table.from_batches(held)
                held = []
            if end > begin:
                held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def stars(ids: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest id of each connected part to the others, where ``near(i)`` lists the neighbours of row ``i`` after it.

    Files that hold the same texts give the same edges, which a tree of the links would not.
    """
    label = np.arange(len(ids))
    for i in range(len(ids) - 1):
        others = near(i)
        if len(others):
            labels = np.unique(label[others])
            fresh = labels[labels != label[i]]
            if len(fresh):
                label[np.isin(label, fresh)] = label[i]
    order = np.lexsort([ids, label])
    first = np.ones(len(ids), bool)
    first[1:] = label[order][1:] != label[order][:-1]
    smallest = ids[order][first][np.cumsum(first) - 1]
    return smallest[~first], ids[order][~first]


def edge_batches(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for smallest, others in found:
        if len(others):
            a.append(smallest)
            b.append(others)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def close_signatures(classes: DataFrame) -> DataFrame:
    """Edges (a, b) that join all classes whose signatures are within the distance, directly or over others."""
    shared = stored(files(classes).groupBy("file").agg(F.count("*").alias("n")).where("n > 1"), "files")
    filed = files(classes).join(shared, "file").join(classes.select("id", "signature"), "id")  # only now with signatures
    rows = in_blocks(filed, "file")
    names = ["file", "first", "second"]

    def compare(batches):
        def each():
            for table in groups(batches, names):
                ids = table.column("id").to_numpy()
                signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                yield stars(ids, lambda i: i + 1 + np.flatnonzero(np.count_nonzero(signed[i + 1:] != signed[i], axis=1) <= ERRORS))
        yield from edge_batches(each())

    return mapped(rows.repartition(*names).sortWithinPartitions(*names), compare, "a bigint, b bigint").distinct()


def similar_sets(docs: DataFrame, members: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """Edges (a, b) that join all classes of a component whose full sets are similar, directly or over others.

    ``members`` (id, component) are classes named by a document's key. Their texts are found
    where they lie, by a look-up in sorted arrays: texts are not shuffled, the sets of the
    members are.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    parts = saved_sorted(members.withColumn("component", F.col("component").cast("long")), "id", ["component"], "members")

    def collect(batches):
        arrays = SortedArrays(parts, "id")
        for batch in batches:
            batch = batch.filter(batch.column(key).is_valid())
            found, (component,) = arrays.look_up(batch.column(key).cast(pa.int64()).to_numpy(), ["component"])
            batch, component = batch.filter(pa.array(found)), component[found]
            at = 0
            for part in slices([batch], text):
                sets, begin = shingles(part.column(text), size)
                made = pa.RecordBatch.from_arrays(
                    [pa.array(component[at:at + part.num_rows], pa.int64()), part.column(key).cast(pa.int64()),
                     pa.array([sets[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())], names=["component", "id", "members"])
                yield made.filter(pa.array(np.diff(begin) > 0))
                at += part.num_rows

    sets = mapped(docs.select(key, text), collect, "component bigint, id bigint, members binary")
    rows = in_blocks(sets.join(stored(sizes, "sizes"), "component"), "component")
    names = ["component", "first", "second"]

    def link(batches):
        def each():
            for table in groups(batches, names):
                ids = table.column("id").to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
                tokens, number = np.unique(np.concatenate(sets), return_inverse=True)
                n = np.array([len(s) for s in sets])
                begin = np.concatenate([[0], np.cumsum(n)])
                seen = np.zeros(len(tokens), bool)

                def near(i):
                    if i + 1 == len(sets):
                        return np.empty(0, int)
                    seen[number[begin[i]:begin[i + 1]]] = True
                    both = np.add.reduceat(seen[number[begin[i + 1]:]], begin[i + 1:-1] - begin[i + 1], dtype=np.int64)
                    seen[number[begin[i]:begin[i + 1]]] = False
                    return i + 1 + np.flatnonzero(both >= similarity * (n[i] + n[i + 1:] - both) - 1e-9)

                yield stars(ids, near)
        yield from edge_batches(each())

    return mapped(rows.repartition(*names).sortWithinPartitions(*names), link, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, similarity: float = 0.8) -> DataFrame:
    """Per row: its key, ``n_shingles``, ``component_id`` (smallest key it is linked with, itself included) and ``kept``.

    Words are runs of anything but blanks and ASCII white space, A-Z lowered; a set holds
    the distinct shingles of ``size`` words, or the whole text as one if it has fewer. Rows
    are linked if their sets' similarity is ``similarity`` (0.8 or more) or above, and a row
    is kept if it is the first of its component. Rows without words are linked with
    nothing and kept. Rows with a null key cannot be named: they are kept, and their
    component is null. Keys must be integers and should be unique: of rows that repeat one,
    equal texts are judged alike, and links of different texts count for the key.
    """
    if similarity < 0.8:
        raise ValueError("the signatures' distance is meant for similarities of 0.8 or more")
    rows = stored(sketches(docs, key, text, size).withColumn("key", F.col("key").cast("long")), "sketches")
    named = rows.where("key IS NOT NULL AND n_shingles > 0")
    classes = stored(named.groupBy("name1", "name2").agg(F.min("key").alias("id"), F.first("signature").alias("signature")), "classes")
    close = components(close_signatures(classes))
    linked = components(similar_sets(docs, close, key, text, size, similarity))
    found = stored(classes.select("name1", "name2", "id").join(linked, "id", "left")
                   .select("name1", "name2", F.coalesce("component", "id").alias("component_id")), "found")
    out = rows.drop("signature").join(found, ["name1", "name2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    component = F.when(F.col("key").isNotNull(), own)
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest key.

    The keys that go are looked up in sorted arrays, so texts stay where they are.
    """
    gone = near_duplicates(docs, key=key, text=text, size=size, similarity=similarity).where("NOT kept").select(F.col(key).alias("gone")).distinct()
    parts = saved_sorted(gone, "gone", [], "gone")

    def keep(batches):
        arrays = SortedArrays(parts, "gone")
        for batch in batches:
            keys = batch.column(key)
            found, _ = arrays.look_up(keys.fill_null(0).cast(pa.int64()).to_numpy(), [])
            yield batch.filter(pa.array(~found | keys.is_null().to_numpy(zero_copy_only=False)))

    return mapped(docs, keep, docs.schema)
