"""An interpolated modified Kneser-Ney model of any order, counted in Spark and read from sorted arrays.

Words are 64-bit hashes, numbered by their place among all words. A run of k words (a gram)
is the number of its first k - 1 words, its context, and the number of its last word; its
own number is its place among all grams of k words. Each order takes an exchange of packed
sorted arrays that a task has already added up: by scrambled context, so that a context's
grams are together, where those of frequent contexts are dealt out by their last word too.
From the distinct grams, a further exchange counts the different words before each shorter
gram, which are the counts of the lower orders; a gram at the start of a text has no word
before it and keeps its own count. Every range is added up by one task, which writes its
arrays to the shared folder; scoring maps them into memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import MappedArrays, joined, mapped, mix, raw, save_arrays, shared_files, slices, stored
from stylograin.llm.wordhash import LOWER, hashes, spans

END = np.uint64(0x13198A2E03707344)
PART_BYTES = 8 << 20
FEW_PARTS = 256
LARGE_PART_BYTES = 32 << 20
LOOKED_UP_BYTES = 4 << 20
SCORED_BYTES = 8 << 20
GATHERED = 1 << 22


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit integers as compressed differences, byte planes apart."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def added_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts (1 each if there are none)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts, at)


class Gathered:
    """Keys of a task, added up now and then, and given out by part as packed rows."""

    def __init__(self):
        self.open: list[np.ndarray] = []
        self.size, self.keys, self.counts = 0, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.open.append(keys)
        self.size += len(keys)
        if self.size >= GATHERED:
            self.settle()

    def settle(self) -> None:
        if self.open:
            keys, counts = added_up(np.concatenate(self.open))
            self.keys, self.counts = added_up(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
            self.open, self.size = [], 0

    def by_range(self, bits: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
        """All keys by their first bits, one row per range that has any; counts up to ``most``."""
        self.settle()
        edges = np.searchsorted((self.keys >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(edges)).tolist()
        counts = self.counts if most is None else np.minimum(self.counts, most)
        if full:
            yield packed_rows(full, [self.keys[edges[p]:edges[p + 1]] for p in full], [counts[edges[p]:edges[p + 1]] for p in full])


PACKED = "part int, keys binary, counts binary"


def packed_rows(parts: list[int], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([packed(k) for k in keys], pa.binary()),
                                       pa.array([packed_counts(c) for c in counts], pa.binary())], names=["part", "keys", "counts"])


def merged(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray, np.ndarray]:
    """The part and the sums of all rows of a partition; rows are added up as they come."""
    part, all_ = None, Gathered()
    for batch in batches:
        for p, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            part = p
            all_.open.append((unpacked(keys), unpacked_counts(counts)))
            all_.size += len(all_.open[-1][0])
            if all_.size >= GATHERED:
                _add_rows(all_)
    _add_rows(all_)
    return part, all_.keys, all_.counts


def _add_rows(held: Gathered) -> None:
    if held.open:
        held.keys, held.counts = added_up(np.concatenate([held.keys, *[k for k, _ in held.open]]), np.concatenate([held.counts, *[c for _, c in held.open]]))
        held.open, held.size = [], 0


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words, A-Z lowered, and its end, in a row; and each text's first (one more than texts)."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets)
    begin = first + np.arange(len(first))
    out = np.empty(begin[-1], np.uint64)
    last = begin[1:] - 1
    word = np.ones(len(out), bool)
    word[last] = False
    out[word], out[last] = hashes(data, starts, ends), END
    return out, begin


def after(numbers: np.ndarray, begin: np.ndarray, start: int) -> np.ndarray:
    """The number that stands before each token; a text's first has ``start``."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[begin[:-1]] = start
    return out


def by_part(part: np.ndarray, key: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and its rows in order of their keys."""
    if len(part):
        order = np.argsort(key)
        order = order[np.argsort(part[order].astype(np.uint16 if n_parts <= 1 << 16 else np.int64), kind="stable")]
        sorted_parts = part[order]
        edges = np.flatnonzero(sorted_parts[1:] != sorted_parts[:-1]) + 1
        yield from zip(sorted_parts[np.concatenate([[0], edges])].tolist(), np.split(order, edges))


@dataclass
class Level:
    """The grams of one length, by part."""

    hot: np.ndarray  # numbers of frequent contexts, in order
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # number of each part's first gram
    hot_kinds: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))  # of each: sum of counts, grams with count 1, 2, 3 or more
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))

    @property
    def size(self) -> int:
        return int(self.starts[-1])


@dataclass
class Model:
    """Where the arrays are, and the numbers that belong to no part."""

    folder: str
    bits: int
    sizes: np.ndarray  # distinct words of each part
    total: int  # training tokens
    order: int = 2
    levels: dict[int, Level] = field(default_factory=dict)  # by length of gram, from 2
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_weight: float = 1.0  # what discounting leaves to the uniform distribution

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.files = MappedArrays(self.folder)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def __setstate__(self, state):
        self.__dict__.update(state, files=MappedArrays(state["folder"]))

    @property
    def n_parts(self) -> int:
        return 1 << self.bits

    @property
    def vocabulary(self) -> int:
        return int(self.starts[-1])

    @property
    def pairs(self) -> int:
        return self.levels[2].size if 2 in self.levels else 0

    @property
    def word_bits(self) -> np.uint64:
        """Bits of a word's number, below the context's number in a key."""
        return np.uint64(self.vocabulary.bit_length())

    def part_of(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each of the sorted words over all parts, or -1."""
        out = np.full(len(words), -1, np.int64)
        full, edges = np.unique(self.part_of(words), return_index=True)
        for part, a, b in zip(full.tolist(), edges.tolist(), [*edges[1:].tolist(), len(words)]):
            if self.sizes[part]:
                held = self.files(f"words-{part}")["words"]
                at = np.minimum(np.searchsorted(held, words[a:b]), len(held) - 1)
                out[a:b] = np.where(held[at] == words[a:b], self.starts[part] + at, -1)
        return out

    def values(self, name: str, numbers: np.ndarray, part_of: np.ndarray) -> np.ndarray:
        """Counts of sorted words by their numbers; 0 where the number is -1."""
        out = np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers >= 0)
        full, edges = np.unique(part_of[known], return_index=True)
        for part, at in zip(full.tolist(), np.split(known, edges[1:])):
            out[at] = self.counts(f"{name}-{part}", numbers[at] - self.starts[part])
        return out

    def hot_at(self, k: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each context is a frequent one, and its place among them."""
        hot = self.levels[k].hot
        if not len(hot):
            return np.zeros(len(context), bool), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        return hot[at] == context, at

    def keys(self, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part and key of grams of known contexts and words."""
        key = context.astype(np.uint64) << self.word_bits | word.astype(np.uint64)
        return self.part_of(mix(np.where(self.hot_at(k, context)[0], key, context.astype(np.uint64)))), key

    def apart(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and words of keys."""
        return (keys >> self.word_bits).astype(np.int64), (keys & ((np.uint64(1) << self.word_bits) - np.uint64(1))).astype(np.int64)

    def grams(self, k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The number of each gram, or -1 (also where context or word is -1)."""
        level = self.levels[k]
        numbers = np.full(len(context), -1, np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        part, key = self.keys(k, context[known], word[known])
        for p, rows in by_part(part, key, self.n_parts):
            if level.starts[p + 1] == level.starts[p]:
                continue
            held, wanted = self.files(f"grams{k}-{p}")["keys"], key[rows]
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            hit = held[at] == wanted
            numbers[known[rows[hit]]] = level.starts[p] + at[hit]
        return numbers

    def counts(self, name: str, at: np.ndarray | None = None) -> np.ndarray:
        held = self.files(name)
        n = (held["counts"] if at is None else held["counts"][at]).astype(np.int64)
        large = np.flatnonzero(n == 255)
        if len(large):
            n[large] = held["many"][1][np.searchsorted(held["many"][0], large if at is None else at[large])]
        return n

    def tails(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """The number of the last k - 1 words of each of the sorted grams of k words."""
        numbers, back = np.unique(numbers, return_inverse=True)
        starts = self.levels[k].starts
        out = np.empty(len(numbers), np.int64)
        part_of = np.searchsorted(starts, numbers, "right") - 1
        for p in np.unique(part_of).tolist():
            a, b = np.searchsorted(part_of, [p, p + 1])
            at = numbers[a:b] - starts[p]
            out[a:b] = self.apart(self.files(f"grams2-{p}")["keys"][at])[1] if k == 2 else self.files(f"grams{k}-{p}")["tails"][at]
        return out[back]

    def save_contexts(self, k: int, part: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Write a part's final counts and contexts; returns the kinds of the frequent contexts.

        A context that is followed once needs no row: every context of the training texts is followed.
        Kinds are bytes too, and those of a context with a sum from 255 are apart.
        """
        context = self.apart(keys)[0]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        context = context[first]
        kinds = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts >= 3)], 1)
        hot, at = self.hot_at(k, context)
        kept = ~hot & (kinds[:, 0] > 1)
        many = np.flatnonzero(kinds[kept, 0] >= 255)
        save_arrays(self.folder, f"level{k}-{part}", counts_apart(counts) | {
            "contexts": context[kept], "kinds": np.minimum(kinds[kept], 255).astype(np.uint8), "large": many, "large_kinds": kinds[kept][many]})
        out = np.zeros((len(self.levels[k].hot), 4), np.int64)
        out[at[hot]] = kinds[hot]
        return out

    def looked_up(self, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of each gram, or -1, and its count; the sum of its context's counts, and the weight of the lower order (1 and 1 where it is -1).

        Grams are asked for in the order of their parts and keys, each once; a frequent context's are in many parts.
        """
        level = self.levels[k]
        numbers, counts = np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64)
        total, weight = np.ones(len(context)), np.ones(len(context))
        known = np.flatnonzero(context >= 0)
        # No gram ends in the number after all words, so that is what an unknown word goes by.
        part, key = self.keys(k, context[known], np.where(word[known] < 0, self.vocabulary, word[known]))
        for p, rows in by_part(part, key, self.n_parts):
            asked = key[rows]
            rows, new = known[rows], np.concatenate([[True], asked[1:] != asked[:-1]])
            back, asked = np.cumsum(new) - 1, asked[new]
            if level.starts[p + 1] > level.starts[p]:
                held = self.files(f"grams{k}-{p}")["keys"]
                at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
                hit = held[at] == asked
                number, n = np.full(len(asked), -1, np.int64), np.zeros(len(asked), np.int64)
                number[hit], n[hit] = level.starts[p] + at[hit], self.counts(f"level{k}-{p}", at[hit])
                numbers[rows], counts[rows] = number[back], n[back]
            owner = self.apart(asked)[0]
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            kinds = self.kinds(k, p, owner[first])
            left = kinds[:, 1:] @ level.discounts[1:] / kinds[:, 0]
            back = (np.cumsum(first) - 1)[back]
            total[rows], weight[rows] = kinds[back, 0], left[back]
        return numbers, counts, total, weight

    def kinds(self, k: int, part: int, context: np.ndarray) -> np.ndarray:
        """Sum of counts and kinds of different contexts, in order, whose grams are in a part."""
        kinds = np.tile(np.array([1.0, 1.0, 0.0, 0.0]), (len(context), 1))
        hot, at = self.hot_at(k, context)
        kinds[hot] = self.levels[k].hot_kinds[at[hot]]
        other = np.flatnonzero(~hot)
        if len(other) and self.levels[k].starts[part + 1] > self.levels[k].starts[part]:
            file, wanted = self.files(f"level{k}-{part}"), context[other]
            held = file["contexts"]
            if len(held):
                i = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                hit = held[i] == wanted
                i = i[hit]
                found = file["kinds"][i].astype(np.float64)
                large = np.flatnonzero(found[:, 0] == 255)
                found[large] = file["large_kinds"][np.searchsorted(file["large"], i[large])]
                kinds[other[hit]] = found
        return kinds


def counts_apart(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, and those from 255 apart: their places and counts."""
    many = np.flatnonzero(counts >= 255)
    return {"counts": np.minimum(counts, 255).astype(np.uint8), "many": np.stack([many, counts[many]]).astype(np.int64)}


def text_per_part(size: int) -> int:
    """Bytes of text per part: small ones as long as there are few. Parts exchange rows with each other, and each look-up opens all of them."""
    return max(PART_BYTES, min(LARGE_PART_BYTES, size // FEW_PARTS))


def discounts(n: np.ndarray) -> np.ndarray:
    """Chen and Goodman's discounts for counts 0, 1, 2, and 3 or more, from the numbers of counts 1 to 4.

    Where a number is 0, as in tiny corpora, 0.5, 1 and 1.5 stand in.
    """
    if (n[:4] <= 0).any():
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2.0 * n[1])
    found = np.array([0.0] + [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return np.clip(found, 0.0, [0.0, 1.0, 2.0, 3.0])


def times(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3, 4, and how many are 3 or more."""
    return np.array([(counts == 1).sum(), (counts == 2).sum(), (counts == 3).sum(), (counts == 4).sum(), (counts >= 3).sum()], np.int64)


def _exchanged(df: DataFrame, n_parts: int) -> DataFrame:
    return df.repartitionById(n_parts, F.col("part"))


INFO = ", level int, size bigint, many array<bigint>, times array<bigint>, hot array<bigint>"
INFO_NAMES = ["part", "keys", "counts", "level", "size", "many", "times", "hot"]


def _info_row(part: int, level: int, size: int, many: np.ndarray | None = None,
              times_: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([level], pa.int32()), pa.array([size], pa.int64()),
         *[pa.array([None if x is None else x.ravel().tolist()], pa.list_(pa.int64())) for x in (many, times_, hot)]], names=INFO_NAMES)


def _with_info(made: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, pa.int32()), pa.nulls(made.num_rows, pa.int64()),
                                       *[pa.nulls(made.num_rows, pa.list_(pa.int64())) for _ in range(3)]], names=INFO_NAMES)


def _without_info(batches: Iterator[pa.RecordBatch], infos: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that hold keys; the others are put into ``infos``."""
    for batch in batches:
        infos.append(batch.filter(batch.column(1).is_null()))
        yield batch.filter(batch.column(1).is_valid())


def _times(infos: DataFrame) -> np.ndarray:
    return np.array(infos.select(*[F.coalesce(F.sum(F.col("times")[k]), F.lit(0)) for k in range(5)]).first(), np.int64)


def _settle(infos: DataFrame, level: Level) -> None:
    """Set the discounts and frequent contexts of a level from the rows of its parts."""
    hot = np.zeros(4 * len(level.hot))
    for r in infos.select(F.posexplode("hot").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        hot[r.at] = r.n
    level.hot_kinds, level.discounts = hot.reshape(-1, 4), discounts(_times(infos))


def train(texts: DataFrame, text: str = "text", order: int = 2, part_bytes: int | None = None) -> Model:
    """Count the texts and write the model's arrays; whole texts, all words, no cut-off.

    ``order`` is the number of words of the longest grams. There is a part per ``part_bytes`` of text (8 MB, up to 32 MB
    of a large corpus, if nothing is said), and one task adds it up. A null or empty text is an end
    alone. Without texts every word is unknown. A context's number and a word's number must
    fit into 64 bits together; if they do not, training fails.
    """
    if order < 2:
        raise ValueError(f"the order of the model must be at least 2, not {order}")
    spark = texts.sparkSession
    folder = shared_files(spark, "model")
    texts = texts.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, int(np.ceil(np.log2(max(size, 1) / (part_bytes or text_per_part(size))))) if size else 2)
    n_parts = 1 << bits

    def count_words(batches):
        held = Gathered()
        for batch in slices(batches, "text"):
            held.add(tokens(batch.column(0))[0])
            if len(held.keys) >= GATHERED:
                yield from held.by_range(bits)
                held = Gathered()
        yield from held.by_range(bits)

    def save_words(batches):
        part, words, counts = merged(batches)
        if part is None:
            return
        save_arrays(folder, f"words-{part}", {"words": words} | counts_apart(counts))
        many = np.argsort(-counts, kind="stable")[:16]  # a part holds eight frequent words on average
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [len(words)], "total": [int(counts.sum())],
                                          "many": pa.array([many.tolist()], pa.list_(pa.int64())),
                                          "counts": pa.array([counts[many].tolist()], pa.list_(pa.int64()))})

    rows = mapped(_exchanged(mapped(texts, count_words, PACKED), n_parts), save_words,
                  "part int, n bigint, total bigint, many array<bigint>, counts array<bigint>").collect()  # a row per part
    sizes = np.zeros(n_parts, np.int64)
    for r in rows:
        sizes[r.part] = r.n
    model = Model(folder, bits, sizes, sum(r.total for r in rows), order)
    if not rows:
        return model
    least_hot = model.total // (8 * n_parts)
    hot = [model.vocabulary]  # the start goes by the number after all words
    for r in rows:
        hot += [int(model.starts[r.part]) + w for w, n in zip(r.many, r.counts) if n > least_hot]
    empty = [bytearray(packed(np.empty(0, np.uint64))), bytearray(packed_counts(np.empty(0, np.int64)))]
    for k in range(2, order + 1):
        n_contexts = model.levels[k - 1].size if k > 2 else model.vocabulary + 1
        if n_contexts.bit_length() + int(model.word_bits) > 64:
            raise ValueError(f"{n_contexts} contexts and {model.vocabulary} words do not fit into 64 bits")
        model.levels[k] = Level(np.array(sorted(hot), np.int64))
        made = mapped(_exchanged(mapped(texts, _count_grams(model, k), PACKED), n_parts), _save_grams(model, k, least_hot), PACKED + INFO)
        if k > 2:  # parts that hold starts of texts alone get no suffixes
            every = [(p, *empty) for p in np.flatnonzero(np.diff(model.levels[k - 1].starts)).tolist()]
            made = made.unionByName(spark.createDataFrame(every, PACKED), allowMissingColumns=True)
        infos = stored(mapped(_exchanged(made, n_parts), _save_lower(model, k - 1), PACKED + INFO), "grams")
        in_part, hot = np.zeros(n_parts, np.int64), []
        sized = infos.where(F.col("level") == k).select("part", "size", "many").collect()
        for r in sized:
            in_part[r.part] = r.size
        model.levels[k].starts = np.concatenate([[0], np.cumsum(in_part)])
        for r in sized:
            hot += [int(model.levels[k].starts[r.part]) + i for i in r.many]
        if k == 2:
            word_times = _times(infos.where("level = 1"))
        else:
            _settle(infos.where(F.col("level") == k - 1), model.levels[k - 1])
            for p in np.flatnonzero(np.diff(model.levels[k - 1].starts)).tolist():  # their counts are final now
                os.remove(f"{folder}/raw{k - 1}-{p}.arrays")
        if k == order:
            _settle(infos.where(F.col("level") == k), model.levels[k])
    model.word_discounts = discounts(word_times)
    model.word_weight = float(word_times[[0, 1, 4]] @ model.word_discounts[1:] / model.pairs)
    return model


def _count_grams(model: Model, k: int):
    """Count the grams of k words of texts, by part: the part does not fit into the key, so each is added up on its own."""
    def count(batches):
        parts: dict[int, list] = {}

        def flush():
            done = [(p, *added_up(np.concatenate(found))) for p, found in parts.items()]
            parts.clear()
            if done:
                yield packed_rows([p for p, _, _ in done], [x for _, x, _ in done], [n for _, _, n in done])

        size = 0
        for batch in joined(batches, "text", LOOKED_UP_BYTES):
            found, begin = tokens(batch.column(0))
            known, at = np.unique(found, return_inverse=True)
            word = model.numbers(known)[at]
            context = after(word, begin, model.vocabulary)
            for lower in range(2, k):
                context = after(model.grams(lower, context, word), begin, -1)
            whole = context >= 0  # a text's first words have fewer before them
            part, key = model.keys(k, context[whole], word[whole])
            for p, rows in by_part(part, key, model.n_parts):
                parts.setdefault(p, []).append(key[rows])
            size += len(key)
            if size >= GATHERED:
                yield from flush()
                size = 0
        yield from flush()

    return count


def _save_grams(model: Model, k: int, least_hot: int):
    """Write the distinct grams of a part, and give out what is left of them without their first word."""
    def save(batches):
        part, keys, counts = merged(batches)
        if part is None:
            return
        context, word = model.apart(keys)
        held = {"keys": keys}
        if k == 2:
            seconds, n_before = added_up(word.astype(np.uint64))
            edges = np.searchsorted(seconds, model.starts.astype(np.uint64))
            given = [(p, seconds[edges[p]:edges[p + 1]], n_before[edges[p]:edges[p + 1]]) for p in np.flatnonzero(np.diff(edges)).tolist()]
        else:
            tail = model.tails(k - 1, context)
            suffix_part, suffix = model.keys(k - 1, tail, word)
            given = [(p, *added_up(suffix[rows])) for p, rows in by_part(suffix_part, suffix, model.n_parts)]
            if k < model.order:
                held["tails"] = model.grams(k - 1, tail, word)
        save_arrays(model.folder, f"grams{k}-{part}", held)
        for some in range(0, len(given), 256):
            yield _with_info(packed_rows(*map(list, zip(*given[some:some + 256]))))
        many = np.flatnonzero(counts > least_hot)
        if k == model.order:
            yield _info_row(part, k, len(keys), many, times(counts), model.save_contexts(k, part, keys, counts))
        else:
            save_arrays(model.folder, f"raw{k}-{part}", counts_apart(counts))
            yield _info_row(part, k, len(keys), many)

    return save


def _save_lower(model: Model, k: int):
    """Write the number of different words before each word or gram of a part as its count; pass on what the grams' parts say."""
    def save(batches):
        infos: list[pa.RecordBatch] = []
        part, suffix, n_before = merged(_without_info(batches, infos))
        yield from infos
        if part is None:
            return
        if k == 1:
            counts = np.zeros(model.sizes[part], np.int64)
            counts[suffix.astype(np.int64) - model.starts[part]] = n_before
            save_arrays(model.folder, f"before-{part}", counts_apart(counts))
            yield _info_row(part, k, len(counts), times_=times(counts))
        else:
            keys = model.files(f"grams{k}-{part}")["keys"]
            counts = model.counts(f"raw{k}-{part}")  # a gram at the start of a text has none before it and keeps these
            counts[np.searchsorted(keys, suffix)] = n_before
            yield _info_row(part, k, len(keys), times_=times(counts), hot=model.save_contexts(k, part, keys, counts))

    return save


class Scorer:
    def __init__(self, model: Model):
        self.m = model

    def word_probabilities(self, n_before: np.ndarray) -> np.ndarray:
        """By the number of different words before a word (0 for an unknown one)."""
        m = self.m
        uniform = m.word_weight / (m.vocabulary + 1)
        return np.maximum(n_before - m.word_discounts[np.minimum(n_before, 3)], 0) / max(m.pairs, 1) + uniform

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        m = self.m
        found, begin = tokens(column)
        known, at = np.unique(found, return_inverse=True)
        number, part_of = m.numbers(known), m.part_of(known)
        count = m.values("words", number, part_of)
        probability = self.word_probabilities(m.values("before", number, part_of))[at]
        word = number[at]
        context = after(word, begin, m.vocabulary)
        for k, level in m.levels.items():
            gram, n, total, weight = m.looked_up(k, context, word)
            probability = np.maximum(n - level.discounts[np.minimum(n, 3)], 0) / total + weight * probability
            context = after(gram, begin, -1)
        base = np.log10((count[at] + 1.0) / (m.total + 1.0 * (m.vocabulary + 1)))
        return {"n_tokens": np.diff(begin), "n_known": np.add.reduceat((count > 0)[at].astype(np.int64), begin[:-1]),
                "base_score": np.add.reduceat(base, begin[:-1]), "score": np.add.reduceat(np.log10(probability), begin[:-1])}


_held: dict = {}
RESULTS = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}


def with_scores(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with tokens, known tokens, add-one word score and model score (log10) of each whole text.

    A null or empty text is an end alone. Columns of the same names are replaced. The
    perplexity of a text is 10 to the power of -score / n_tokens.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    folder = model.folder
    out = docs.drop(*RESULTS).select("*", *[F.lit(0).cast(t).alias(c) for c, t in RESULTS.items()])

    def score(batches):
        if _held.get("folder") != folder:
            _held.update(folder=folder, scorer=Scorer(held.value))
        for batch in joined(batches, text, SCORED_BYTES):
            made = _held["scorer"].score(batch.column(text))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(k)
                                              for k, f in enumerate(batch.schema)], names=batch.schema.names)

    return mapped(out, score, out.schema)


def held_out(key: str) -> Column:
    """Whether a document is kept from training: CRC-32 of its key as text, modulo 7, is 2. A null key is text of no length."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2
