"""Spelling variants: words one edit apart, found by probing edits against blocked Bloom filters.

The vocabulary is filed in Bloom filters, one shard per word length, whose blocks are 256 bits
with one bit in each of eight lanes. Every task makes all deletions and replacements of its words
as hashes, in numpy, and probes the shard of the length that the edit would have. An insertion is
another word's deletion, and of two words that differ by a replacement only the one with the
smaller letter makes it, so each pair is found once. What the filters let through becomes
strings, and only these are shuffled, to an exact join with the vocabulary that removes the
false positives.

The filters of one pass hold ``most_bytes`` at most, which bounds the broadcast. A vocabulary that needs more
is cut by hash into slices, and each slice is a pass of its own over the words.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import mapped, mix, slices, stored
from stylograin.llm.wordhash import BASE, INVERSE, powers

#: Letters of a word: A-Z, a-z and U+00C0 to U+00FF, one byte each in Latin-1.
RUN = r"[A-Za-zÀ-ÿ]{%d,}"
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LANES = 8
BLOCK_BITS = 32 * LANES
WORD_BITS = 16
LONGEST = 255  # longer words share the last shard, so that there are few shards
PROBES = 1 << 20
#: Odd multipliers, one per lane, by a fixed rule.
SALTS = mix(np.arange(1, LANES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def vocabulary(docs: DataFrame, *, text: str = "text", least_length: int = 7, least_count: int = 2,
               altered: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct lower-cased runs of letters of at least ``least_length`` and how often each occurs: columns ``word`` and ``n``.

    ``altered`` may change a run before it is counted, and must not make it longer. Null
    and empty texts have no words.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN % least_length), 0))
    runs = docs.withColumn("_run", run).withColumn("_run", F.translate("_run", UPPER, LOWER))
    word = F.col("_run") if altered is None else altered(F.col("_run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def by_length(words: pa.Array):
    """Rows and letters (one row per word) of the words of each length."""
    encoded = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.array([len(w) for w in encoded])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join([encoded[r] for r in rows]), np.uint8).reshape(len(rows), size).astype(np.uint64)


def finished(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of words of one length from the sums of their letters' terms."""
    return mix(sums + np.uint64(size) * np.uint64(0xD6E8FEB86659FD93))


def bits(hashed: np.ndarray, lane: int) -> np.ndarray:
    return (hashed.astype(np.uint32) * SALTS[lane]) >> np.uint32(27)


class Shards:
    """Where each length's blocks begin, how many there are, and which slice of the hashes they hold."""

    def __init__(self, counts: dict[int, int], slice_no: int, n_slices: int):
        self.slice_no, self.n_slices, self.begin, self.size, at = slice_no, n_slices, {}, {}, 0
        for length in sorted(counts):
            self.begin[length], self.size[length] = at, -(-counts[length] * WORD_BITS // (BLOCK_BITS * n_slices))
            at += self.size[length]
        self.total = at

    def mine(self, hashed: np.ndarray) -> np.ndarray:
        return hashed % np.uint64(self.n_slices) == np.uint64(self.slice_no)

    def blocks(self, hashed: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, LONGEST)
        return self.begin[shard] + (((hashed >> np.uint64(32)) * np.uint64(self.size[shard])) >> np.uint64(32)).astype(np.int64)


def bloom_filter(words: DataFrame, shards: Shards) -> np.ndarray:
    """The blocks of the words in this slice. Bits of a block are joined in Spark; the driver gets one row per block."""
    names = [f"lane{k}" for k in range(LANES)]

    def place(batches):
        for batch in slices(batches, "word"):
            for _, letters in by_length(batch.column("word")):
                size = letters.shape[1]
                hashed = finished(((letters + np.uint64(1)) * powers(BASE, size)[:size]).sum(axis=1, dtype=np.uint64), size)
                hashed = hashed[shards.mine(hashed)]
                masks = [(np.uint32(1) << bits(hashed, k)).view(np.int32) for k in range(LANES)]
                yield pa.RecordBatch.from_arrays([pa.array(shards.blocks(hashed, size)), *map(pa.array, masks)], names=["block", *names])

    placed = mapped(words.select("word"), place, "block bigint, " + ", ".join(f"{n} int" for n in names))
    table = placed.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names]).toArrow()
    out = np.zeros((shards.total, LANES), np.uint32)
    for k, name in enumerate(names):
        out[table.column("block").to_numpy(), k] = table.column(name).to_numpy().view(np.uint32)
    return out


def probed(filled: np.ndarray, shards: Shards, hashed: np.ndarray, length: int) -> np.ndarray:
    """Indexes of the hashes that may be words of this length."""
    left = np.flatnonzero(shards.mine(hashed)) if shards.n_slices > 1 else np.arange(len(hashed))
    blocks = shards.blocks(hashed[left], length)
    for lane in range(LANES):
        hit = (filled[blocks, lane] >> bits(hashed[left], lane)) & np.uint32(1) > 0
        left, blocks = left[hit], blocks[hit]
    return left


def possible_edits(filled: np.ndarray, shards: Shards, letters: np.ndarray):
    """(word's row, place, letter) of each edit that passes the filters; letter 0 is a deletion."""
    n, size = letters.shape
    power = powers(BASE, size + 1)[:size]
    terms = (letters + np.uint64(1)) * power
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    if shards.size.get(min(size - 1, LONGEST)):
        new = np.ones((n, size), bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]  # any letter of a run gives the same deletion
        rows, places = np.nonzero(new)
        for at in range(0, len(rows), PROBES):
            r, p = rows[at:at + PROBES], places[at:at + PROBES]
            sums = upto[r, p] - terms[r, p] + (upto[r, -1] - upto[r, p]) * np.uint64(INVERSE)
            left = probed(filled, shards, finished(sums, size - 1), size - 1)
            yield r[left], p[left], np.zeros(len(left), np.uint64)
    step = max(1, PROBES // (n * len(LETTERS)))
    for at in range(0, size, step):
        part = letters[:, at:at + step]
        r, p, c = np.nonzero(LETTERS[None, None, :] > part[:, :, None])
        sums = upto[r, -1] + (LETTERS[c] - part[r, p]) * power[at + p]
        left = probed(filled, shards, finished(sums, size), size)
        yield r[left], at + p[left], LETTERS[c[left]]


def candidates(words: DataFrame, shards: Shards, filled) -> DataFrame:
    """(word, n, other) for each edit of a word that passes the filters."""
    def probe(batches):
        for batch in slices(batches, "word"):
            for rows, letters in by_length(batch.column("word")):
                held = batch.take(pa.array(rows))
                texts = held.column("word").to_pylist()
                for r, place, letter in possible_edits(filled.value, shards, letters):
                    others = [texts[i][:p] + (chr(c) if c else "") + texts[i][p + 1:] for i, p, c in zip(r.tolist(), place.tolist(), letter.tolist())]
                    yield pa.RecordBatch.from_arrays([*held.take(pa.array(r)).columns, pa.array(others, pa.string())], names=["word", "n", "other"])

    return mapped(words.select("word", "n"), probe, "word string, n bigint, other string")


def near_words(words: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """All pairs of ``words`` (word, n) that differ by one inserted, deleted or replaced letter, once: (word, n, other, other_n)."""
    shard = F.least(F.char_length("word"), F.lit(LONGEST))
    counts = {r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most LONGEST rows
    n_slices = max(1, -(-sum(counts.values()) * WORD_BITS // (8 * most_bytes)))
    found = None
    for k in range(n_slices):
        shards = Shards(counts, k, n_slices)
        filled = words.sparkSession.sparkContext.broadcast(bloom_filter(words, shards))
        passed = stored(candidates(words, shards, filled), "passed")
        filled.unpersist()
        found = passed if found is None else found.union(passed)
    return found.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")


def spelling_variants(words: DataFrame, *, ratio: int = 10, most_bytes: int = 32 << 20) -> DataFrame:
    """Per word: ``n``, ``n_near`` (words one edit away), ``form``, ``form_n`` and ``root``.

    ``words`` (word, n) are distinct words of the letters of ``RUN``, lower-cased, as ``vocabulary`` gives them. A word's form is the near
    word of largest ``n`` (of ties the first in code-point order) if it occurs at least ``ratio``
    times as often, else null; the root is where the forms end, the word itself if it has none. Each step
    multiplies ``n`` by ``ratio``, which bounds the steps and rules out circles. Of an empty
    vocabulary nothing comes back; very long words are probed in pieces.
    """
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often as the word")
    words = stored(words.select("word", "n"), "words")
    pairs = near_words(words, most_bytes)
    both = pairs.select("word", "n", "other", "other_n").union(pairs.select("other", "other_n", "word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("_n"), best)
    is_form = -F.col("best.minus") >= ratio * F.col("_n")
    near = stored(near.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"),
                              F.when(is_form, -F.col("best.minus")).alias("form_n")), "near")
    roots = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(max(0, math.ceil(math.log2(max(1.0, math.log(most, ratio)))))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
