"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' word sequences is built once per block of items and streamed
over each text. The state after a word stands for the longest run of words, ending there,
that occurs in some item. A run of ``window`` words or more is a hit; an item of fewer
words is a hit as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import mapped, stored

#: Lower-case A-Z; every ASCII byte that is neither letter nor digit parts words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """Suffix automaton over word numbers; matches never cross items.

    ``owners[s]`` lists the items that contain the ``window``-word run, or are the short
    item, that state ``s`` stands for. ``hit[s]`` is the state whose owners a match in
    ``s`` adds (itself or an ancestor by suffix link), or -1.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, self.number.setdefault(word, len(self.number)))
        owners: dict[int, set[int]] = {}
        for item_id, item in items:
            size = min(window, len(item))
            for end, (state, _) in enumerate(self._walk(item)):
                if size and end + 1 >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    owners.setdefault(state if size == window else -2 - state, set()).add(item_id)
        # A short item is hit only by its whole run; its state may hold longer runs' suffixes as well.
        self.owners = {s: tuple(x) for s, x in owners.items() if s >= 0}
        self.short = {-2 - s: tuple(x) for s, x in owners.items() if s < 0}
        self.short_size = {}
        for _, item in items:
            if 0 < len(item) < window:
                state = 0
                for word in item:
                    state = self.next[state][self.number[word]]
                self.short_size[state] = len(item)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _walk(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends with each word."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for c in map(self.number.get, text):
            if c is None:
                state = size = 0
            else:
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    size += 1
            yield state, size

    def matches(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (start, end) covered by windows, in order and apart, and the items that own them."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        window, link, length, numbers = self.window, self.link, self.length, self.number
        known = np.fromiter(map(numbers.__contains__, text), bool, len(text))
        least = min([window, *self.short_size.values()])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - begin < least:  # no window fits between two unknown words
                continue
            for i, (state, size) in enumerate(self._walk(text[begin:end]), begin + 1):
                if size < least:
                    continue
                reach = window if size >= window else 0
                if reach:
                    s = state
                    while length[link[s]] >= window:
                        s = link[s]
                    items.update(self.owners[s])
                if self.short_size:
                    s = state
                    while s > 0:
                        whole = self.short_size.get(s)
                        if whole and whole <= size:
                            items.update(self.short[s])
                            reach = max(reach, whole)
                        s = link[s]
                if reach:
                    if spans and spans[-1][1] >= i - reach:
                        first = i - reach
                        while spans and spans[-1][1] >= first:
                            first = min(first, spans.pop()[0])
                        spans.append((first, i))
                    else:
                        spans.append((i - reach, i))
        return spans, items


def item_blocks(benchmark: DataFrame, text: str, item_id: str, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The test items in blocks of at most ``block_words`` words (one long item is a block of its own)."""
    block, size = [], 0
    rows = benchmark.select(item_id, text).distinct().sort(item_id, text)
    for row in rows.toLocalIterator():
        item = words(row[1] and row[1].encode())
        if block and size + len(item) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    if block:
        yield block


RESULTS = ("n_words", "hit_spans", "hit_items")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id",
                   window: int = 10, block_words: int = 500_000) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (array of word spans, end exclusive) and ``hit_items`` (sorted array).

    The items are the query set: they are read in blocks of ``block_words`` words, and each
    block's automaton is broadcast and streamed over all texts, so that what a worker holds
    is bounded however many items there are. Beyond the first block the rows are kept in the
    shared folder between blocks. Rows stay where they are: there is no join or shuffle.

    Nulls and empty texts have no words and no hits; an item without words owns nothing;
    repeated rows are each judged; rows of the same item id add to the same item, those without an id
    to one item that is null in ``hit_items``, at the end; without items there are no hits. Columns called like the three results are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop(*RESULTS).select("*", F.lit(0).cast("long").alias("n_words"),
                                     F.array().cast("array<struct<start:bigint,end:bigint>>").alias("hit_spans"),
                                     F.array().cast("array<bigint>").alias("hit_items"))
    schema = out.schema
    blocks = item_blocks(benchmark, item_text, item_id, block_words)
    first = True
    for block in blocks:
        if not first:
            out = stored(out, "hits")
        out = _with_block(spark, out, block, text, window, schema)
        first = False
    return _with_block(spark, out, [], text, window, schema) if first else out


def _with_block(spark, rows: DataFrame, block, text: str, window: int, schema) -> DataFrame:
    held, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def search(batches):
        if _held.get("token") != token:  # one automaton per worker and block: a worker runs many tasks
            _held.update(token=token, automaton=Automaton(held.value, window))
        automaton = _held["automaton"]
        for batch in batches:
            counts, spans, items = [], [], []
            for value, old_spans, old_items in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("hit_spans").to_pylist(),
                                                   batch.column("hit_items").to_pylist()):
                found = words(value)
                new_spans, new_items = automaton.matches(found)
                counts.append(len(found))
                spans.append(_joined(new_spans + [(s["start"], s["end"]) for s in old_spans]))
                items.append(sorted(new_items.union(old_items), key=lambda i: (i is None, i or 0)))
            made = {"n_words": pa.array(counts, pa.int64()),
                    "hit_spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "hit_items": pa.array(items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(k)) for k, n in enumerate(batch.schema.names)],
                                             names=batch.schema.names)

    return mapped(rows, search, schema)


_held: dict = {}


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def word_offsets(text: bytes) -> np.ndarray:
    """Byte starts and ends of the words, as rows of a two-column array."""
    data = np.frombuffer(text.translate(NORMAL), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (data != 32).view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def without_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 10, max_coverage: float = 0.5, **names) -> DataFrame:
    """``docs`` without the passages that match a benchmark item, and without the documents they make up.

    A document of which more than ``max_coverage`` of the words are hit goes; from the others
    the hit spans are cut, from the first byte of the first word to the last byte of the last.
    The other columns come through as they are, also those called like a result of ``benchmark_hits``.
    """
    aside = {name: f"_{uuid.uuid4().hex}_{name}" for name in docs.columns if name in RESULTS and name != text}
    found = benchmark_hits(docs.withColumnsRenamed(aside), benchmark, text=text, window=window, **names)
    covered = F.coalesce(F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0))
    kept = found.where(covered <= F.lit(max_coverage) * F.col("n_words"))

    def cut(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            for i, hits in enumerate(batch.column("hit_spans").to_pylist()):
                if hits:
                    data, at = texts[i], word_offsets(texts[i])
                    parts, begin = [], 0
                    for hit in hits:
                        parts.append(data[begin:at[hit["start"], 0]])
                        begin = at[hit["end"] - 1, 1]
                    texts[i] = b"".join([*parts, data[begin:]])
            field = batch.schema.field(text)
            yield batch.set_column(batch.schema.get_field_index(text), field, pa.array(texts, pa.binary()).cast(field.type))

    return mapped(kept, cut, kept.schema).drop(*RESULTS).withColumnsRenamed({new: name for name, new in aside.items()}).select(docs.columns)
