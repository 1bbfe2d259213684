"""Removal of repeated strings by a distributed merge sort of suffixes.

Every window of ``WINDOW`` bytes has an anchor: of the ``HEAD``-byte strings within it, the
first of those with the least hash. Equal windows have equal anchors at equal places, so it
is enough to sort the suffixes that start at anchors, about one byte in fourteen, and of
those only the ones whose head occurs in two documents.

1. Heads are counted; ranges of hashes are added up by one task each, which writes the
   repeated ones as a sorted array to the shared folder.
2. Each task sorts the suffixes at repeated anchors, keeps one of those with equal context
   (with the least document), and sends runs in which every suffix is coded by its common
   prefix with the one before. A range's runs are merged eight bytes at a time: what differs
   is in order, and only what agreed so far goes on to the next eight bytes, so no prefix is
   compared twice. The common prefixes of the merged order, with the bytes before the anchors,
   tell which windows are equal, and the least document of each goes into sorted arrays.
3. Each text is read once more, and its own contexts are looked up there.

Texts are never shuffled, nor are the places where windows occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import MappedArrays, joined, mapped, mix, raw, save_arrays, shared_files, slices
from stylograin.llm.kneser_ney import GATHERED, PACKED, Gathered, merged, packed_counts, unpacked_counts
from stylograin.llm.wordhash import BASE, INVERSE, powers

WINDOW = 50
HEAD = 24
REACH = WINDOW - HEAD  # the most bytes of a window before its anchor
CHUNK = 1 << 17  # what is worked out of a chunk fits into a processor's cache
PART_BYTES = 8 << 20
FEW_PARTS = 256
LARGE_PART_BYTES = 32 << 20
LOOKED_UP_BYTES = 4 << 20
HELD = 1 << 18
BLOCK = 1 << 16


def chunk_edges(offsets: np.ndarray) -> list[int]:
    """Edges of runs of texts of ``CHUNK`` bytes at most; a longer text is cut at multiples of ``CHUNK`` from its own start.

    What is found in a text must not depend on the texts beside it: an edge changes the windows of the anchors around it.
    """
    edges, text = [0], 0
    while text < len(offsets) - 1:
        begin = int(offsets[text])
        to = int(np.searchsorted(offsets, begin + CHUNK, "right")) - 1
        if to <= text:
            to = text + 1
            edges.extend(range(begin + CHUNK, int(offsets[to]), CHUNK))
        edges.append(int(offsets[to]))
        text = to
    return edges


class Anchors:
    """The anchors of the windows of some texts that lie joined in ``data``.

    Per anchor: ``text``, ``at`` (its first byte in ``data``), ``low`` and ``high`` (the least
    and most bytes that its windows have before it), ``head`` (hash of the head), and
    ``context`` (hash of all bytes of its windows, and of low and high).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        edges = chunk_edges(offsets)
        found = [self._chunk(data, offsets, a, b) for a, b in zip(edges[:-1], edges[1:])]
        names = ("text", "at", "low", "high", "head", "context")
        for k, name in enumerate(names):
            kind = np.uint64 if name in ("head", "context") else np.int64
            setattr(self, name, np.concatenate([f[k] for f in found]) if found else np.empty(0, kind))

    @staticmethod
    def _chunk(data, offsets, begin, end):
        """Anchors of the windows that start in [begin, end)."""
        data = data[begin:min(end + WINDOW - 1, len(data))]
        n = len(data) - WINDOW + 1
        empty = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
        if n <= 0:
            return empty
        sums = np.zeros(len(data) + 1, np.uint64)
        steps = data.astype(np.uint64)
        steps += np.uint64(1)
        steps *= powers(BASE, len(data))[:len(data)]
        np.cumsum(steps, out=sums[1:])
        back = powers(INVERSE, len(data) + 1)
        heads = sums[HEAD:] - sums[:-HEAD]
        heads *= back[:len(data) + 1 - HEAD]
        order = heads * np.uint64(0xD6E8FEB86659FD93)
        order &= np.uint64(0xFFFFFFFF00000000)
        order |= np.arange(len(order), dtype=np.uint64)
        least, width = order, 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = REACH + 1 - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        least = least[:n]  # equal where the anchor is: its place is part of it
        # The windows from the last bytes of a text are not whole, so whole windows of two texts are never side by side.
        ends = offsets[np.searchsorted(offsets, begin, "right"):np.searchsorted(offsets, begin + len(data), "right")] - begin
        whole = np.ones(n + 2, bool)
        whole[[0, -1]] = False
        whole[1:][np.clip(ends[:, None] - np.arange(1, WINDOW), 0, n).ravel()] = False
        changes = np.ones(n + 1, bool)
        np.not_equal(least[1:], least[:-1], out=changes[1:-1])
        first = np.flatnonzero(whole[1:-1] & (changes[:-1] | ~whole[:-2]))
        last = np.flatnonzero(whole[1:-1] & (changes[1:] | ~whole[2:]))
        if not len(first):
            return empty
        at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.searchsorted(offsets, begin + first, "right") - 1
        high, low = at - first, at - last
        a, b = at - high, at - low + WINDOW
        context = mix((sums[b] - sums[a]) * back[a] + mix((low * 64 + high).astype(np.uint64)))
        return text, at + begin, low, high, mix(heads[at]), context


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on ``known`` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def padded_words(text: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit integers in the same order."""
    padded = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    padded[:, :text.shape[1]] = text
    return padded.view(">u8").astype(np.uint64)


def merged_order(text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted runs of padded strings that lie one after the other, and each string's common prefix with the one before.

    Eight bytes are sorted at a time, by a merge sort that takes the runs as they are. Strings
    that differ there from both neighbours are in their place; the others are known to agree so far.
    """
    order, words = np.arange(len(text)), padded_words(text)
    prefix = np.zeros(len(text), np.int64)
    open_, group = np.arange(len(text)), np.zeros(len(text), np.int64)  # places that are not settled, and their ties
    for k in range(words.shape[1] + 1):
        mine = order[open_]
        word = words[mine, k] if k < words.shape[1] else length[mine].astype(np.uint64)
        by = np.lexsort([word, group]) if k else np.argsort(word, kind="stable")
        order[open_], word = mine[by], word[by]
        tied = np.zeros(len(open_), bool)
        tied[1:] = group[1:] == group[:-1]
        same = tied.copy()
        same[1:] &= word[1:] == word[:-1]
        parted = np.flatnonzero(tied & ~same)
        if k < words.shape[1]:
            prefix[open_[parted]] = 8 * k + leading_zeros(word[parted] ^ word[parted - 1]) // 8
            prefix[open_[same]] = 8 * (k + 1)
        goes_on = same.copy()
        goes_on[:-1] |= same[1:]
        open_, group = open_[goes_on], np.cumsum(~same)[goes_on]
        if not len(open_):
            break
    n = length[order]
    prefix[1:] = np.minimum(prefix[1:], np.minimum(n[1:], n[:-1]))
    return order, prefix


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of 64-bit integers that are not zero, to whole bytes."""
    out, x = np.zeros(len(x), np.int64), x.copy()
    for bits in (32, 16, 8):
        small = x < np.uint64(1) << np.uint64(64 - bits)
        out[small] += bits
        x[small] <<= np.uint64(bits)
    return out


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs, given as strings and their common prefixes with the string before in the run.

    Returns the run that each string of the merged order comes from, and its common prefix
    with the string before it there. Of equal strings the one of the earlier run is first.
    """
    lengths = np.array([len(s) for strings, _ in runs for s in strings], np.int64)
    rests = b"".join(s[n:] for strings, prefixes in runs for s, n in zip(strings, prefixes))
    text = unfolded(np.frombuffer(rests, np.uint8), np.array([n for _, prefixes in runs for n in prefixes], np.int64), lengths, int(lengths.max(initial=0)))
    order, prefix = merged_order(text, lengths)
    return np.repeat(np.arange(len(runs)), [len(strings) for strings, _ in runs])[order], prefix


def unfolded(rests: np.ndarray, prefix: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes, filled up with zeros, from what each string adds to its common prefix with the one before."""
    columns = np.arange(width)
    text = np.zeros((len(prefix), width), np.uint8)
    text[(columns >= prefix[:, None]) & (columns < length[:, None])] = rests
    out, place = np.ascontiguousarray(text.T), np.arange(len(prefix))
    for k in range(width):
        out[k] = out[k][np.maximum.accumulate(np.where(prefix <= k, place, 0))]
    return np.where(columns < length[:, None], out.T, 0).astype(np.uint8, copy=False)


RUN = "part int, prefixes binary, rests binary, lengths binary, lefts binary, lows binary, highs binary, contexts binary, least binary, most binary"
RUN_NAMES = [c.split()[0] for c in RUN.split(", ")]


def matrix(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes from ``begin``, filled up with zeros after ``length``."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[begin]
    rows[np.arange(width) >= length[:, None]] = 0
    return rows


def bytes_before(data: np.ndarray, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of the ``REACH`` bytes before ``at``, of which the last ``high`` are kept and the others are zeros."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(REACH, np.uint8), data]), REACH)[at]
    rows[np.arange(REACH) < REACH - high[:, None]] = 0
    return rows


def order_of(right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The order of padded strings; of equal bytes the shorter string first."""
    words = padded_words(right)
    return np.lexsort([length, *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)]])


def run_rows(parts: np.ndarray, right: np.ndarray, length: np.ndarray, left: np.ndarray, low, high, context, least, most) -> pa.RecordBatch:
    """One front-coded run per part."""
    rows = {n: [] for n in RUN_NAMES}
    order = np.argsort(parts, kind="stable")
    full, edges = np.unique(parts[order], return_index=True)
    for part, mine in zip(full.tolist(), np.split(order, edges[1:])):
        mine = mine[order_of(right[mine], length[mine])]
        text, n = right[mine], length[mine]
        prefix = np.zeros(len(mine), np.int64)
        same = text[1:] == text[:-1]
        prefix[1:] = np.minimum(np.where(same.all(1), text.shape[1], np.argmin(same, 1)), np.minimum(n[1:], n[:-1]))
        columns = np.arange(text.shape[1])
        rests = text[(columns >= prefix[:, None]) & (columns < n[:, None])]
        lefts = left[mine][np.arange(REACH) >= REACH - high[mine][:, None]]
        rows["part"].append(part)
        for name, values in (("least", least[mine]), ("most", most[mine])):
            rows[name].append(packed_counts(values))
        for name, values in (("prefixes", prefix), ("lengths", n), ("lows", low[mine]), ("highs", high[mine])):  # up to WINDOW
            rows[name].append(_bytes(values.astype(np.uint8)))
        for name, values in (("rests", rests), ("lefts", lefts), ("contexts", context[mine])):
            rows[name].append(_bytes(values))
    return pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), *[pa.array(rows[n], pa.binary()) for n in RUN_NAMES[1:]]], names=RUN_NAMES)


def _bytes(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _values(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def least_documents(prefix, left, low, high, context, least, most):
    """From the merged order, what is known of windows that occur in different documents.

    Returns contexts (in order), with the range of bytes before the anchor that it is about
    and the least document: of all equal windows with so many bytes before the anchor.
    """
    found = []
    apart = np.flatnonzero(prefix < HEAD)  # equal windows have equal heads, so they are between two of these
    edges = np.unique(np.append(apart[np.searchsorted(apart, np.arange(0, len(prefix), BLOCK), "left").clip(max=max(len(apart) - 1, 0))], len(prefix))) if len(apart) else [0, len(prefix)]
    edges = [0, *[e for e in edges if e > 0]]
    for a, b in zip(edges[:-1], edges[1:]):
        found.append(_least_of_block(prefix[a:b], left[a:b], low[a:b], high[a:b], context[a:b], least[a:b], most[a:b]))
    context, start, end, document = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort([start, context])
    return context[order], start[order], end[order], document[order]


def _least_of_block(prefix, left, low, high, context, least, most):
    shared = np.zeros((len(prefix), REACH + 1), bool)
    document = np.zeros((len(prefix), REACH + 1), np.int64)
    hashed = np.zeros(len(prefix), np.uint64)
    for o in range(REACH + 1):
        if o:
            hashed = hashed * np.uint64(BASE) + left[:, REACH - o].astype(np.uint64) + np.uint64(1)
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows):
            equal_right = np.cumsum(prefix < WINDOW - o)
            key = mix(hashed[rows] + mix(equal_right[rows].astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(rows)))
            lowest, highest = np.minimum.reduceat(least[rows], first), np.maximum.reduceat(most[rows], first)
            shared[rows, o] = np.repeat(lowest < highest, size)
            document[rows, o] = np.repeat(lowest, size)
    goes_on = shared[:, 1:] & shared[:, :-1] & (document[:, 1:] == document[:, :-1])
    opens, closes = shared.copy(), shared.copy()
    opens[:, 1:] &= ~goes_on
    closes[:, :-1] &= ~goes_on
    row, start = np.nonzero(opens)
    end = np.nonzero(closes)[1]
    return context[row], start.astype(np.uint8), end.astype(np.uint8), document[row, start]


def merged_run(rows: list[dict]):
    """The runs of a part merged: columns of ``least_documents``."""
    def all_of(name: str, values) -> np.ndarray:
        return np.concatenate([values(row[name]) for row in rows])

    def small(x: bytes) -> np.ndarray:
        return _values(x, np.uint8)

    prefix, length, low, high = (all_of(name, small).astype(np.int64) for name in ("prefixes", "lengths", "lows", "highs"))
    # A run's first string has no prefix, so the runs unfold one after the other.
    text = unfolded(all_of("rests", small), prefix, length, WINDOW)
    left = np.zeros((len(high), REACH), np.uint8)
    left[np.arange(REACH) >= REACH - high[:, None]] = all_of("lefts", small)
    order, prefix = merged_order(text, length)
    columns = (left, low, high, all_of("contexts", lambda x: _values(x, np.uint64)),
               all_of("least", unpacked_counts), all_of("most", unpacked_counts))
    return prefix, *[c[order] for c in columns]


def _first_bits(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2, int(np.ceil(np.log2(max(size, 1) / part_bytes(size)))))


def part_bytes(size: int) -> int:
    """Bytes of text per part: small ones as long as there are few. Each task sends a run to each part and opens each part's files."""
    return max(PART_BYTES, min(LARGE_PART_BYTES, size // FEW_PARTS))


class _Arrays:
    def __init__(self, folder: str, bits: int):
        self.bits, self.files = bits, MappedArrays(folder)

    def get(self, name: str) -> dict[str, np.ndarray] | None:
        try:
            return self.files(name)
        except FileNotFoundError:  # nothing fell there
            return None

    def part_of(self, heads: np.ndarray) -> np.ndarray:
        return (heads >> np.uint64(64 - self.bits)).astype(np.int64)

    def repeated(self, heads: np.ndarray) -> np.ndarray:
        known, at = np.unique(heads, return_inverse=True)
        out = np.zeros(len(known), bool)
        full, edges = np.unique(self.part_of(known), return_index=True)
        for part, a, b in zip(full.tolist(), edges.tolist(), [*edges[1:].tolist(), len(known)]):
            file = self.get(f"heads-{part}")
            if file is not None and len(file["values"]):
                held = file["values"]
                place = np.minimum(np.searchsorted(held, known[a:b]), len(held) - 1)
                out[a:b] = held[place] == known[a:b]
        return out[at]

    def shared_windows(self, heads: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ranges of bytes before the anchor, and documents of what is known of the contexts."""
        order = np.lexsort([contexts, self.part_of(heads)])
        part_of, wanted = self.part_of(heads)[order], contexts[order]
        full, edges = np.unique(part_of, return_index=True)
        found = []
        for part, a, b in zip(full.tolist(), edges.tolist(), [*edges[1:].tolist(), len(order)]):
            held = self.get(f"windows-{part}")
            if held is not None and len(held["contexts"]):
                begin, end = np.searchsorted(held["contexts"], wanted[a:b], "left"), np.searchsorted(held["contexts"], wanted[a:b], "right")
                n = end - begin
                place = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append((np.repeat(order[a:b], n), *[held[x][place] for x in ("from", "to", "documents")]))
        if not found:
            return (np.empty(0, np.int64),) * 4
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the spans cover; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


_held: dict = {}


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``removed`` (byte spans, end exclusive, in order and apart) and ``kept`` (the other bytes).

    Removed is every byte that is covered by a string of ``WINDOW`` bytes which also starts
    in a document with a smaller key; strings lie within a document, may overlap, and are
    judged on the input. Keys must be integers. Documents with a null key lose nothing and
    take nothing from others; rows that share a key take nothing from each other; null
    texts are empty. A cut may fall within a character, so ``kept`` is binary. Columns
    called like the two results are replaced.

    Heads, contexts and the bytes before an anchor are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    folder = shared_files(spark, "suffixes")
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bits = _first_bits(texts)
    n_parts = 1 << bits

    def count_heads(batches):
        held = Gathered()
        for batch in slices(batches, "text"):
            found = Anchors(*raw(batch.column("text")))
            order = np.lexsort([found.head, found.text])
            head, row = found.head[order], found.text[order]
            new = np.ones(len(head), bool)
            new[1:] = (head[1:] != head[:-1]) | (row[1:] != row[:-1])
            held.add(head[new])
            if len(held.keys) >= GATHERED:
                yield from held.by_range(bits, 2)
                held = Gathered()
        yield from held.by_range(bits, 2)

    def save_heads(batches):
        part, heads, counts = merged(batches)
        if part is not None:
            save_arrays(folder, f"heads-{part}", {"values": heads[counts > 1]})
            yield pa.RecordBatch.from_pydict({"n": [int((counts > 1).sum())]})

    mapped(mapped(texts, count_heads, PACKED).repartitionById(n_parts, F.col("part")), save_heads, "n bigint").agg(F.sum("n")).collect()

    def sorted_runs(batches):
        arrays, held, size = _arrays(folder, bits), [], 0
        for batch in joined(batches, "text", LOOKED_UP_BYTES):
            data, offsets = raw(batch.column("text"))
            found = Anchors(data, offsets)
            on = np.flatnonzero(arrays.repeated(found.head))
            if not len(on):
                continue
            at, low, high = found.at[on], found.low[on], found.high[on]
            right = matrix(data, at, WINDOW - low, WINDOW)
            left = bytes_before(data, at, high)
            doc = batch.column("key").to_numpy()[found.text[on]]
            held.append((arrays.part_of(found.head[on]), right, (WINDOW - low).astype(np.uint8), left, low.astype(np.uint8), high.astype(np.uint8), found.context[on], doc))
            size += len(on)
            if size >= HELD:
                yield run_rows(*distinct(held))
                held, size = [], 0
        if held:
            yield run_rows(*distinct(held))

    def distinct(held):
        """One row per context, with its least and greatest document."""
        columns = [list(x) for x in zip(*held)]
        held.clear()
        context, doc = np.concatenate(columns[6]), np.concatenate(columns[7])
        order = np.lexsort([doc, context])
        first = np.flatnonzero(np.concatenate([[True], context[order][1:] != context[order][:-1]]))
        last = np.append(first[1:], len(order)) - 1
        return *[np.concatenate(columns.pop(0))[order[first]] for _ in range(8)], doc[order[last]]

    def merge(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            part = rows[0]["part"]
            context, start, end, document = least_documents(*merged_run(rows))
            save_arrays(folder, f"windows-{part}", {"contexts": context, "from": start, "to": end, "documents": document})
            yield pa.RecordBatch.from_pydict({"n": [len(context)]})

    mapped(mapped(texts, sorted_runs, RUN).repartitionById(n_parts, F.col("part")), merge, "n bigint").agg(F.sum("n")).collect()

    results = ["removed", "kept"]
    out = docs.drop(*results).select("*", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.lit(None).cast("binary").alias("kept"))
    span_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches):
        arrays = _arrays(folder, bits)
        for batch in joined(batches, text, LOOKED_UP_BYTES):
            data, offsets = raw(batch.column(text))
            keys = batch.column(key)
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            own = keys.fill_null(0).cast(pa.int64()).to_numpy()
            found = Anchors(data, offsets)
            on = np.flatnonzero(arrays.repeated(found.head))
            row, start, end, document = arrays.shared_windows(found.head[on], found.context[on])
            row = on[row]
            smaller = known[found.text[row]] & (document < own[found.text[row]])
            row, start, end = row[smaller], start[smaller], end[smaller]
            in_text, begin = found.text[row], found.at[row] - end
            stop = found.at[row] - start + WINDOW
            edges = np.searchsorted(in_text[np.argsort(in_text, kind="stable")], np.arange(batch.num_rows + 1))
            order = np.argsort(in_text, kind="stable")
            spans, kept = [], []
            body = data.tobytes()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                mine = order[edges[i]:edges[i + 1]]
                if not len(mine):
                    spans.append([])
                    kept.append(body[a:b])
                    continue
                starts, ends = joined_spans(begin[mine], stop[mine])
                spans.append([{"start": s - a, "end": e - a} for s, e in zip(starts.tolist(), ends.tolist())])
                kept.append(b"".join(body[s:e] for s, e in zip([a, *ends.tolist()], [*starts.tolist(), b])))
            made = {"removed": pa.array(spans, pa.list_(span_type)), "kept": pa.array(kept, pa.binary())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(k) for k, f in enumerate(batch.schema)],
                                             names=batch.schema.names)

    return mapped(out, cut, out.schema)


def _arrays(folder: str, bits: int) -> _Arrays:
    """The arrays of one run, held by the worker over its tasks."""
    if _held.get("folder") != folder:
        _held.update(folder=folder, arrays=_Arrays(folder, bits))
    return _held["arrays"]
