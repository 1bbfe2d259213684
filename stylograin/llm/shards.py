"""Token ids in training order: fixed-stride binary shards that are read from the first slot to the last.

The corpus is one stream of tokens, text after text in order of key and each with an end
token, cut into sequences of equal length. A keyed Feistel network over the least even
number of bits, walked until it falls below the number of sequences, gives every sequence
its own slot. Ranges of slots are partitions, and each writes one shard: records of equal
stride, in order. Record ``s`` of the corpus is at a place that ``s`` alone gives, so a
reader resumes anywhere.
"""

from __future__ import annotations

import base64
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograin.llm.common import SortedArrays, mapped, mix, raw, saved_sorted, shared_files, slices, stored

#: Ends each record; as one 16-bit number it also shows a reader that it is in step.
END_OF_RECORD = "\r\n"
ROUNDS = 6
#: GPT-2's pattern, and its authors' later form of it, which finds the same pieces and tries fewer ways.
SAME_PIECES = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""",
}


class Order:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key & (1 << 64) - 1], np.uint64))[0])

    def _turn(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            if back:
                left, right = right ^ (mix(left + key) & self.mask), left
            else:
                left, right = right, left ^ (mix(right + key) & self.mask)
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, keys, back: bool) -> np.ndarray:
        x = self._turn(np.asarray(x).astype(np.uint64), keys, back)
        out = x >= np.uint64(self.n)
        while out.any():
            x[out] = self._turn(x[out], keys, back)
            out = x >= np.uint64(self.n)
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, self.keys, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


BLOCK = 1 << 16  # tokens looked up at a time
SLOT_BITS = 20
WORD = 8
#: By number of bytes: what keeps that many of a little-endian word.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(WORD + 1)], np.uint64)


def _hashes(words: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings that begin at ``at``; ``words`` has the 8 bytes from each byte on."""
    out = mix((words[at] & MASKS[np.minimum(lengths, WORD)]) + (lengths.astype(np.uint64) << np.uint64(56)))
    done, longer = WORD, np.flatnonzero(lengths > WORD)
    while len(longer):
        more = words[at[longer] + done] & MASKS[np.minimum(lengths[longer] - done, WORD)]
        out[longer] = mix(out[longer] + mix(more + np.uint64(done)))
        done += WORD
        longer = longer[lengths[longer] > done]
    return out


def _words(body: np.ndarray) -> np.ndarray:
    return np.ndarray((len(body),), "<u8", np.concatenate([body, np.zeros(WORD, np.uint8)]), strides=(1,))


class Tokens:
    """16-bit ids of texts under a file of byte-pair ranks; special tokens' strings are ordinary text.

    A text and the lengths of its tokens give its ids again, each token's bytes looked up on their own.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        end = max(ranks.values()) + 1
        # Encoding to arrays looks for special tokens, and needs one; none is allowed, so that its string is text.
        self.encoding = tiktoken.Encoding(uuid.uuid4().hex, pat_str=SAME_PIECES.get(pattern, pattern), mergeable_ranks=ranks,
                                          special_tokens={"<|endoftext|>": end})
        self.end = np.uint16(end).tobytes()
        self.codec = pa.Codec("zstd")
        ids = np.array(sorted(ranks.values(), reverse=True))
        lengths = np.zeros(end, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        self.lengths = lengths.astype(np.min_scalar_type(int(lengths.max())))
        by_id = {i: token for token, i in ranks.items()}
        stops = np.cumsum(lengths[ids])
        hashes = _hashes(_words(np.frombuffer(b"".join(by_id[i] for i in ids.tolist()), np.uint8)), stops - lengths[ids], lengths[ids])
        order = np.argsort(hashes)
        self.sorted, self.sorted_ids = hashes[order], ids[order].astype(np.uint16)
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two tokens share a hash")
        self.hash_of = np.zeros(end, np.uint64)
        self.hash_of[ids] = hashes
        self.slots = np.zeros(1 << SLOT_BITS, np.uint16)
        self.slots[hashes >> np.uint64(64 - SLOT_BITS)] = ids  # of tokens that share a slot the first id, the most frequent, is written last

    def counted(self, text: str | None) -> tuple[int, bytes]:
        """Tokens of the text and its end; and the tokens' lengths in bytes, compressed."""
        ids = self.encoding.encode_to_numpy(text or "", disallowed_special=())
        return len(ids) + 1, self.codec.compress(self.lengths[ids], asbytes=True) if len(ids) else b""

    def unpacked(self, packed: bytes, n: int) -> np.ndarray:
        """The lengths that ``counted`` gave with the count ``n``."""
        if not packed:
            return np.empty(0, self.lengths.dtype)
        return np.frombuffer(self.codec.decompress(packed, (n - 1) * self.lengths.itemsize, asbytes=True), self.lengths.dtype)

    def ids(self, body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of the tokens that follow each other in ``body``."""
        words, out, begin = _words(body), np.empty(len(lengths), np.uint16), 0
        for i in range(0, len(lengths), BLOCK):
            n = lengths[i:i + BLOCK].astype(np.int64)
            stops = begin + np.cumsum(n)
            hashes = _hashes(words, stops - n, n)
            begin = int(stops[-1])
            found = self.slots[hashes >> np.uint64(64 - SLOT_BITS)]
            other = np.flatnonzero(self.hash_of[found] != hashes)
            at = np.minimum(np.searchsorted(self.sorted, hashes[other]), len(self.sorted) - 1)
            if (self.sorted[at] != hashes[other]).any():
                raise ValueError("a text is not made of these tokens: the table changed while it was written")
            found[other] = self.sorted_ids[at]
            out[i:i + BLOCK] = found
        return out


SOME = 1000  # copies of a row that a task writes at a time
OPEN_NOTES = 64  # files of token lengths that a task holds open
_held: dict = {}


def _tokens(ranks_path: str, pattern: str) -> Tokens:
    if (ranks_path, pattern) not in _held:
        _held[ranks_path, pattern] = Tokens(ranks_path, pattern)
    return _held[ranks_path, pattern]


#: Where a text's token lengths are: the task that encoded it, and the place and size in that task's file.
NOTED = ["task", "at", "size"]


def layout(docs: DataFrame, notes: str, ranks_path: str, pattern: str, *, key: str, text: str) -> tuple[DataFrame, int]:
    """Each text's name (hash of key and text), key, token count, number of rows, first place in the stream and place in ``notes``; and the stream's length."""
    named = docs.select(F.xxhash64(key, text).alias("name"), F.col(key).alias("key"), F.col(text).alias("text"))

    def count(batches):
        tokens, task = _tokens(ranks_path, pattern), TaskContext.get().taskAttemptId()
        with open(f"{notes}/{task}", "wb") as out:
            for batch in slices(batches, "text"):
                n, at, size = [], [], []
                for value in batch.column("text").to_pylist():
                    tokens_of, packed = tokens.counted(value)
                    n.append(tokens_of)
                    at.append(out.tell())
                    size.append(out.write(packed))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, [task] * len(n), at, size))],
                                                 names=["name", "key", "n", *NOTED])

    key_type = docs.schema[key].dataType.simpleString()
    noted = ", ".join(f"{c} bigint" for c in NOTED)
    # The first values of all columns are those of one row.
    counted = (mapped(named, count, f"name bigint, key {key_type}, n bigint, {noted}").groupBy("key", "name")
               .agg(*(F.first(c).alias(c) for c in ["n", *NOTED]), F.count(F.lit(1)).alias("copies")))
    n_ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add_up(batches):
        total = 0
        for batch in batches:
            n = batch.column("n").to_numpy() * batch.column("copies").to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield batch.append_column("before", pa.array(before, pa.int64()))

    ranged = counted.repartitionByRange(n_ranges, "key", "name").sortWithinPartitions("key", "name")
    placed = stored(mapped(ranged.select("key", "name", "n", "copies", *NOTED), add_up, f"key {key_type}, name bigint, n bigint, copies bigint, {noted}, before bigint")
                    .withColumn("part", F.spark_partition_id()), "layout")
    totals = dict(placed.groupBy("part").agg(F.sum(F.col("n") * F.col("copies"))).collect())  # a row per partition
    starts, total = [], 0
    for part in range(max(totals, default=-1) + 1):
        starts.append(total)
        total += totals.get(part, 0)
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("part") + 1) if starts else F.lit(0)
    return placed.select("name", "key", "n", "copies", *NOTED, (F.col("before") + first).alias("start")), total


def write_shards(docs: DataFrame, folder: str, ranks_path: str, pattern: str, *, seed: int = 0, key: str = "doc_id", text: str = "text",
                 length: int = 2048, shard_records: int = 8192) -> dict:
    """Write the corpus as shards below ``folder``; returns what a reader must know.

    Ids are 16-bit, little-endian; special tokens' strings are ordinary text; the end token
    is the first free id, and fills up the last sequence. A null or empty text is an end
    token alone. Every row is written, also where rows repeat a key, or a key and a text, or have no key:
    rows of equal key and text follow each other. An empty table gives no shards. Texts are encoded once,
    to count, when the lengths of their tokens are kept in the shared folder; with these the text is cut into the same tokens to
    write them. Texts stay where they are; only ids are shuffled, once. Of rows that repeat others, the
    text goes to a task that writes all of them.
    """
    if length < 1 or shard_records < 1:
        raise ValueError("length and shard_records must be positive")
    spark = docs.sparkSession
    notes = shared_files(spark, "lengths")
    places, total = layout(docs, notes, ranks_path, pattern, key=key, text=text)
    n = -(-total // length)
    meta = {"folder": folder, "length": length, "sequences": n, "tokens": total, "seed": seed, "shard_records": shard_records}
    if not n:
        return meta
    parts = saved_sorted(places.select("name", "start", "copies", "n", *NOTED), "name", ["start", "copies", "n", *NOTED], "starts")
    named = docs.select(F.xxhash64(key, text).alias("name"), F.col(text).alias("text"))

    def several(batches):
        """Of rows that repeat others, one per task."""
        starts, told = SortedArrays(parts, "name"), set()
        for batch in batches:
            _, (copies,) = starts.look_up(batch.column("name").to_numpy(), ["copies"])
            rows = []
            for i in np.flatnonzero(copies > 1).tolist():
                if (name := batch.column("name")[i].as_py()) not in told:
                    told.add(name)
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int64()))

    def cut_at(batches, places_of):
        """The ids of texts, cut where records end; ``places_of`` gives texts' first places (below 0: not to be written), counts and places in the notes."""
        tokens, order = _tokens(ranks_path, pattern), Order(n, seed)

        @lru_cache(OPEN_NOTES)
        def note(task):
            return open(f"{notes}/{task}", "rb", buffering=0)

        for batch in slices(batches, "text"):
            places = places_of(batch)
            wanted = places[0] >= 0
            first, count, *noted = (x[wanted].tolist() for x in places)
            body, offsets = raw(batch.column("text").filter(pa.array(wanted)))
            lengths = [tokens.unpacked(os.pread(note(task).fileno(), size, at), c) for c, task, at, size in zip(count, *noted)]
            if [int(x.sum()) for x in lengths] != np.diff(offsets).tolist():
                raise ValueError("texts differ from those that were counted: the table changed while it was written")
            every = tokens.ids(body, np.concatenate(lengths)) if lengths else None
            sequence, inside_at, ids, begin = [], [], [], 0
            for place, c in zip(first, count):
                data = every[begin:begin + c - 1].tobytes() + tokens.end
                begin += c - 1
                done = 0
                while done < len(data):
                    inside = (place + done // 2) % length
                    take = min(2 * (length - inside), len(data) - done)
                    sequence.append((place + done // 2) // length)
                    inside_at.append(inside)
                    ids.append(data[done:done + take])
                    done += take
            slot = order.slots(np.array(sequence, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(inside_at, pa.int32()), pa.array(ids, pa.binary())], names=["slot", "at", "ids"])

    def cut(batches):
        """Rows that are the only ones of their name."""
        starts = SortedArrays(parts, "name")

        def places_of(batch):
            _, (start, copies, *rest) = starts.look_up(batch.column("name").to_numpy(), ["start", "copies", "n", *NOTED])
            return [np.where(copies == 1, start, -1), *rest]

        yield from cut_at(batches, places_of)

    def cut_placed(batches):
        yield from cut_at(batches, lambda batch: [batch.column(c).to_numpy() for c in ("start", "n", *NOTED)])

    def assemble(batches):
        end = _tokens(ranks_path, pattern).end
        slot, record, filled = None, bytearray(), []

        def whole():
            if sum(filled) < length:
                record.extend(end * (length - len(record) // 2))
            return bytes(record)

        for batch in batches:
            out = []
            for s, at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if s != slot:
                    if slot is not None:
                        out.append(whole())
                    slot, record, filled = s, bytearray(), []
                if 2 * at != len(record):
                    raise ValueError(f"slot {s} is not in step: the table changed while it was written")
                record.extend(ids)
                filled.append(len(ids) // 2)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole()], pa.binary())], names=["record"])

    shard = (F.col("slot") / F.lit(shard_records)).cast("int")
    pieces = "slot bigint, at int, ids binary"
    rows = mapped(named, cut, pieces)
    if not places.where("copies > 1").isEmpty():
        once = mapped(named, several, "name bigint, text string").groupBy("name").agg(F.first("text").alias("text"))
        many = once.join(places.where("copies > 1").select("name", "n", "copies", "start", *NOTED), "name")
        last = F.floor((F.col("copies") - 1) / SOME)
        some = many.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("name", "_k")
        own = F.sequence(F.col("_k") * SOME, F.least((F.col("_k") + 1) * SOME, F.col("copies")) - 1)
        copies = some.withColumn("_i", F.explode(own)).select("text", "n", *NOTED, (F.col("start") + F.col("_i") * F.col("n")).alias("start"))
        rows = rows.union(mapped(copies, cut_placed, pieces))
    ranges = rows.repartitionById(-(-n // shard_records), shard)
    (mapped(ranges.sortWithinPartitions("slot", "at"), assemble, "record binary")
     .select(F.col("record").cast("string")).write.option("lineSep", END_OF_RECORD).text(folder))
    return meta


def read_records(spark: SparkSession, meta: dict, from_slot: int = 0) -> DataFrame:
    """One row per record from a slot on: ``slot``, ``sequence``, ``ids`` (binary). Shards before the slot are not opened.

    A shard that is not in step with its stride is refused.
    """
    length, per, n, seed = meta["length"], meta["shard_records"], meta["sequences"], meta["seed"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(meta["folder"]) if n else None
    if files is None:
        return spark.createDataFrame([], "slot bigint, sequence bigint, ids binary")
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("int")
    files = files.select(number.alias("shard"), "content").where(number >= from_slot // per)

    def read(batches):
        order = Order(n, seed)
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = np.frombuffer(content.as_buffer(), np.uint16).reshape(-1, length + 1)
                slots = shard * per + np.arange(len(records))
                if (records[:, length] != np.frombuffer(END_OF_RECORD.encode(), np.uint16)[0]).any() or len(records) != min(per, n - shard * per):
                    raise ValueError(f"shard {shard} is damaged")
                sequences = order.sequences(slots)
                for at in range(max(0, from_slot - shard * per), len(records), 256):
                    part = records[at:at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(slots[at:at + 256]), pa.array(sequences[at:at + 256]),
                                                      pa.array([r[:length].tobytes() for r in part], pa.binary())], names=["slot", "sequence", "ids"])

    return mapped(files, read, "slot bigint, sequence bigint, ids binary")
