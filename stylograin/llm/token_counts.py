"""Token counts by a two-tier lookup on the map side.

Byte-level BPE splits a text into pre-tokens and merges inside each one, so a text's count
is a sum over pieces that are cut where a pre-token must end: before a blank, and before a
line feed, that the next word follows at once. The token counts of frequent pieces are
broadcast; each worker encodes all others in batches and remembers them up to a bound.
Pieces are never shuffled. Only counts of the pieces that are frequent within a task are,
to choose the table; the table decides the speed, never a result.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import mapped, slices, stored

LONGEST_PIECE = 64


def pieces(text: str) -> list[str]:
    """The text cut before blanks and line feeds; blanks are left out and line feeds are kept."""
    return text.replace("\n", " \n").split(" ")


def frequent_pieces(docs: DataFrame, text: str, table_size: int, held: int = 1 << 20) -> dict[str, int]:
    """Pieces that make up at least 1 / ``table_size`` of the corpus (so no more than ``table_size``), with their counts.

    A task that meets more than ``held`` different pieces forgets the rare ones, so counts
    may be a little low.
    """
    def count(batches):
        seen: Counter[str] = Counter()
        total = 0
        for batch in slices(batches, text):
            for value in batch.column(0).to_pylist():
                if value:
                    found = pieces(value)
                    total += len(found)
                    seen.update(found)
            least = 2
            while len(seen) > held:
                seen = Counter({p: n for p, n in seen.items() if n >= least})
                least *= 2
        rows = [(p, n) for p, n in seen.items() if n * table_size >= total and 0 < len(p) <= LONGEST_PIECE] + [(None, total)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
                                         names=["piece", "n"])

    counts = mapped(docs.select(text), count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pieces")
    total = counts.where("piece IS NULL").agg(F.sum("n")).first()[0] or 0
    return {r.piece: r.n for r in counts.where(F.col("piece").isNotNull() & (F.col("n") * F.lit(table_size) >= F.lit(total))).collect()}


class TokenCounter(dict):
    """Token counts of pieces: this dict is the broadcast tier, ``remembered`` the worker's own."""

    def __init__(self, tokenizer_path: str, frequent: list[str], remember: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remember, self.remembered, self.missed = remember, {}, []
        self.update(zip(frequent, self.encoded(frequent)))

    @staticmethod
    def cuttable(piece: str) -> bool:
        """The word follows at once: else white space before and after the cut could be one pre-token."""
        word = piece[1:] if piece[:1] == "\n" else piece
        return bool(word) and not word[0].isspace()

    def encoded(self, found: list[str]) -> list[int]:
        whole = [p if p[:1] == "\n" else " " + p for p in found]
        return [len(e) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]

    def __missing__(self, piece: str) -> int:
        n = self.remembered.get(piece)
        if n is None:
            self.missed.append(piece)
            return 0
        return n

    def counts(self, texts: list[str | None]) -> list[int]:
        out, open_, whole = [], [], []
        self.missed = []
        for i, text in enumerate(texts):
            if not text:
                out.append(0)
                continue
            found = pieces("\n" + text)  # the first word is then like any line's first, plus one line feed
            before = len(self.missed)
            out.append(sum(map(self.__getitem__, found[1:])) - 1)
            if len(self.missed) > before:
                open_.append((i, before, len(self.missed)))
        missed = list({p for p in self.missed})
        lengths = {p: None for p in missed if not self.cuttable(p)}
        regular = [p for p in missed if p not in lengths]
        lengths.update(zip(regular, self.encoded(regular)))
        for i, begin, end in open_:
            parts = [lengths[p] for p in self.missed[begin:end]]
            if None in parts:
                whole.append(i)
            else:
                out[i] += sum(parts)
        for i in whole:
            out[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False))
        if len(self.remembered) > self.remember:
            self.remembered = {}
        self.remembered.update((p, n) for p, n in lengths.items() if n is not None and len(p) <= LONGEST_PIECE)
        return out


_held: dict = {}


def with_token_counts(docs: DataFrame, tokenizer_path: str, *, text: str = "text", name: str = "n_tokens",
                      table_size: int = 1 << 17, remember: int = 1 << 18) -> DataFrame:
    """``docs`` with the number of tokens of each whole text, as the tokenizer file counts them.

    No begin, end or other added tokens; no truncation or padding; a special token's string
    inside a text is the tokenizer's special token. The file must hold a byte-level BPE that
    splits texts by its own pattern and adds no blank in front; it must be at the same path
    on all workers. Nulls and empty texts count 0. Texts where blanks or line feeds stand
    beside other white space are encoded whole. A column called ``name`` is replaced.
    """
    frequent = sorted(frequent_pieces(docs, text, table_size))
    held, token = docs.sparkSession.sparkContext.broadcast([p for p in frequent if TokenCounter.cuttable(p)]), uuid.uuid4().hex
    out = docs.drop(name).withColumn(name, F.lit(0).cast("long"))

    def count(batches):
        if _held.get("token") != token:
            _held.update(token=token, counter=TokenCounter(tokenizer_path, held.value, remember))
        for batch in slices(batches, text, 8 << 20):
            found = pa.array(_held["counter"].counts(batch.column(text).to_pylist()), pa.int64())
            yield batch.set_column(batch.schema.get_field_index(name), batch.schema.field(name), found)

    return mapped(out, count, out.schema)
