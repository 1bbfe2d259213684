"""Unigram piece encoding by a streaming Viterbi search, and decoding.

The search goes through a text once. It holds, beside what is not yet committed, only the
states that a piece can still reach: no more than the longest piece has characters. When
the backpointers of all of them lead through one boundary, the pieces before it can no
longer change and are committed. Scores are added exactly; of equal segmentations, the one
whose last piece starts first wins at every boundary.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import mapped, slices

BLANK = "▁"
SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
FEED = 1 << 16
NOT_REACHED = float("-inf")


class Vocabulary:
    """Pieces of a .model file, with their scores as a unigram model reads them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = p = SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i))]
        self.unknown = p.unk_id()
        self.bytes = {int(p.id_to_piece(i)[1:-1], 16): i for i in range(n) if p.is_byte(i)}
        self.pieces = pieces = {p.id_to_piece(i): (i, p.get_score(i)) for i in plain}
        self.longest = max(map(len, pieces), default=1)
        self.least = min((s for _, s in pieces.values()), default=0.0) - 10.0
        #: No piece goes on to a blank: blanks start segments, and all paths meet there.
        self.blank_starts = not any(BLANK in x.lstrip(BLANK) for x in pieces)
        kept = set(plain)
        self.text = [p.id_to_piece(i).replace(BLANK, " ") if i in kept else " ⁇ " if i == self.unknown else "" for i in range(n)]
        #: Bytes that are part of a character; one below 128 is a character of its own.
        self.byte_of = np.full(n, -1, np.int16)
        for byte, i in self.bytes.items():
            if byte < 128:
                self.text[i] = chr(byte)
            else:
                self.byte_of[i] = byte
        self.leading_blank = p.normalize("a") != "a"

    @cached_property
    def table(self) -> dict[str, tuple]:
        """A piece's id and score; empty for what only begins a piece. Decoding does without it."""
        return dict.fromkeys((x[:k] for x in self.pieces for k in range(1, len(x))), ()) | self.pieces

    def normalised(self, text: str) -> str:
        """As the model's normaliser gives it, with its leading blank, and blanks as their mark."""
        return self.processor.normalize(text) if text else ""


class Search:
    """The streaming search over one text or segment: ``feed`` returns the ids it commits.

    ``best``, ``back`` and ``ids`` hold, per boundary after the last committed one, the best
    score, and the piece that ends there on its path.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.open, self.at, self.check = "", 0, 4 * self.v.longest
        self.best, self.back, self.ids = [0.0], [0], [-1]

    def feed(self, text: str, last: bool = False) -> list[int]:
        longest, least, look_up = self.v.longest, self.v.least, self.v.table.get
        chars = self.open = self.open + text
        size, at, check = len(chars), self.at, self.check
        best, back, ids = self.best, self.back, self.ids
        more = size + 1 - len(best)
        best += [NOT_REACHED] * more
        back += [0] * more
        ids += [-1] * more
        out: list[int] = []
        ready = size if last else size - longest + 1
        while at < ready:
            score, end = best[at], at + 1
            known = look_up(chars[at:end])
            if not known and score + least > best[end]:  # no piece of this character alone
                best[end], back[end], ids[end] = score + least, at, -1
            while known is not None:
                if known:
                    total = score + known[1]
                    if total > best[end]:
                        best[end], back[end], ids[end] = total, at, known[0]
                if end == size:
                    break
                end += 1
                known = look_up(chars[at:end])
            at += 1
            if at >= check:
                done = self._converged(at)
                if done:
                    out += self._path(done)
                    base = best[done]
                    chars = self.open = chars[done:]
                    best = self.best = [s - base for s in best[done:]]
                    back = self.back = [max(b - done, 0) for b in back[done:]]
                    ids = self.ids = ids[done:]
                    size, at, ready = size - done, at - done, ready - done
                check = self.check = at + 4 * longest
        self.at = at
        if last:
            out += self._path(size)
            self._reset()
        return out

    def _converged(self, at: int) -> int:
        """The last boundary on the best paths of all states that are still in play."""
        live = {k for k in range(at, min(at + self.v.longest, len(self.best))) if self.best[k] != NOT_REACHED}
        while len(live) > 1:
            k = max(live)
            live.discard(k)
            live.add(self.back[k])
        return live.pop()

    def _path(self, end: int) -> list[int]:
        back, ids = self.back, self.ids
        out: list[int] = []
        while end:
            begin, i = back[end], ids[end]
            if i >= 0:
                out.append(i)
            elif self.v.bytes:
                out.extend(self.v.bytes[b] for b in reversed(self.open[begin:end].encode()))
            else:
                out.append(self.v.unknown)
            end = begin
        out.reverse()
        return out


class Encoder:
    """Ids of texts. Segments between boundaries that every path takes are remembered, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 1 << 17):
        self.v, self.remember = vocabulary, remember
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known before ``known`` was last begun anew
        self.search = Search(vocabulary)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as int32."""
        text = self.v.normalised(text or "")
        if not self.v.blank_starts:
            ids = np.asarray(self._search(text), np.int32)
        else:
            segments = SEGMENT.findall(text)
            found = list(map(self.known.get, segments))
            if None in found:
                known, before = self.known, self.before
                for k, ids in enumerate(found):
                    if ids is None:
                        segment = segments[k]
                        ids = known.get(segment) or before.get(segment)
                        if ids is None:
                            ids = array("i", self._search(segment)).tobytes()
                        if len(segment) <= 64:
                            known[segment] = ids
                        found[k] = ids
                if len(known) >= self.remember:
                    self.known, self.before = {}, known
            ids = np.frombuffer(b"".join(found), np.int32)
        if not self.v.bytes and len(ids):  # unknown characters in a row are one id
            ids = ids[~((ids == self.v.unknown) & np.concatenate([[False], ids[:-1] == self.v.unknown]))]
        return ids

    def _search(self, text: str) -> list[int]:
        out = []
        for at in range(0, len(text), FEED):
            out += self.search.feed(text[at:at + FEED], at + FEED >= len(text))
        return out

    def decode(self, ids: np.ndarray) -> str:
        v = self.v
        if not len(ids):
            return ""
        byte = v.byte_of[ids] >= 0
        if byte.any():
            parts, edge = [], np.flatnonzero(np.diff(byte)) + 1
            for begin, end in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)]):
                part = ids[begin:end]
                parts.append(v.byte_of[part].astype(np.uint8).tobytes().decode("utf-8", "replace") if byte[begin]
                             else "".join(map(v.text.__getitem__, part.tolist())))
            text = "".join(parts)
        else:
            text = "".join(map(v.text.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == " " and v.leading_blank else text


_held: dict = {}


def _encoder(path: str) -> Encoder:
    if path not in _held:
        _held[path] = Encoder(Vocabulary(path))
    return _held[path]


def encoded(docs: DataFrame, model_path: str, *, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an array.

    The file must be at the same path on all workers; its pieces and scores are read as a
    unigram model. Begin and end marks are not added. Nulls and empty texts have no ids;
    a text of any length is searched in one pass. A column called ``name`` is replaced.
    """
    out = docs.drop(name).withColumn(name, F.array().cast("array<int>"))

    def encode(batches):
        encoder = _encoder(model_path)
        for batch in slices(batches, text, 1 << 20):
            found = [encoder.encode(t) for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
            yield batch.set_column(batch.schema.get_field_index(name), batch.schema.field(name), ids.cast(batch.schema.field(name).type))

    return mapped(out, encode, out.schema)


def decoded(docs: DataFrame, model_path: str, *, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text that each array of ids stands for; null and empty arrays give an empty text.

    Decoding inverts encoding for texts that the normaliser leaves alone and that do not
    hold the blank mark itself. A column called ``name`` is replaced.
    """
    out = docs.drop(name).withColumn(name, F.lit("").cast("string"))

    def decode(batches):
        encoder = _encoder(model_path)
        for batch in batches:
            at = batch.schema.get_field_index(name)
            column = batch.column(ids)
            values, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0))])
            texts = [encoder.decode(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return mapped(out, decode, out.schema)
