"""Secret scans: fixed patterns, and formats inferred from the credentials they find.

The credentials found by the patterns are the labelled examples. Per kind, their prefix tree
is folded into a probabilistic automaton: states whose statistics do not differ by more
than chance are merged. Every other run of credential characters
in the corpus that is as long as the shortest credential (8 characters), and every such
piece of a run beside a pattern's span, is then scored by how much likelier a learned
format makes it than the corpus's own runs do.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import mapped, slices, stored

#: The patterns and least lengths of the three kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
PATTERN_LEAST = 16  # of an access key; hexadecimal runs are longer

#: What an assignment must contain, in lower case.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")  # ASSIGN_LEAST
CREDENTIAL = re.compile(r"[A-Za-z0-9+/_.=-]")
MARKS = "+/_.=-"
FORMAT = "format"
END = ""
SYMBOLS = 69  # credential characters and the end

Span = tuple[int, int, str]


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, str]], list[tuple[int, int]]]:
    """Spans (start, end, kind) of the fixed patterns, the (kind, credential) pairs, and all runs of credential characters.

    Runs have ``ASSIGN_LEAST`` characters or more. A run of 32 hexadecimal digits, or an
    access key, lies within a run of 16 or more, so only those are searched for them.
    """
    spans, found = [], []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                spans.append((m.start(), m.end(), "assign"))
                found.append(("assign", m[2]))
    runs = [m.span() for m in RUN.finditer(text)]
    for start, end in runs:
        if end - start < PATTERN_LEAST:
            continue
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            for m in pattern.finditer(text, start, end):
                spans.append((m.start(), m.end(), kind))
                found.append((kind, m[0]))
    return spans, found, runs


def apart(runs: list[tuple[int, int]], spans: list[Span]) -> Iterator[tuple[int, int]]:
    """The runs, or what the spans leave of them in pieces of ``ASSIGN_LEAST`` characters or more."""
    taken = sorted((s, e) for s, e, _ in spans)
    k = 0
    reach = -1
    for start, end in runs:
        at = max(start, reach)
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] - at >= ASSIGN_LEAST:
                yield at, taken[k][0]
            reach = max(reach, taken[k][1])
            at = max(at, reach)
            k += 1
        if at == start or end - at >= ASSIGN_LEAST:
            yield at, end


def candidates(text: str, runs: list[tuple[int, int]], spans: list[Span]) -> Iterator[tuple[int, int]]:
    """What is scored: the pieces of ``apart``, without the marks that join them to a span."""
    for start, end in apart(runs, spans):
        a, b = start, end
        if a and CREDENTIAL.match(text, a - 1):
            while a < b and text[a] in MARKS:
                a += 1
        if CREDENTIAL.match(text, b):
            while a < b and text[b - 1] in MARKS:
                b -= 1
        if b - a >= ASSIGN_LEAST:
            yield a, b


class Format:
    """A probabilistic automaton inferred from strings.

    The prefix tree is folded layer by layer. States at the same depth are merged unless
    their next characters, the classes of the eight that follow, or the lengths that are
    left differ by more than chance (Hoeffding's bound, Kolmogorov and Smirnov's distance).
    So fixed heads, places and lengths stay in the states. A state joins one of an earlier
    layer, which makes a loop, only if the lengths left after either are memoryless, that
    is, if the chance of an end does not depend on the depth. Below ``least`` strings, and
    beyond ``depth`` characters, nothing can be told apart: there the rest goes to one
    state that loops. A state's characters are backed by those of all the strings, with a weight
    that grows with the share of its observations that were new characters; its end, with
    that of one observation.
    """

    def __init__(self, strings: dict[str, int], alpha: float = 0.05, least: int = 8, depth: int = 256):
        self.least, self.bound = least, math.sqrt(0.5 * math.log(2 / alpha))
        self.arcs: list[dict[str, int]] = [{}, {}]  # the first state and the one that loops
        self._fold(strings, depth)
        self._probabilities(strings)
        del self.arcs

    def _limit(self, n: int, m: int) -> float:
        return self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: _Rest, b: _Rest) -> bool:
        """Whether two sets of suffixes differ by no more than chance."""
        most = self._limit(a.n, b.n)
        return all(abs(x.get(k, 0) / a.n - y.get(k, 0) / b.n) <= most
                   for x, y in ((a.next, b.next), (a.classes, b.classes)) for k in x.keys() | y.keys()) and _distance(a.left, b.left) <= most

    def _memoryless(self, rest: _Rest) -> bool:
        """Whether the lengths left after half the median are distributed as those at the start are."""
        lengths = sorted(rest.left.elements())
        step = max(1, lengths[len(lengths) // 2] // 2)
        later = Counter({k - step: n for k, n in rest.left.items() if k >= step})
        m = sum(later.values())
        return m >= self.least and rest.n >= self.least and _distance(rest.left, later) <= self._limit(rest.n, m)

    def _fold(self, strings: dict[str, int], depth: int) -> None:
        layer = [(0, _Rest(strings, 0))] if sum(strings.values()) >= self.least else []
        if not layer:
            self.arcs[0] = {c: 1 for c in sorted({c for s in strings for c in s[:1]})}
        loops: list[tuple[int, _Rest]] = []
        for at in range(depth):
            # Strings by state and next character, the most frequent first: they settle the states of the next layer.
            found: list[tuple[int, str, _Rest]] = []
            for state, rest in layer:
                if self._memoryless(rest):
                    loops.append((state, rest))
                by_next: dict[str, dict[str, int]] = {}
                for string, n in rest.strings.items():
                    if len(string) > at:
                        by_next.setdefault(string[at], {})[string] = n
                found += [(state, c, _Rest(group, at + 1)) for c, group in by_next.items()]
            found.sort(key=lambda f: (-f[2].n, f[0], f[1]))
            settled: list[list] = []
            for state, c, rest in found:
                loop = next((to for to, earlier in loops if self._alike(earlier, rest)), None) if self._memoryless(rest) else None
                if loop is not None:
                    self.arcs[state][c] = loop
                    continue
                for entry in settled:
                    if self._alike(entry[1], rest):
                        entry[1] = entry[1].joined(rest)
                        break
                else:
                    entry = [0, rest]
                    settled.append(entry)
                entry.append((state, c))
            layer = []
            for entry in settled:
                if entry[1].n < self.least or at + 1 == depth:
                    to = 1
                else:
                    to = len(self.arcs)
                    self.arcs.append({})
                    layer.append((to, entry[1]))
                for state, c in entry[2:]:
                    self.arcs[state][c] = to
            if not layer:
                break

    def _probabilities(self, strings: dict[str, int]) -> None:
        """Count what each string does in the automaton; a choice that a state lacks leads where most of its own do."""
        counts = [Counter() for _ in self.arcs]
        common = Counter()
        for string, n in strings.items():
            state = 0
            for c in string:
                counts[state][c] += n
                common[c] += n
                state = self.arcs[state].get(c, 1)
            counts[state][END] += n
            common[END] += n
        total = sum(common.values())
        floor = 0.5 / (total + 0.5 * SYMBOLS)
        back = {c: (n + 0.5) / (total + 0.5 * SYMBOLS) for c, n in common.items()}
        self.steps, self.others = [], []
        for arcs, count in zip(self.arcs, counts):
            end, kinds, seen = back.get(END, 0.0), len(count.keys() - {END}), sum(count.values()) - count[END]
            weight = max(1.0, kinds * seen / (seen - kinds + 1))
            n = sum(count.values()) + weight * (1 - end) + end
            leads = Counter()
            for c, to in arcs.items():
                leads[to] += count[c]
            other = leads.most_common(1)[0][0] if leads else 1
            self.steps.append({c: (arcs.get(c, other), math.log((count[c] + (weight if c else 1) * p) / n)) for c, p in back.items()})
            self.others.append((other, math.log(weight * floor / n)))

    def log_likelihood(self, string: str) -> float:
        at, total = 0, 0.0
        steps, others = self.steps, self.others
        for c in string:
            at, gain = steps[at].get(c) or others[at]
            total += gain
        return total + (steps[at].get(END) or others[at])[1]


class _Rest:
    """What is left of some strings after ``at`` characters: their lengths, next characters and the classes of the next eight."""

    def __init__(self, strings: dict[str, int], at: int):
        self.strings, self.n = strings, sum(strings.values())
        self.left, self.next, self.classes = Counter(), Counter(), Counter()
        for string, n in strings.items():
            self.left[len(string) - at] += n
            self.next[string[at:at + 1]] += n
            ahead = string[at:at + 8]
            for c in ahead:
                self.classes["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "."] += n / len(ahead)

    def joined(self, other: _Rest) -> _Rest:
        out = _Rest({}, 0)
        out.strings = {s: self.strings.get(s, 0) + other.strings.get(s, 0) for s in self.strings | other.strings}
        out.n = self.n + other.n
        out.left, out.next, out.classes = self.left + other.left, self.next + other.next, self.classes + other.classes
        return out


def _distance(a: Counter, b: Counter) -> float:
    """The largest difference between two distributions of lengths, summed up."""
    n, m = sum(a.values()), sum(b.values())
    x = y = most = 0.0
    for k in sorted(a.keys() | b.keys()):
        x, y = x + a[k] / n, y + b[k] / m
        most = max(most, abs(x - y))
    return most


class Ordinary:
    """Character pairs of all runs of the corpus that no pattern matched."""

    def __init__(self, pairs: dict[str, int]):
        after = Counter()
        for pair, n in pairs.items():
            after[pair[:1]] += n
        self.pairs = {pair: math.log((n + 0.5) / (after[pair[:1]] + 40)) for pair, n in pairs.items()}
        self.unseen = {c: math.log(0.5 / (n + 40)) for c, n in after.items()}

    def log_likelihood(self, string: str) -> float:
        pairs, unseen = self.pairs, self.unseen
        return sum(pairs.get(p) or unseen.get(p[0], -math.log(80)) for p in map("".join, zip("^" + string, string)))


class Scanner:
    """Learned formats with the score each must reach, and the share of held-out credentials that reach it."""

    def __init__(self, formats: dict[str, Format], ordinary: Ordinary, limits: dict[str, float]):
        self.formats, self.ordinary, self.limits = formats, ordinary, limits
        self.recall: dict[str, float] = {}

    def score(self, kind: str, string: str) -> float:
        """Gain in log-likelihood per character of a format over ordinary runs."""
        return (self.formats[kind].log_likelihood(string) - self.ordinary.log_likelihood(string)) / (len(string) + 1)

    def accepts(self, string: str) -> bool:
        return any(self.score(kind, string) >= self.limits[kind] for kind in self.formats)


def learned(docs: DataFrame, text: str = "text", max_examples: int = 2000, share_of_gain: float = 0.5, least_gain: float = 0.25,
            caution: float = 1.0) -> Scanner:
    """Infer one format per kind from the corpus.

    Distinct credentials and character pairs are counted over all texts. A format is
    inferred from at most about ``max_examples`` distinct credentials of its kind, chosen by
    hash, two thirds to learn and the rest, held out, to set its limit: ``share_of_gain`` times their
    median score, and ``least_gain`` at least, each widened by ``caution`` over the root of the number of
    examples, so that a format of few examples accepts only what it makes much likelier. ``Scanner.recall``
    tells which share of the held-out credentials, without the words before them, reach the
    limit. A kind without a credential to learn or to hold out gets no format.
    """
    def collect(batches):
        found: Counter[tuple[str, str]] = Counter()
        pairs: Counter[str] = Counter()
        for batch in slices(batches, text):
            for value in batch.column(0).to_pylist():
                if value:
                    spans, credentials, runs = base_spans(value)
                    found.update(credentials)
                    for start, end in candidates(value, runs, spans):
                        run = value[start:end]
                        pairs.update(map("".join, zip("^" + run, run)))
            if len(found) > 1 << 17:
                yield rows(found)
                found.clear()
        yield rows(found + Counter({("pair", p): n for p, n in pairs.items()}))

    def rows(counter):
        keys = list(counter)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()),
                                           pa.array([counter[k] for k in keys], pa.int64())], names=["kind", "value", "n"])

    counted = stored(mapped(docs.select(text), collect, "kind string, value string, n bigint")
                     .groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    sizes = dict(counted.groupBy("kind").count().collect())
    share = F.pmod(F.xxhash64("value"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    pairs = {r.value: r.n for r in counted.where("kind = 'pair'").collect()}
    ordinary = Ordinary(pairs)
    formats, limits, recall = {}, {}, {}
    for kind in KINDS:
        if kind not in sizes:
            continue
        chosen = counted.where((F.col("kind") == kind) & (share < min(1.0, max_examples / sizes[kind]))).withColumn("u", F.pmod(F.xxhash64("value", F.lit(3)), F.lit(3))).collect()
        grow, held = {r.value: 1 for r in chosen if r.u}, sorted(r.value for r in chosen if not r.u)
        if not grow or not held:
            continue
        formats[kind] = Format(grow)
        scores = sorted(Scanner(formats, ordinary, limits).score(kind, s) for s in held)
        limits[kind] = max(least_gain, share_of_gain * scores[len(scores) // 2]) + caution / math.sqrt(len(chosen))
        recall[kind] = sum(x >= limits[kind] for x in scores) / len(scores)
    scanner = Scanner(formats, ordinary, limits)
    scanner.recall = recall
    return scanner


_held: dict = {}


def with_secrets(docs: DataFrame, scanner: Scanner, *, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with an array of the spans of secrets, in order of start, then kind (patterns as listed, then learned formats).

    Starts and ends count code points, end exclusive. Spans of different kinds may overlap;
    a learned span overlaps no other. Nulls and empty texts have none; repeated rows are each
    scanned; whole texts are scanned. A column called ``name`` is replaced.
    """
    held, token = docs.sparkSession.sparkContext.broadcast(scanner), uuid.uuid4().hex
    out = docs.drop(name).withColumn(name, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = {kind: k for k, kind in enumerate([*KINDS, FORMAT])}

    def scan(batches):
        if _held.get("token") != token:
            _held.update(token=token, scanner=held.value, seen={})
        scanner, seen = _held["scanner"], _held["seen"]
        for batch in slices(batches, text):
            result = []
            for value in batch.column(text).to_pylist():
                spans, _, runs = base_spans(value) if value else ([], [], [])
                for start, end in candidates(value, runs, spans) if scanner.formats else ():
                    run = value[start:end]
                    if run not in seen:
                        if len(seen) > 1 << 16:
                            seen.clear()
                        seen[run] = scanner.accepts(run)
                    if seen[run]:
                        spans.append((start, end, FORMAT))
                spans.sort(key=lambda s: (s[0], order[s[2]]))
                result.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            yield batch.set_column(batch.schema.get_field_index(name), batch.schema.field(name), pa.array(result, kind_type))

    return mapped(out, scan, out.schema)


def redacted(docs: DataFrame, scanner: Scanner, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans are replaced as one."""
    spans_of = f"_secrets_{uuid.uuid4().hex}"
    found = with_secrets(docs, scanner, text=text, name=spans_of)

    def replace(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(spans_of).to_pylist()):
                if spans:
                    value, parts, begin = texts[i], [], 0
                    k = 0
                    while k < len(spans):
                        start, end = spans[k]["start"], spans[k]["end"]
                        k += 1
                        while k < len(spans) and spans[k]["start"] < end:
                            end = max(end, spans[k]["end"])
                            k += 1
                        parts += [value[begin:start], mark]
                        begin = end
                    texts[i] = "".join([*parts, value[begin:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return mapped(found, replace, found.schema).drop(spans_of)
