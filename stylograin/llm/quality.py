"""Quality rules: text statistics, and a decision list learned from labelled documents.

The statistics of a text are counts, made for many texts at once in numpy. The list is
learned by sequential covering: a rule grows by the threshold that gains most, is pruned on
rows that did not grow it, and takes its rows away before the next rule is sought. It is
emitted as an ordered Spark conditional expression, so applying it costs no Python.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import mapped, mix, raw, slices, stored
from stylograin.llm.wordhash import NOT_SPACE, hashes, runs, spans

#: Counts of each text, all bigint.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks"]

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
NOT_LINE_FEED = np.arange(256) != 0x0A
UPPER = np.isin(np.arange(256), np.arange(65, 91))
DIGITS = np.isin(np.arange(256), np.arange(48, 58))
MARKS = np.isin(np.arange(256), [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    data, offsets = raw(column)
    n = len(column)
    starts, ends, first = spans(data, offsets)
    word_chars = per_text(FIRST_BYTE[data] & NOT_SPACE[data], offsets)

    line_starts, line_ends, _ = spans(data, offsets, NOT_LINE_FEED)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_text = np.searchsorted(offsets, line_starts, "right") - 1
    keys = mix(hashes(data, line_starts, line_ends) + mix(line_text.astype(np.uint64)))
    _, kept = np.unique(keys, return_index=True)
    n_lines = np.bincount(line_text, minlength=n)

    words = hashes(data, starts, ends)
    window, begin = runs(words, first, 3)
    n_words = np.diff(first)
    window_text = np.repeat(np.arange(n), np.diff(begin))
    full = n_words[window_text] >= 3
    window_at = (first[:-1][window_text] + np.arange(len(window)) - begin[:-1][window_text])[full]
    _, same, times = np.unique(mix(window[full] + mix(window_text[full].astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = window_at[times[same] > 1]
    repeated = np.zeros(len(words) + 1, bool)
    for k in range(3):
        repeated[twice + k] = True
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_text(SYMBOLS[data], offsets),
            "n_lines": n_lines, "n_dup_lines": n_lines - np.bincount(line_text[kept], minlength=n),
            "n_repeat_words": per_text(repeated[:-1], first), "n_upper": per_text(UPPER[data], offsets),
            "n_digits": per_text(DIGITS[data], offsets), "n_marks": per_text(MARKS[data], offsets)}


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``COUNTS`` of each whole text, under their names after ``prefix``.

    Words are runs of anything but blanks and ASCII white space. A null or empty text counts
    zero everywhere. Columns of the same names are replaced; repeated rows are each counted.
    """
    names = {prefix + c: c for c in COUNTS}
    out = docs.drop(*names).select("*", *[F.lit(0).cast("long").alias(c) for c in names])

    def count(batches):
        for batch in slices(batches, text):
            made = counts(batch.column(text))
            yield pa.RecordBatch.from_arrays([pa.array(made[names[f.name]], pa.int64()) if f.name in names else batch.column(k)
                                              for k, f in enumerate(batch.schema)], names=batch.schema.names)

    return mapped(out, count, out.schema)


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def features(prefix: str = "") -> dict[str, Column]:
    """The statistics that rules may test, as expressions over ``COUNTS``; never null."""
    def share(part, whole):
        whole = F.col(prefix + whole)
        return F.when(whole > 0, F.col(prefix + part) / whole).otherwise(F.lit(0.0))
    return {"n_words": F.col(f"{prefix}n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"),
            "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
            "upper": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"), "marks": share("n_marks", "word_chars"),
            "line_words": share("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, over: dict[str, Column]) -> Column:
        return over[self.feature] > F.lit(self.threshold) if self.above else over[self.feature] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that meets all conditions of a rule is rejected, all others are kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_number(self, over: dict[str, Column]) -> Column:
        """The number of the first rule that rejects the row (from 1), or null."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            met = F.lit(True)
            for condition in self.rules[k - 1]:
                met = met & condition.column(over)
            out = F.when(met, F.lit(k)).otherwise(out)
        return out

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= covers(rule, x, len(out))
        return out

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, rule)) for rule in self.rules)


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, *, precision: float = 0.98, least: int = 5,
          thresholds: int = 64, max_conditions: int = 4, max_rules: int = 32) -> DecisionList:
    """A decision list that rejects rows like the ``bad`` ones.

    Rules grow on the rows outside ``prune`` by information gain over at most ``thresholds``
    quantiles per feature and direction, lose their last conditions while that does not
    harm their worth on ``prune``, and are taken only if they reject at least ``least`` bad
    rows with at least ``precision`` on either part. Equal gains go to the earlier feature,
    "above" and the lower threshold, so the list depends on the rows alone.
    """
    grid = {name: np.unique(np.quantile(v, np.linspace(0, 1, thresholds + 1), method="lower")) if len(v) else v for name, v in x.items()}
    left, rules = np.ones(len(bad), bool), []

    def tally(rule, part):
        met = covers(rule, x, len(bad)) & left & part
        return int((met & bad).sum()), int((met & ~bad).sum())

    while len(rules) < max_rules:
        rule, grow = [], ~prune
        p, q = tally(rule, grow)
        while q and p and len(rule) < max_conditions:
            base, met = np.log2(p / (p + q)), covers(rule, x, len(bad)) & left & grow
            best = (1e-9, None)
            for name, values in x.items():
                cut = np.searchsorted(grid[name], values[met], "left")  # values <= grid[i] have cut <= i
                n_bad = np.cumsum(np.bincount(cut[bad[met]], minlength=len(grid[name]) + 1))[:-1]
                n_good = np.cumsum(np.bincount(cut[~bad[met]], minlength=len(grid[name]) + 1))[:-1]
                for above, pp, qq in ((True, p - n_bad, q - n_good), (False, n_bad, n_good)):
                    gain = pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(pp + qq, 1e-9)) - base)
                    k = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and pp[k] and gain[k] > best[0]:
                        best = (gain[k], Condition(name, above, float(grid[name][k])))
            if best[1] is None:
                break
            rule.append(best[1])
            p, q = tally(rule, grow)
        worth = []
        for k in range(1, len(rule) + 1):
            a, b = tally(rule[:k], prune)
            worth.append((a - b) / (a + b) if a + b else -1.0)
        if not worth:
            break
        rule = rule[:int(np.argmax(worth)) + 1]
        (p, q), (a, b) = tally(rule, grow), tally(rule, prune)
        if p + a < least or p < precision * (p + q) or a < precision * (a + b):
            break
        rules.append(rule)
        left &= ~covers(rule, x, len(bad))
    return DecisionList(rules)


def fitted_rules(counted: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", max_rows: int = 40_000, **how) -> DecisionList:
    """Learn the list from labelled documents; ``label`` 0 is bad, 1 is good.

    ``counted`` holds ``key`` and ``COUNTS``. At most about ``max_rows`` labelled rows are
    used, chosen by a hash of the key: the only bound on what is fitted. A key labelled
    more than once counts as bad if it is so once; null keys and labels are left out.
    Without bad or without good rows the list is empty.
    """
    one = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key"))
           .agg(F.min(label).alias("_label")))
    n = one.count()
    share = min(1.0, max_rows / max(n, 1))
    hashed = F.pmod(F.xxhash64("_key"), F.lit(1 << 20))
    one = one.where(hashed < F.lit(int(share * (1 << 20)))).withColumn("_prune", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(3)) == 0)
    over = features()
    rows = counted.join(one, counted[key] == one["_key"]).select(*[c.alias(k) for k, c in over.items()], "_label", "_prune").toPandas()
    x = {k: rows[k].to_numpy(float) for k in over}
    order = np.lexsort([rows["_label"].to_numpy(), rows["_prune"].to_numpy(), *x.values()]) if len(rows) else []
    return learn({k: v[order] for k, v in x.items()}, rows["_label"].to_numpy(int)[order] == 0, rows["_prune"].to_numpy(bool)[order], **how)


def with_verdict(counted: DataFrame, rules: DecisionList) -> DataFrame:
    """``counted`` with ``base_failed``, ``rule`` (number of the rejecting rule, or null) and ``kept``."""
    return (counted.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number(features()))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def judged(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: its key, ``COUNTS`` and the verdict. Texts are read once and not carried on."""
    counted = stored(with_counts(docs.select(key, text), text).drop(text), "counts")
    return with_verdict(counted, fitted_rules(counted, labels, key=key, **how))


def kept_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rejected ones, with their columns as they were.

    The counts are made twice: once, without texts, to learn; once beside the rows they
    judge, so that texts need no join.
    """
    learned = stored(with_counts(docs.select(key, text), text).drop(text), "counts")
    rules = fitted_rules(learned, labels, key=key, **how)
    own = f"_{uuid.uuid4().hex}_"  # no column of the input is called so
    counted = with_counts(docs, text, own)
    return counted.where(~base_failed(own) & rules.rule_number(features(own)).isNull()).select(docs.columns)
