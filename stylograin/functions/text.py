"""Native text expressions: words, n-grams, surface features."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# The keyword counts of the surface feature row.
CODE_KEYWORDS = {"num_for": "for", "num_while": "while", "num_if": "if", "num_def": "def",
                 "num_function": "function"}

# The substring counts of the surface feature row.
CODE_MARKS = {"num_open_brace": "{", "num_close_brace": "}", "num_semicolon": ";",
              "num_hash_comment": "#", "num_slash_comment": "//"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a costly value to a lambda variable, so that ``use`` may mention it often."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, case kept."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs, joined by a space."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def words_and_bigrams(text: Column) -> Column:
    return once(words(text), lambda tokens: F.concat(tokens, bigrams(tokens)))


def clean_text(text: Column) -> Column:
    """The lower-cased text with white-space runs made one space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")


def char_ngrams(text: Column, shortest: int = 3, longest: int = 5) -> Column:
    """All character n-grams of the lower-cased text, white-space runs made one space.

    A look-ahead matches at every position, so one pass over the text per length
    is enough; the first guard skips positions inside a surrogate pair.
    """
    def grams(clean: Column, n: int) -> Column:
        pattern = r"(?s)(?![\uDC00-\uDFFF])(?=(.{%d}))" % n
        return F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))

    return once(clean_text(text), lambda clean: F.concat(
        *[grams(clean, n) for n in range(shortest, longest + 1)]))


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def mean_line_length(text: Column) -> Column:
    lines = line_count(text)
    return (F.length(text) - (lines - 1)) / lines


def keyword_count(text: Column, word: str) -> Column:
    """How often a word occurs as a whole token."""
    return F.size(F.filter(words(text), lambda w: w == word))


def mark_count(text: Column, mark: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return (removed / len(mark)).cast("int")


def blank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"(?U)^\s*$")))


def indent_std(text: Column) -> Column:
    """Population deviation of the leading spaces of the non-blank lines, 0 if there are none."""
    full = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"(?U)^\s*$"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(acc: Column, line: Column) -> Column:
        spaces = (F.length(line) - F.length(F.ltrim(line, F.lit(" ")))).cast("double")
        return F.struct((acc["n"] + 1.0).alias("n"), (acc["s"] + spaces).alias("s"),
                        (acc["q"] + spaces * spaces).alias("q"))

    def finish(acc: Column) -> Column:
        mean = acc["s"] / acc["n"]
        spread = F.greatest(acc["q"] / acc["n"] - mean * mean, F.lit(0.0))
        return F.when(acc["n"] > 0, F.sqrt(spread)).otherwise(0.0)

    return F.aggregate(full, start, add, finish)


def surface_features(text: Column, keywords: Mapping[str, str] = CODE_KEYWORDS,
                     marks: Mapping[str, str] = CODE_MARKS) -> dict[str, Column]:
    """The 15 surface features as named double columns."""
    columns = {
        "num_lines": line_count(text),
        "num_chars": F.length(text),
        "avg_line_length": mean_line_length(text),
        **{name: keyword_count(text, word) for name, word in keywords.items()},
        **{name: mark_count(text, mark) for name, mark in marks.items()},
        "blank_lines": blank_lines(text),
        "indent_std": indent_std(text),
    }
    return {name: column.cast("double") for name, column in columns.items()}
