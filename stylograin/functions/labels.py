"""Names, class labels, flags and rule predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages a detector was trained on.
SEEN_LANGUAGES = ["Python", "Java", "C++"]

# Generator name -> model family.
GENERATOR_FAMILIES = {
    "GPT-4o": "OpenAI GPT-4",
    "gpt-4o": "OpenAI GPT-4",
    "DeepSeek-V3-0324": "DeepSeek",
    "Llama-4-Scout-17B-16E-Instruct": "Meta Llama-4",
    "Llama-3.1-8B-Instruct": "Meta Llama-3",
    "Llama-3.3-70B-Instruct": "Meta Llama-3",
    "Yi-Coder-9B-Chat": "Yi-Coder",
    "Qwen2.5-Coder-1.5B-Instruct": "Qwen Coder",
    "Mistral-Small-24B-Instruct-2501": "Mistral",
    "gemini-2.0-flash": "Google Gemini",
    "Phi-3-medium-4k-instruct": "Microsoft Phi",
    "Phi-3.5-mini-instruct": "Microsoft Phi",
    "phi-2": "Microsoft Phi",
    "starcoder": "StarCoder",
    "starcoder2-15b": "StarCoder",
    "CodeLlama-70b-Instruct-hf": "CodeLlama",
}

# Text markers of machine-written code (docstrings, type hints).
MACHINE_MARKERS = ['"""', "'''", "->", ": int", ": str"]


def setting(language: Column, seen: Sequence[str] = SEEN_LANGUAGES) -> Column:
    """``Seen`` or ``Unseen``."""
    return F.when(language.isin(list(seen)), "Seen").otherwise("Unseen")


def class_name(label: Column) -> Column:
    """0 is Human, anything else is Machine."""
    return F.when(label == 0, "Human").otherwise("Machine")


def short_name(name: Column) -> Column:
    """Trimmed name, only what follows its last slash."""
    return F.substring_index(F.trim(name), "/", -1)


def lookup(key: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a small fixed table; a missing key gives ``default``, or the key itself."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    fallback = key if default is None else F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), fallback) if pairs else fallback


def has_any(text: Column, markers: Sequence[str]) -> Column:
    """True if any marker occurs; a null text holds none."""
    found = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])
    return F.coalesce(found, F.lit(False))


def rule_prediction(text: Column, markers: Sequence[str] = MACHINE_MARKERS) -> Column:
    """1 (machine) if any marker occurs in the text, else 0."""
    return has_any(text, markers).cast("int")


def correct(label: Column, pred: Column) -> Column:
    return (label == pred).cast("int")


def outcome(label: Column, pred: Column) -> Column:
    """TP, FP, FN or TN."""
    return (F.when((label == 1) & (pred == 1), "TP").when(label == 1, "FN")
            .when(pred == 1, "FP").otherwise("TN"))


def preview(text: Column, lines: int = 30) -> Column:
    """The first lines of a text and a note on how many more there are."""
    rows = F.split(F.trim(text), "\n")
    more = F.size(rows) - lines
    note = F.concat(F.lit("\n... ["), more.cast("string"), F.lit(" more lines]"))
    return F.concat(F.array_join(F.slice(rows, 1, lines), "\n"), F.when(more > 0, note).otherwise(""))
