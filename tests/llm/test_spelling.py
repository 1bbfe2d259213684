import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stylograin.llm import spelling
from stylograin.llm.queries import QUERIES

LETTERS = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute(counts, ratio=10):
    """(word, form, root, n, n_near, form_n) of each word."""
    def edits(w):
        made = {w[:i] + w[i + 1:] for i in range(len(w))}
        for c in LETTERS:
            made |= {w[:i] + c + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1)}
        return made - {w}

    near = {w: [x for x in edits(w) if x in counts] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def found(words, **options):
    df = spelling.spelling_variants(words, **options)
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("most_bytes", [32 << 20, 200])
def test_equals_brute_force(spark, most_bytes):
    rng = random.Random(3)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 9)))
        counts[w] = rng.choice([2, 30, 400, 5000])
        for _ in range(8):  # variants, some of variants
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice("abzÿ") + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice("Àbé") + w[k + 1:]])
            if len(w) >= 7:
                counts.setdefault(w, rng.choice([2, 3, 20, 300, 4000]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(words, most_bytes=most_bytes) == brute(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaaaaa": 100_000, "aaaaaaab": 10_000, "aaaaaabb": 1_000, "aaaaabbb": 100, "aaaabbbb": 10, "aaabbbbb": 2,
              "wwwwwww": 2, "wwwwwwx": 20, "wwwwwwy": 20, "wwwwwwww": 19}
    got = found(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got == brute(counts)
    assert {r[0]: r[2] for r in got}["aaaabbbb"] == "aaaaaaaa" and {r[0]: r[1] for r in got}["wwwwwww"] == "wwwwwwx"


def test_very_long_words(spark):
    long = "ab" * 20_000
    counts = {long: 50, long[:-1]: 2, long[:-2] + "xb": 3, "q" * 300: 40, "q" * 299: 2}
    got = {r[0]: r[1] for r in found(spark.createDataFrame(list(counts.items()), "word string, n long"))}
    assert got == {long: None, long[:-1]: long, long[:-2] + "xb": long, "q" * 300: None, "q" * 299: "q" * 300}


def test_words_of_awkward_texts(awkward, nothing):
    words = spelling.vocabulary(awkward.withColumn("word", F.lit("x")).withColumn("_run", F.lit(1)), least_length=4, least_count=2)
    assert {r.word: r.n for r in words.collect()} == {"three": 4, "four": 4, "five": 4}
    assert found(spelling.vocabulary(nothing)) == []


def test_query_on_a_small_table(spark, tmp_path):
    rng = random.Random(5)
    stems = ["Régulier", "national", "straßen", "WORKING", "variant", "château", "ungewöhnlich", "naïveté×x", "short"]
    rows = [(k if k % 9 else None, " ".join(rng.choice(stems) for _ in range(80)) + f"\tx{k}") for k in range(60)] + [(1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] = counts.get(w, 0) + 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = QUERIES["op13_spelling_variants"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == want
    assert any(r[1] for r in want)
