"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.registry import query
from stylograin.catalog.tables import DOCS_SQL, LANGS, SAMPLES_SQL, WORDS_SQL, Tables
from stylograin.functions.text import surface_features, word_count, words
from stylograin.operators import profile as p



def length_in_words():
    return word_count(F.col("code"))


def labelled_lengths(t: Tables):
    """Labelled samples with their length in words, counted before the label join."""
    return t.with_labels(t.documents().withColumn("words", length_in_words()).drop("code"))


CLASSES = [0, 1]


@query("a01_value_counts", "SELECT source AS generator, count(*) AS n FROM documents GROUP BY 1")
def value_counts(t: Tables):
    return p.value_counts(t.listing(), "generator")


@query("a02_value_shares", f"""WITH {DOCS_SQL} SELECT split, language, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM docs GROUP BY 1, 2""")
def value_shares(t: Tables):
    return p.value_shares(t.listing(), "language", ["split"])


@query("a03_mean_length_per_class", f"""WITH {SAMPLES_SQL} SELECT label, count(*) AS n,
  round(avg({WORDS_SQL}), 6) AS mean_length FROM samples WHERE label IS NOT NULL GROUP BY 1""")
def mean_length_per_class(t: Tables):
    return p.mean_by(labelled_lengths(t), F.col("words"), "label", name="mean_length")


@query("a03_mean_length_per_language", f"""WITH {DOCS_SQL} SELECT language, count(*) AS n,
  round(avg({WORDS_SQL}), 6) AS mean_length FROM docs GROUP BY 1""")
def mean_length_per_language(t: Tables):
    return p.mean_by(t.documents(), length_in_words(), "language", name="mean_length")


@query("a03_mean_length_per_language_and_class", f"""WITH {SAMPLES_SQL} SELECT language, label,
  count(*) AS n, round(avg({WORDS_SQL}), 6) AS mean_length FROM samples WHERE label IS NOT NULL GROUP BY 1, 2""")
def mean_length_per_both(t: Tables):
    return p.mean_by(labelled_lengths(t), F.col("words"), "language", "label", name="mean_length")


@query("a04_describe_length", f"""WITH {DOCS_SQL}, l AS (SELECT {WORDS_SQL} AS words FROM docs)
  SELECT count(*) AS n, round(avg(words), 6) AS mean, round(stddev_samp(words), 6) AS std,
  min(words)::INTEGER AS min, max(words)::INTEGER AS max, quantile_cont(words, 0.25) AS q25,
  quantile_cont(words, 0.5) AS q50, quantile_cont(words, 0.75) AS q75 FROM l""")
def describe_length(t: Tables):
    return p.describe(t.documents().select(length_in_words().alias("words")), "words")


@query("a04_describe_score_by_type", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1""")
def describe_score(t: Tables):
    return p.describe(t.table("events").select("event_type", "value"), "value", ["event_type"])


@query("a05_duplicate_count", """SELECT count(*) AS n_rows,
  count(*) - count(DISTINCT text) AS n_duplicates FROM documents""")
def duplicate_count(t: Tables):
    return p.duplicate_count(t.documents(), "code")


@query("a06_crosstab", """SELECT source AS generator, {} FROM documents GROUP BY 1""".format(
    ", ".join(f"count(*) FILTER (lang = '{v}') AS n_{v}" for v in LANGS)))
def crosstab(t: Tables):
    return p.crosstab(t.listing(), "generator", "language", LANGS)


@query("a06_crosstab_class", f"""WITH {SAMPLES_SQL} SELECT generator, count(*) FILTER (label = 0) AS n_0,
  count(*) FILTER (label = 1) AS n_1 FROM samples WHERE label IS NOT NULL GROUP BY 1""")
def crosstab_class(t: Tables):
    return p.crosstab(t.labelled_listing(), "generator", "label", CLASSES)


@query("a07_crosstab_percent", f"""WITH {SAMPLES_SQL} SELECT language,
  round(100.0 * count(*) FILTER (label = 0) / count(*)::DOUBLE, 6) AS pct_0,
  round(100.0 * count(*) FILTER (label = 1) / count(*)::DOUBLE, 6) AS pct_1
  FROM samples WHERE label IS NOT NULL GROUP BY 1""")
def crosstab_percent(t: Tables):
    return p.crosstab_percent(t.labelled_listing(), "language", "label", CLASSES)


@query("a08_class_prior", f"""WITH {SAMPLES_SQL}, s AS (SELECT split, count(*) AS n,
  count(*) FILTER (label = 1) AS n_machine, count(*) FILTER (label = 0) AS n_human,
  avg(label::DOUBLE) AS p FROM samples WHERE label IS NOT NULL GROUP BY 1)
  SELECT split, n, n_machine, n_human, round(p, 6) AS machine_share,
  round(n_human / n_machine, 6) AS human_per_machine, round((1 - p) / p, 6) AS odds_against FROM s""")
def class_prior(t: Tables):
    return p.class_prior(t.labelled_listing(), "label", ["split"])


@query("a09_class_summary", f"""WITH {SAMPLES_SQL} SELECT label, count(*) AS n,
  round(avg({WORDS_SQL}), 6) AS mean, round(stddev_pop({WORDS_SQL}), 6) AS std
  FROM samples WHERE label IS NOT NULL GROUP BY 1""")
def class_summary(t: Tables):
    return p.class_summary(labelled_lengths(t), "words", "label")


@query("a10_density_histogram", f"""WITH {SAMPLES_SQL},
  v AS (SELECT label, {WORDS_SQL}::DOUBLE AS x FROM samples WHERE label IS NOT NULL),
  r AS (SELECT label, min(x) AS low, max(x) AS high, count(*) AS total FROM v GROUP BY 1),
  h AS (SELECT v.label, least(floor((x - low) / (high - low) * 40), 39)::INTEGER AS bin, count(*) AS n
    FROM v JOIN r USING (label) GROUP BY 1, 2)
  SELECT r.label, g.bin::INTEGER AS bin, round(low + g.bin * (high - low) / 40, 6) AS bin_low,
    coalesce(h.n, 0) AS n, round(coalesce(h.n, 0) / (total * ((high - low) / 40)), 6) AS density
  FROM r, range(40) g(bin) LEFT JOIN h ON h.label = r.label AND h.bin = g.bin""")
def density_histogram(t: Tables):
    return p.density_histogram(labelled_lengths(t).select("label", F.col("words").alias("x")), "x", 40, ["label"])


@query("a11_box_summary", f"""WITH {SAMPLES_SQL},
  v AS (SELECT language, label, {WORDS_SQL}::DOUBLE AS x FROM samples WHERE label IS NOT NULL),
  q AS (SELECT language, label, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50,
    quantile_cont(x, 0.75) AS q75 FROM v GROUP BY 1, 2)
  SELECT language, label, q25, q50, q75,
    coalesce(min(x) FILTER (x >= q25 - 1.5 * (q75 - q25) AND x <= q25), q25) AS whisker_low,
    coalesce(max(x) FILTER (x <= q75 + 1.5 * (q75 - q25) AND x >= q75), q75) AS whisker_high,
    count(*) FILTER (x < q25 - 1.5 * (q75 - q25) OR x > q75 + 1.5 * (q75 - q25)) AS n_outliers
  FROM v JOIN q USING (language, label) GROUP BY 1, 2, 3, 4, 5""")
def box_summary(t: Tables):
    return p.box_summary(labelled_lengths(t).select("language", "label", F.col("words").cast("double").alias("x")), "x",
                         ["language", "label"])


SURFACE_FOR_CORR = ["num_lines", "num_chars", "avg_line_length", "num_hash_comment", "num_words"]


@query("a12_correlations_surface", f"""WITH {DOCS_SQL}, f AS (SELECT
  (length(code) - length(replace(code, chr(10), '')) + 1)::DOUBLE AS num_lines, length(code)::DOUBLE AS num_chars,
  (length(replace(code, chr(10), '')))::DOUBLE / (length(code) - length(replace(code, chr(10), '')) + 1) AS avg_line_length,
  (length(code) - length(replace(code, '#', '')))::DOUBLE AS num_hash_comment, {WORDS_SQL}::DOUBLE AS num_words FROM docs)
  """ + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM f"
    for i, a in enumerate(SURFACE_FOR_CORR) for b in SURFACE_FOR_CORR[i + 1:]))
def correlations_surface(t: Tables):
    f = surface_features(F.col("code"))
    df = t.documents().select(*[f[n].alias(n) for n in SURFACE_FOR_CORR[:-1]],
                              length_in_words().cast("double").alias("num_words"))
    return p.correlations(df, SURFACE_FOR_CORR)


@query("a13_two_split_consistency", f"""WITH {SAMPLES_SQL} SELECT split, label, count(*) AS n,
  round(avg({WORDS_SQL}), 6) AS mean_length FROM samples
  WHERE label IS NOT NULL AND split IN ('train', 'val') GROUP BY 1, 2""")
def split_consistency(t: Tables):
    return p.mean_by(labelled_lengths(t).where(F.col("split").isin("train", "val")), F.col("words"), "split", "label",
                     name="mean_length")


@query("a14_length_profile", r"""SELECT min(n)::INTEGER AS min_tokens, max(n)::INTEGER AS max_tokens,
  round(avg(n), 6) AS mean_tokens
  FROM (SELECT len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents)""")
def length_profile(t: Tables):
    return p.length_profile(t.documents(), words(F.col("code")))


@query("a15_optional_feature_coverage", r"""WITH c AS (
  SELECT length(text) - length(replace(text, '#', '')) AS n FROM documents)
  SELECT round(avg(n), 6) AS mean_count, count(*) FILTER (n = 0) AS n_without,
  round(100.0 * count(*) FILTER (n = 0) / count(*)::DOUBLE, 6) AS pct_without FROM c""")
def optional_coverage(t: Tables):
    df = t.documents().select(F.length("code").alias("n"), F.length(F.replace("code", F.lit("#"), F.lit(""))).alias("m"))
    return p.coverage(df.select((F.col("n") - F.col("m")).alias("c")), F.col("c"))
