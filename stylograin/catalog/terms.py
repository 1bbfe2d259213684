"""Tokens, vocabularies and TF-IDF weights of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.joins import TOKENS_SQL, part, tokens, vocab_sql
from stylograin.catalog.registry import query
from stylograin.catalog.tables import DOCS_SQL, SAMPLES_SQL, Tables
from stylograin.functions import text as x
from stylograin.operators import terms as m
from stylograin.operators.grams import gram_totals

# Characters as a list, then slices of 3 to 5: a different route than the look-ahead.
CLEAN_SQL = r"regexp_replace(lower(code), '\s\s+', ' ', 'g')"


def grams_sql(lo: int, hi: int, src: str = "docs", where: str = "true") -> str:
    return f"""chars AS (SELECT sample_id, unnest(string_split({CLEAN_SQL}, '')) AS c,
      generate_subscripts(string_split({CLEAN_SQL}, ''), 1) AS i FROM {src} WHERE {where} AND length(code) > 0),
    runs AS (SELECT sample_id, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3,
      lead(c, 4) OVER w AS c4 FROM chars WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
    grams AS (""" + " UNION ALL ".join(
        f"SELECT sample_id, {' || '.join(['c', 'c1', 'c2', 'c3', 'c4'][:n])} AS term FROM runs WHERE {['c', 'c1', 'c2', 'c3', 'c4'][n - 1]} IS NOT NULL"
        for n in range(lo, hi + 1)) + ")"


@query("t01_word_tokens", f"""WITH {DOCS_SQL}, w AS (SELECT sample_id, unnest({TOKENS_SQL}) AS term FROM docs)
  SELECT sample_id, term, count(*) AS tf FROM w GROUP BY 1, 2""")
def word_tokens(t: Tables):
    return m.token_rows(t.documents(), tokens()).groupBy("sample_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("t02_words_and_bigrams", f"""WITH {DOCS_SQL}, l AS (SELECT sample_id, {TOKENS_SQL} AS t FROM docs),
  p AS (SELECT sample_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM l),
  b AS (SELECT sample_id, term || ' ' || lead(term) OVER (PARTITION BY sample_id ORDER BY i) AS term FROM p),
  a AS (SELECT sample_id, term FROM p UNION ALL SELECT sample_id, term FROM b WHERE term IS NOT NULL)
  SELECT term, count(*) AS tf, count(DISTINCT sample_id) AS df FROM a GROUP BY 1""")
def words_and_bigrams(t: Tables):
    return m.term_totals(t.documents(), x.words_and_bigrams(F.col("code")))


@query("t03_char_ngrams", f"""WITH {DOCS_SQL}, {grams_sql(3, 5)} SELECT term, count(*) AS tf,
  count(DISTINCT sample_id) AS df FROM grams GROUP BY 1""")
def char_ngrams(t: Tables):
    return gram_totals(t.documents(), F.col("code"))


@query("t05_vocabulary", f"WITH {DOCS_SQL}, {vocab_sql('v', "split = 'train'", 2000, 5)} SELECT term, tf, df FROM v")
def vocabulary(t: Tables):
    return m.vocabulary(part(t, "train"), tokens(), 5, 2000)


def idf_sql(limit: int, min_df: int, where: str = "split = 'train'") -> str:
    return f"""{vocab_sql('v', where, limit, min_df)},
      idf AS (SELECT term, df, ln((1 + (SELECT count(*) FROM docs WHERE {where})) / (1 + df)) + 1 AS idf FROM v)"""


@query("t06_idf", f"WITH {DOCS_SQL}, {idf_sql(2000, 5)} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf(t: Tables):
    train = part(t, "train")
    return m.with_idf(m.vocabulary(train, tokens(), 5, 2000), train).select("term", "df", "idf")


def weights_sql(limit: int, min_df: int, weight: str, src: str = "docs", keep: str = "") -> str:
    return f"""{idf_sql(limit, min_df)},
      tok AS (SELECT sample_id, {keep} unnest({TOKENS_SQL}) AS term FROM {src}),
      cnt AS (SELECT sample_id, {keep} term, count(*) AS tf, any_value(idf) AS idf FROM tok JOIN idf USING (term)
        GROUP BY sample_id, {keep} term),
      raw AS (SELECT *, {weight} AS w FROM cnt),
      weights AS (SELECT sample_id, {keep} term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS weight FROM raw)"""


@query("t07_term_weight_sublinear", f"""WITH {DOCS_SQL}, {weights_sql(2000, 5, '(1 + ln(tf)) * idf')}
  SELECT sample_id, term, tf, round(w, 6) AS weight FROM raw""")
def term_weight_sublinear(t: Tables):
    train = part(t, "train")
    vocab = m.with_idf(m.vocabulary(train, tokens(), 5, 2000), train)
    counted = m.counts_in_vocabulary(t.documents(), tokens(), vocab, 2000)
    return counted.select("sample_id", "term", "tf", m.term_weight(True).alias("weight"))


@query("t08_l2_norms", f"""WITH {DOCS_SQL}, {weights_sql(2000, 5, 'tf * idf')}
  SELECT sample_id, count(*) AS n_terms, round(sum(weight * weight), 6) AS squared_norm, round(max(weight), 6) AS top_weight
  FROM weights GROUP BY 1""")
def l2_norms(t: Tables):
    weights = m.tfidf(part(t, "train"), t.documents(), tokens(), 5, 2000)
    return weights.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum(F.col("weight") ** 2).alias("squared_norm"),
        F.max("weight").alias("top_weight"))


@query("t09_tfidf", f"""WITH {DOCS_SQL}, {weights_sql(2000, 5, 'tf * idf')}
  SELECT sample_id, term, tf, round(weight, 6) AS weight FROM weights""")
def tfidf(t: Tables):
    return m.tfidf(part(t, "train"), t.documents(), tokens(), 5, 2000)


@query("t09_tfidf_sublinear", f"""WITH {DOCS_SQL}, {weights_sql(2000, 5, '(1 + ln(tf)) * idf')}
  SELECT sample_id, term, tf, round(weight, 6) AS weight FROM weights""")
def tfidf_sublinear(t: Tables):
    return m.tfidf(part(t, "train"), t.documents(), tokens(), 5, 2000, sublinear=True)


@query("t10_coverage_by_language", f"""WITH {DOCS_SQL}, {grams_sql(3, 3)},
  v AS (SELECT term, count(*) AS tf FROM grams JOIN docs USING (sample_id) WHERE split = 'train' AND language = 'en'
    GROUP BY 1 ORDER BY tf DESC, term LIMIT 5000),
  h AS (SELECT sample_id, count(DISTINCT term) AS n FROM grams WHERE term IN (SELECT term FROM v) GROUP BY 1)
  SELECT language, count(*) AS n, round(avg(coalesce(h.n, 0) / (SELECT count(*) FROM v)), 6) AS coverage
  FROM docs LEFT JOIN h USING (sample_id) GROUP BY 1""")
def coverage_by_language(t: Tables):
    train = part(t, "train").where(F.col("language") == "en")
    return m.coverage_by_language(train, t.documents(), x.char_ngrams(F.col("code"), 3, 3), 5000)


CLASS_WEIGHTS_SQL = f"""{SAMPLES_SQL}, labelled AS (SELECT * FROM samples WHERE label IS NOT NULL),
  {weights_sql(2000, 5, 'tf * idf', 'labelled', 'label, language,')}"""


def class_weights(t: Tables):
    return m.tfidf(part(t, "train"), t.labelled(), tokens(), 5, 2000, keep=["label", "language"])


@query("t11_class_means", f"""WITH {CLASS_WEIGHTS_SQL}, n AS (SELECT count(*) FILTER (label = 0) AS n0,
    count(*) FILTER (label = 1) AS n1 FROM labelled),
  s AS (SELECT term, coalesce(sum(weight) FILTER (label = 0), 0) / any_value(n0) AS a,
    coalesce(sum(weight) FILTER (label = 1), 0) / any_value(n1) AS b FROM weights, n GROUP BY 1)
  SELECT term, round(a, 6) AS mean_human, round(b, 6) AS mean_machine, round(b - a, 6) AS difference FROM s""")
def class_means(t: Tables):
    return m.class_means(class_weights(t), t.labelled_listing())


@query("t12_class_means_per_language", f"""WITH {CLASS_WEIGHTS_SQL}, n AS (SELECT language, count(*) FILTER (label = 0) AS n0,
    count(*) FILTER (label = 1) AS n1 FROM labelled GROUP BY 1),
  s AS (SELECT language, term, coalesce(sum(weight) FILTER (label = 0), 0) / any_value(n0) AS a,
    coalesce(sum(weight) FILTER (label = 1), 0) / any_value(n1) AS b FROM weights JOIN n USING (language)
    WHERE n0 > 0 AND n1 > 0 GROUP BY 1, 2)
  SELECT language, term, round(a, 6) AS mean_human, round(b, 6) AS mean_machine, round(b - a, 6) AS difference FROM s""")
def class_means_per_language(t: Tables):
    return m.class_means(class_weights(t), t.labelled_listing(), by=["language"])
