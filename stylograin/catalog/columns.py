"""Projections, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.registry import query
from stylograin.catalog.tables import (DOCS_SQL, JUDGED_SQL, MARKERS, RULE_SQL, SAMPLES_SQL, SCORED_SQL, SEEN,
                                       WORDS_SQL, Tables)
from stylograin.functions import labels as c
from stylograin.functions.text import word_count
from stylograin.operators.terms import term_totals
from stylograin.functions.text import words
from stylograin.operators.metrics import ratio

FAMILIES = {f"src{i}": f"family {i % 3}" for i in range(12)}
FAMILY_SQL = "CASE WHEN generator IN ({}) THEN 'family ' || (CAST(substr(generator, 4) AS INTEGER) % 3) ELSE 'Other' END".format(
    ", ".join(f"'src{i}'" for i in range(12)))


@query("p01_equality_filter", "SELECT doc_id AS sample_id, n_chars FROM documents WHERE lang = 'en'")
def equality_filter(t: Tables):
    return t.listing().where(F.col("language") == "en").select("sample_id", "n_chars")


@query("p02_class_filter", f"WITH {SAMPLES_SQL} SELECT sample_id, language, generator FROM samples WHERE label = 1")
def class_filter(t: Tables):
    return t.labelled_listing().where(F.col("label") == 1).select("sample_id", "language", "generator")


@query("p03_membership_filter", f"""WITH {JUDGED_SQL} SELECT sample_id, language, label, pred FROM judged
  WHERE language IN ('en', 'fr') AND label = 1 AND pred = 0""")
def membership_filter(t: Tables):
    return t.judged().where(F.col("language").isin(SEEN) & (F.col("label") == 1) & (F.col("pred") == 0)).select(
        "sample_id", "language", "label", "pred")


@query("p04_contains_filter", """SELECT contains(text, '###') AS has_mark, count(*) AS n,
  sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1""")
def contains_filter(t: Tables):
    return t.documents().groupBy(c.has_any(F.col("code"), ["###"]).alias("has_mark")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("p05_length_between", """SELECT doc_id AS sample_id, length(text)::INTEGER AS len FROM documents
  WHERE length(text) BETWEEN 200 AND 800""")
def length_between(t: Tables):
    return t.documents().select("sample_id", F.length("code").alias("len")).where(F.col("len").between(200, 800))


@query("p06_outlier_filter", f"""WITH {DOCS_SQL} SELECT sample_id, {WORDS_SQL}::INTEGER AS words FROM docs
  WHERE {WORDS_SQL} > 2000""")
def outlier_filter(t: Tables):
    return t.documents().select("sample_id", word_count(F.col("code")).alias("words")).where(F.col("words") > 2000)


@query("p07_seen_unseen_tag", """SELECT CASE WHEN lang IN ('en', 'fr') THEN 'Seen' ELSE 'Unseen' END AS setting,
  count(*) AS n FROM documents GROUP BY 1""")
def seen_unseen(t: Tables):
    return t.listing().groupBy(c.setting(F.col("language"), SEEN).alias("setting")).agg(F.count(F.lit(1)).alias("n"))


@query("p08_label_naming", f"""WITH {SAMPLES_SQL} SELECT sample_id,
  CASE label WHEN 0 THEN 'Human' ELSE 'Machine' END AS class_name FROM samples WHERE label IS NOT NULL""")
def label_naming(t: Tables):
    return t.labelled_listing().select("sample_id", c.class_name(F.col("label")).alias("class_name"))


@query("p09_name_cleaning", r"""SELECT page_id, list_last(string_split(trim(url), '/')) AS short_name FROM pages""")
def name_cleaning(t: Tables):
    return t.table("pages").select("page_id", c.short_name(F.col("url")).alias("short_name"))


@query("p10_lookup_with_default", f"""WITH {DOCS_SQL} SELECT {FAMILY_SQL} AS family, count(*) AS n FROM docs GROUP BY 1""")
def lookup_with_default(t: Tables):
    return t.listing().groupBy(c.lookup(F.col("generator"), FAMILIES, "Other").alias("family")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p11_correctness_flag", f"""WITH {SCORED_SQL} SELECT sample_id, CAST(y = pred AS INTEGER) AS correct FROM scored""")
def correctness_flag(t: Tables):
    return t.scored().select("sample_id", c.correct(F.col("y"), F.col("pred")).alias("correct"))


@query("p12_rule_classifier", f"WITH {DOCS_SQL} SELECT sample_id, {RULE_SQL} AS pred FROM docs")
def rule_classifier(t: Tables):
    return t.documents().select("sample_id", c.rule_prediction(F.col("code"), MARKERS).alias("pred"))


@query("p13_outcome_counts", f"""WITH {SCORED_SQL} SELECT CASE WHEN y = 1 AND pred = 1 THEN 'TP' WHEN y = 1 THEN 'FN'
  WHEN pred = 1 THEN 'FP' ELSE 'TN' END AS outcome, count(*) AS n FROM scored GROUP BY 1""")
def outcome_counts(t: Tables):
    return t.scored().groupBy(c.outcome(F.col("y"), F.col("pred")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_minimum_support", f"""WITH {SAMPLES_SQL} SELECT generator, language, count(*) AS n FROM samples
  WHERE label = 1 GROUP BY 1, 2 HAVING count(*) >= 3""")
def minimum_support(t: Tables):
    return t.labelled_listing().where(F.col("label") == 1).groupBy("generator", "language").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= 3)


@query("p15_two_class_guard", f"""WITH {SAMPLES_SQL} SELECT generator, language, count(*) AS n FROM samples
  WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT label) = 2""")
def two_class_guard(t: Tables):
    return t.labelled_listing().groupBy("generator", "language").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(
        F.col("lo") != F.col("hi")).select("generator", "language", "n")


@query("p16_noise_share", r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS term FROM documents),
  t AS (SELECT term, count(*) AS tf FROM w GROUP BY 1 ORDER BY tf DESC, term LIMIT 200)
  SELECT count(*) FILTER (contains(lower(term), 'en')) AS n_flagged,
  round(sum(tf) FILTER (contains(lower(term), 'en')) / sum(tf), 6) AS flagged_share FROM t""")
def noise_share(t: Tables):
    top = term_totals(t.documents(), words(F.col("code"))).orderBy(F.desc("tf"), "term").limit(200)
    flag = F.contains(F.lower("term"), F.lit("en"))
    return top.agg(F.count_if(flag).alias("n_flagged"),
                   ratio(F.sum(F.when(flag, F.col("tf"))), F.sum("tf")).alias("flagged_share"))


@query("p17_text_preview", r"""WITH l AS (SELECT doc_id, string_split(trim(text, ' '), chr(10)) AS rows FROM documents)
  SELECT doc_id AS sample_id, array_to_string(list_slice(rows, 1, 3), chr(10)) ||
  CASE WHEN len(rows) > 3 THEN chr(10) || '... [' || (len(rows) - 3) || ' more lines]' ELSE '' END AS preview FROM l""")
def text_preview(t: Tables):
    return t.documents().select("sample_id", c.preview(F.col("code"), 3).alias("preview"))
