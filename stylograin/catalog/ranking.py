"""Ranked lists and sorted reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.joins import TOKENS_SQL, tokens
from stylograin.catalog.metrics import COUNT_SQL, CUTS_SQL, by_cut, conf_sql
from stylograin.catalog.registry import query
from stylograin.catalog.tables import DOCS_SQL, JUDGED_SQL, SAMPLES_SQL, SCORED_SQL, Tables
from stylograin.functions.arrays import first_distinct
from stylograin.operators import metrics as m
from stylograin.operators import ranking as r
from stylograin.operators import terms

TOTALS_SQL = f"""{DOCS_SQL}, w AS (SELECT sample_id, unnest({TOKENS_SQL}) AS term FROM docs),
  totals AS (SELECT term, count(*) AS tf, count(DISTINCT sample_id) AS df FROM w GROUP BY 1)"""

# How much more often a term is used in one class than in the other, per language.
LEAN_SQL = SAMPLES_SQL + """, w AS (SELECT language, label, unnest(""" + TOKENS_SQL + """) AS term FROM samples WHERE label IS NOT NULL),
  lean AS (SELECT {by} term, (count(*) FILTER (label = 1) - 5 * count(*) FILTER (label = 0))::BIGINT AS score
    FROM w GROUP BY {by} term)"""


def lean(t: Tables, *by: str):
    rows = t.labelled().select(*by, "label", F.explode(tokens()).alias("term"))
    score = F.count_if(F.col("label") == 1) - 5 * F.count_if(F.col("label") == 0)
    return rows.groupBy(*by, "term").agg(score.alias("score"))


@query("w01_ranked_importance", f"""WITH {TOTALS_SQL} SELECT term, tf, df,
  CAST(row_number() OVER (ORDER BY tf DESC, term) AS INTEGER) AS rank FROM totals QUALIFY rank <= 500""")
def ranked_importance(t: Tables):
    return r.ranked(terms.term_totals(t.documents(), tokens()), "tf", 500)


@query("w02_top_k", f"WITH {TOTALS_SQL} SELECT term, tf, df FROM totals ORDER BY tf DESC, term LIMIT 20")
def top_k(t: Tables):
    return r.top_k(terms.term_totals(t.documents(), tokens()), "tf", 20)


@query("w03_two_sided_top_k", f"""WITH {LEAN_SQL.replace('{by}', '')} SELECT 'high' AS side, term, score,
    CAST(row_number() OVER (ORDER BY score DESC, term) AS INTEGER) AS rank FROM lean QUALIFY rank <= 15
  UNION ALL SELECT 'low', term, score, CAST(row_number() OVER (ORDER BY score, term) AS INTEGER) AS rank FROM lean QUALIFY rank <= 15""")
def two_sided_top_k(t: Tables):
    return r.two_sided(lean(t), "score", 15)


@query("w04_top_k_per_language", f"""WITH {LEAN_SQL.replace('{by}', 'language,')} SELECT language, 'high' AS side, term, score,
    CAST(row_number() OVER (PARTITION BY language ORDER BY score DESC, term) AS INTEGER) AS rank FROM lean QUALIFY rank <= 5
  UNION ALL SELECT language, 'low', term, score,
    CAST(row_number() OVER (PARTITION BY language ORDER BY score, term) AS INTEGER) AS rank FROM lean QUALIFY rank <= 5""")
def top_k_per_language(t: Tables):
    return r.two_sided(lean(t, "language"), "score", 5, ["language"])


@query("w05_first_distinct_items", f"""WITH {DOCS_SQL}, w AS (SELECT sample_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos
    FROM (SELECT sample_id, {TOKENS_SQL} AS t FROM docs)),
  f AS (SELECT sample_id, term, min(pos) AS pos FROM w GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS i FROM f QUALIFY i <= 64)
  SELECT sample_id, count(*) AS n, string_agg(term, ' ' ORDER BY pos) AS items FROM k GROUP BY 1""")
def first_distinct_items(t: Tables):
    items = t.documents().select("sample_id", first_distinct(tokens(), 64).alias("items")).where(F.size("items") > 0)
    return items.select("sample_id", F.size("items").cast("bigint").alias("n"), F.array_join("items", " ").alias("items"))


CUT_RESULTS_SQL = f"""{SCORED_SQL}, {CUTS_SQL}, {conf_sql('model', 'many')},
  r AS (SELECT model, {COUNT_SQL['macro_f1']} AS f FROM conf)"""


def cut_results(t: Tables):
    return m.confusion_counts(by_cut(t), ["model"]).select("model", m.count_metrics()["macro_f1"].alias("macro_f1"))


@query("w06_gain_over_first", f"""WITH {CUT_RESULTS_SQL} SELECT model, round(f, 6) AS macro_f1,
  round(f - first_value(f) OVER (ORDER BY model), 6) AS gain_over_first,
  round(f - lag(f) OVER (ORDER BY model), 6) AS gain_over_previous FROM r""")
def gain_over_first(t: Tables):
    return r.gain_over_first(cut_results(t), "macro_f1", "model")


@query("w07_above_mean", f"""WITH {TOTALS_SQL}, top AS (SELECT term, tf FROM totals ORDER BY tf DESC, term LIMIT 20)
  SELECT term, tf, tf > avg(tf) OVER () AS above_mean FROM top""")
def above_mean(t: Tables):
    top = r.top_k(terms.term_totals(t.documents(), tokens()), "tf", 20).select("term", "tf")
    return top.withColumn("above_mean", r.above_mean(top, "tf"))


@query("w08_sorted_report", f"""WITH {JUDGED_SQL} SELECT language, generator, count(*) AS n, round(avg(correct), 6) AS rate
  FROM judged GROUP BY 1, 2 ORDER BY rate, language, generator""")
def sorted_report(t: Tables):
    return t.judged().groupBy("language", "generator").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("rate")).orderBy("rate", "language", "generator")
