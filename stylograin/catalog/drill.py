"""Drill-down by producer over labelled documents with a rule prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.columns import FAMILIES, FAMILY_SQL
from stylograin.catalog.registry import query
from stylograin.catalog.tables import JUDGED_SQL, LANGS, Tables
from stylograin.operators import drill as d

STATS_SQL = f"""{JUDGED_SQL}, stats AS (SELECT generator, count(*) AS n_samples, avg(correct) AS rate,
  string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM judged WHERE label = 1 GROUP BY 1)"""


@query("g01_detection_by_generator", f"""WITH {STATS_SQL} SELECT generator, n_samples,
  round(rate, 6) AS detection_rate, languages FROM stats""")
def detection_by_generator(t: Tables):
    return d.detection_by_generator(t.judged())


@query("g02_detected_by_generator", f"""WITH {JUDGED_SQL}, l AS (SELECT generator, language, count(*) AS n FROM judged
    WHERE label = 1 GROUP BY 1, 2),
  top AS (SELECT generator, language AS main_language FROM l
    QUALIFY row_number() OVER (PARTITION BY generator ORDER BY n DESC, language) = 1)
  SELECT generator, count(*) AS total, sum(correct)::BIGINT AS detected,
    round(avg(correct), 6) AS detection_rate, any_value(main_language) AS main_language
  FROM judged JOIN top USING (generator) WHERE label = 1 GROUP BY 1 HAVING count(*) >= 3""")
def detected_by_generator(t: Tables):
    return d.detected_by_generator(t.judged())


@query("g03_detection_by_family", f"""WITH {JUDGED_SQL} SELECT {FAMILY_SQL} AS family, count(*) AS total,
  sum(correct)::BIGINT AS detected, round(avg(correct), 6) AS detection_rate FROM judged WHERE label = 1
  GROUP BY 1 HAVING count(*) >= 2""")
def detection_by_family(t: Tables):
    return d.detection_by_family(t.judged(), FAMILIES)


@query("g04_length_by_generator", f"""WITH {JUDGED_SQL} SELECT generator, round(avg(words), 6) AS mean_length,
  round(avg(correct), 6) AS detection_rate, count(*) AS total FROM judged WHERE label = 1
  GROUP BY 1 HAVING count(*) >= 3""")
def length_by_generator(t: Tables):
    return d.length_by_generator(t.judged(), length=F.col("words"))


@query("g05_generator_language_matrix", f"""WITH {JUDGED_SQL} SELECT generator, """ + ", ".join(
    f"round(coalesce(avg(correct) FILTER (language = '{v}'), 0), 6) AS rate_{v}, count(*) FILTER (language = '{v}') AS n_{v}"
    for v in LANGS) + " FROM judged WHERE label = 1 GROUP BY 1 HAVING count(*) >= 3")
def generator_language_matrix(t: Tables):
    return d.generator_language_matrix(t.judged(), LANGS)


@query("g06_extremes", f"""WITH {STATS_SQL} SELECT sum(n_samples)::BIGINT AS n_machine, count(*) AS n_generators,
  count(*) FILTER (rate >= 0.5) AS n_easy, count(*) FILTER (rate < 0.5) AS n_hard,
  first(generator ORDER BY rate, generator) AS hardest, round(min(rate), 6) AS hardest_rate,
  first(generator ORDER BY rate DESC, generator DESC) AS easiest, round(max(rate), 6) AS easiest_rate FROM stats""")
def extremes(t: Tables):
    return d.extremes(d.detection_by_generator(t.judged()))


@query("g07_example_rows", f"""WITH {STATS_SQL},
  h AS (SELECT generator FROM stats ORDER BY rate, generator LIMIT 1),
  e AS (SELECT generator FROM stats ORDER BY rate DESC, generator DESC LIMIT 1)
  (SELECT 'hardest missed' AS "case", sample_id, generator, language FROM judged
    WHERE label = 1 AND correct = 0 AND generator = (SELECT generator FROM h) ORDER BY sample_id LIMIT 1)
  UNION ALL (SELECT 'easiest detected', sample_id, generator, language FROM judged
    WHERE label = 1 AND correct = 1 AND generator = (SELECT generator FROM e) ORDER BY sample_id LIMIT 1)""")
def example_rows(t: Tables):
    judged = t.judged()
    return d.example_rows(judged, d.detection_by_generator(judged)).select(
        "case", "sample_id", "generator", "language")
