"""Samples, splits and folds."""

from __future__ import annotations

from stylograin.catalog.registry import query
from stylograin.catalog.tables import DOCS_SQL, SAMPLES_SQL, Tables
from stylograin.operators import sampling as s

KEY = "md5(sample_id || ':42') || sample_id"


@query("g08_proportional_sample", f"""WITH {DOCS_SQL}, r AS (SELECT sample_id, language, split,
    row_number() OVER (PARTITION BY language, split ORDER BY {KEY}) AS i,
    count(*) OVER (PARTITION BY language, split) AS n, count(*) OVER () AS total FROM docs)
  SELECT sample_id, language, split FROM r WHERE i <= least(n, greatest(1, floor(200 * n / total)))
  ORDER BY {KEY} LIMIT 200""")
def proportional_sample(t: Tables):
    return s.proportional_sample(t.listing().select("sample_id", "language", "split"), 200, ["language", "split"])


@query("g09_sample_per_language", f"""WITH {DOCS_SQL} SELECT sample_id, language FROM docs
  QUALIFY row_number() OVER (PARTITION BY language ORDER BY {KEY}) <= 120""")
def sample_per_language(t: Tables):
    return s.sample_per_group(t.listing().select("sample_id", "language"), 120, ["language"])


@query("g10_stratified_split", f"""WITH {SAMPLES_SQL} SELECT sample_id, label, CASE WHEN
  row_number() OVER (PARTITION BY label ORDER BY {KEY}) <= round(0.2 * count(*) OVER (PARTITION BY label))
  THEN 'test' ELSE 'train' END AS part FROM samples WHERE label IS NOT NULL""")
def stratified_split(t: Tables):
    return s.stratified_split(t.labelled_listing().select("sample_id", "label"), "label")


@query("g11_simple_sample", f"WITH {DOCS_SQL} SELECT sample_id, language FROM docs ORDER BY {KEY} LIMIT 300")
def simple_sample(t: Tables):
    return s.simple_sample(t.listing().select("sample_id", "language"), 300)


@query("g12_folds", f"""WITH {SAMPLES_SQL}, r AS (SELECT sample_id, label,
  row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS i, count(*) OVER (PARTITION BY label) AS n
  FROM samples WHERE label IS NOT NULL)
  SELECT sample_id, label, (i > floor(n / 3))::INTEGER + (i > floor(n * 2 / 3))::INTEGER AS fold FROM r""")
def folds(t: Tables):
    return s.folds(t.labelled_listing().select("sample_id", "label"), "label")
