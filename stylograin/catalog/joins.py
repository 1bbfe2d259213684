"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.metrics import COUNT_SQL, CUTS_SQL, by_cut, conf_sql
from stylograin.catalog.registry import query
from stylograin.catalog.tables import DOCS_SQL, NODES_SQL, SCORED_SQL, Tables
from stylograin.functions.text import words
from stylograin.operators import joins as j
from stylograin.operators import metrics as m
from stylograin.operators import terms
from stylograin.operators.trees import shape_features

TOKENS_SQL = r"regexp_extract_all(code, '[\p{L}\p{N}_]+')"
TAG_GROUPS = {"ul": "list", "li": "list", "div": "box", "article": "box", "p": "text", "h1": "text"}
GROUP_SQL = "CASE {0} WHEN 'ul' THEN 'list' WHEN 'li' THEN 'list' WHEN 'div' THEN 'box' WHEN 'article' THEN 'box' WHEN 'p' THEN 'text' WHEN 'h1' THEN 'text' ELSE {0} END"


def tokens():
    return words(F.col("code"))


def part(t: Tables, split: str):
    return t.documents().where(F.col("split") == split)


def listed(t: Tables, split: str):
    return t.listing().where(F.col("split") == split)


def vocab_sql(name: str, where: str, limit: int, min_df: int = 1) -> str:
    return f"""{name}_w AS (SELECT sample_id, unnest({TOKENS_SQL}) AS term FROM docs WHERE {where}),
  {name} AS (SELECT term, count(*) AS tf, count(DISTINCT sample_id) AS df FROM {name}_w GROUP BY 1
    HAVING count(DISTINCT sample_id) >= {min_df} ORDER BY tf DESC, term LIMIT {limit})"""


@query("j01_leakage", f"""WITH {DOCS_SQL} SELECT count(*) AS n_rows, count(*) FILTER (code IN (
  SELECT code FROM docs WHERE split = 'train')) AS n_leaked FROM docs WHERE split = 'val'""")
def leakage(t: Tables):
    return j.leaked_rows(part(t, "val"), part(t, "train"), "code")


@query("j02_distribution_alignment", f"""WITH {DOCS_SQL}, a AS (SELECT language, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS s
    FROM docs WHERE split = 'train' GROUP BY 1),
  b AS (SELECT language, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS s FROM docs WHERE split = 'ood' GROUP BY 1)
  SELECT coalesce(a.language, b.language) AS language, round(coalesce(a.s, 0), 6) AS pct_a,
  round(coalesce(b.s, 0), 6) AS pct_b FROM a FULL JOIN b ON a.language = b.language""")
def distribution_alignment(t: Tables):
    return j.aligned_shares(listed(t, "train"), listed(t, "ood"), "language")


@query("j03_vocabulary_overlap", f"""WITH {DOCS_SQL}, {vocab_sql('a', "split = 'train'", 2000, 5)},
  {vocab_sql('b', "split = 'ood'", 2000, 5)} SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
  count(*) AS n_shared, round(count(*) / (SELECT count(*) FROM a), 6) AS share_of_a FROM a JOIN b USING (term)""")
def vocabulary_overlap(t: Tables):
    a, b = (terms.vocabulary(part(t, s), tokens(), 5, 2000) for s in ("train", "ood"))
    return j.vocabulary_overlap(a, b)


@query("j04_vocabulary_lookup", f"""WITH {DOCS_SQL}, {vocab_sql('a', "split = 'train'", 2000, 5)},
  w AS (SELECT sample_id, unnest({TOKENS_SQL}) AS term FROM docs WHERE split = 'ood')
  SELECT sample_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM a) GROUP BY 1, 2""")
def vocabulary_lookup(t: Tables):
    vocab = terms.vocabulary(part(t, "train"), tokens(), 5, 2000)
    return terms.counts_in_vocabulary(part(t, "ood"), tokens(), vocab.select("term"), 2000)


@query("j05_type_map_lookup", f"""WITH {NODES_SQL} SELECT {GROUP_SQL.format('parent_type')} AS parent_type,
  {GROUP_SQL.format('type')} AS type, count(*) AS n FROM nodes WHERE parent_type IS NOT NULL GROUP BY 1, 2""")
def type_map_lookup(t: Tables):
    edges = t.nodes().where(F.col("parent_type").isNotNull()).select("parent_type", "type")
    return j.mapped_ends(edges, TAG_GROUPS).groupBy("parent_type", "type").agg(F.count(F.lit(1)).alias("n"))


@query("j06_feature_fusion", f"""WITH {NODES_SQL}, s AS (SELECT sample_id, count(*)::DOUBLE AS total_nodes,
    max(depth)::DOUBLE AS max_depth FROM nodes GROUP BY 1)
  SELECT sample_id, total_nodes, max_depth, length(html)::DOUBLE AS num_chars FROM s JOIN pages ON page_id = sample_id""")
def feature_fusion(t: Tables):
    trees = shape_features(t.nodes()).select("sample_id", "total_nodes", "max_depth")
    texts = t.pages().select("sample_id", F.length("code").cast("double").alias("num_chars"))
    return trees.join(texts, "sample_id")


@query("j07_variant_comparison", f"""WITH {SCORED_SQL}, {CUTS_SQL}, {conf_sql('model, grp', 'many')},
  r AS (SELECT model, grp, {COUNT_SQL['macro_f1']} AS f FROM conf)
  SELECT a.grp, round(a.f, 6) AS value_a, round(b.f, 6) AS value_b, round(b.f - a.f, 6) AS gain,
  CASE WHEN b.f - a.f > 0.05 THEN ' ★' WHEN b.f - a.f < -0.02 THEN ' ↓' ELSE '' END AS mark
  FROM r a JOIN r b ON a.grp = b.grp WHERE a.model = '1 low cut' AND b.model = '3 high cut'""")
def variant_comparison(t: Tables):
    rows = m.confusion_counts(by_cut(t), ["model", "grp"]).select(
        "model", "grp", m.count_metrics()["macro_f1"].alias("f"))
    a, b = (rows.where(F.col("model") == name) for name in ("1 low cut", "3 high cut"))
    return m.variant_comparison(a, b, "grp", "f")


@query("j08_parent_of", f"""WITH {NODES_SQL} SELECT sample_id, node_id::INTEGER AS node_id,
  parent_id::INTEGER AS parent_id, parent_type, type, depth::INTEGER AS depth FROM nodes""")
def parent_of(t: Tables):
    return t.nodes().select("sample_id", "node_id", "parent_id", "parent_type", "type", "depth")


@query("u01_union_all", f"""WITH {DOCS_SQL} SELECT 'train' AS part, sample_id FROM docs WHERE split = 'train'
  UNION ALL SELECT 'val', sample_id FROM docs WHERE split = 'val'""")
def union_all(t: Tables):
    return listed(t, "train").select(F.lit("train").alias("part"), "sample_id").unionByName(
        listed(t, "val").select(F.lit("val").alias("part"), "sample_id"))


@query("u02_key_union", f"""WITH {DOCS_SQL} SELECT language FROM docs WHERE split = 'train'
  UNION SELECT language FROM docs WHERE split = 'ood'""")
def key_union(t: Tables):
    return listed(t, "train").select("language").union(listed(t, "ood").select("language")).distinct()


@query("u03_vocabulary_intersection", f"""WITH {DOCS_SQL}, {vocab_sql('a', "split = 'train'", 2000, 5)},
  {vocab_sql('b', "split = 'ood'", 2000, 5)} SELECT term FROM a INTERSECT SELECT term FROM b""")
def vocabulary_intersection(t: Tables):
    a, b = (terms.vocabulary(part(t, s), tokens(), 5, 2000).select("term") for s in ("train", "ood"))
    return a.intersect(b)


@query("u04_distinct_values", "SELECT DISTINCT lang AS language, source AS generator FROM documents")
def distinct_values(t: Tables):
    return t.listing().select("language", "generator").distinct()
