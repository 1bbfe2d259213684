"""Trees built from the markup of the pages and the brackets of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylograin.catalog.joins import GROUP_SQL, TAG_GROUPS
from stylograin.catalog.registry import query
from stylograin.catalog.tables import NODES_SQL, PAGES_SQL, Tables
from stylograin.operators import terms
from stylograin.operators import trees as m
from stylograin.operators.profile import correlations
from stylograin.session import reused

DECISIONS = ["li", "p"]
CALL = "a"
ROLES = {"num_functions": ["article"], "num_loops": ["li", "ul"], "num_ifs": ["p"], "num_assign": ["a"],
         "num_return": ["h1", "title"]}
ERROR = "div"

# Names of the 18 features, grouped by the query that shows them.
DEPTH = ["max_depth", "avg_depth", "depth_var"]
SIZE = ["total_nodes", "leaf_nodes", "internal_nodes", "leaf_ratio"]
BRANCH = ["avg_branch", "max_children", "branch_variance"]
DECISION = ["decision_nodes", "cyclomatic"]
CALLS = ["function_calls", "unique_calls"]
TYPES = ["unique_types", "entropy"]

SHAPE_SQL = f"""{NODES_SQL},
type_p AS (SELECT sample_id, count(*) / sum(count(*)) OVER (PARTITION BY sample_id) AS p FROM nodes GROUP BY sample_id, type),
branch_p AS (SELECT sample_id, count(*) / sum(count(*)) OVER (PARTITION BY sample_id) AS p FROM nodes GROUP BY sample_id, n_children),
type_h AS (SELECT sample_id, count(*)::DOUBLE AS unique_types, -sum(p * ln(p + 1e-10)) AS entropy FROM type_p GROUP BY 1),
branch_h AS (SELECT sample_id, -sum(p * ln(p + 1e-10)) AS branch_entropy FROM branch_p GROUP BY 1),
plain AS (SELECT sample_id, count(*)::DOUBLE AS total_nodes, max(depth)::DOUBLE AS max_depth, avg(depth) AS avg_depth,
  var_pop(depth) AS depth_var, stddev_pop(depth) AS depth_std, count(*) FILTER (n_children = 0)::DOUBLE AS leaf_nodes,
  count(*) FILTER (n_children > 0)::DOUBLE AS internal_nodes,
  count(*) FILTER (n_children = 0) / (count(*) + 1e-9::DOUBLE) AS leaf_ratio, avg(n_children) AS avg_branch,
  max(n_children)::DOUBLE AS max_children, var_pop(n_children) AS branch_variance,
  count(*) FILTER (type IN ('li', 'p'))::DOUBLE AS decision_nodes, count(*) FILTER (type IN ('li', 'p')) + 1::DOUBLE AS cyclomatic,
  count(*) FILTER (contains(type, 'a'))::DOUBLE AS function_calls,
  count(DISTINCT CASE WHEN contains(type, 'a') THEN type END)::DOUBLE AS unique_calls,
  count(*) FILTER (type = 'article')::DOUBLE AS num_functions, count(*) FILTER (type IN ('li', 'ul'))::DOUBLE AS num_loops,
  count(*) FILTER (type = 'p')::DOUBLE AS num_ifs, count(*) FILTER (type = 'a')::DOUBLE AS num_assign,
  count(*) FILTER (type IN ('h1', 'title'))::DOUBLE AS num_return FROM nodes GROUP BY 1),
shape AS (SELECT *, CASE WHEN unique_types > 1 THEN entropy / ln(unique_types + 1e-10) ELSE 0 END AS norm_entropy
  FROM plain JOIN type_h USING (sample_id) JOIN branch_h USING (sample_id))"""


def shape_sql(names: list[str]) -> str:
    return f"WITH {SHAPE_SQL} SELECT sample_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM shape"


def shape(t: Tables, names: list[str]):
    return m.shape_features(t.nodes(), decisions=DECISIONS, call_mark=CALL).select("sample_id", *names)


BRACKET_SQL = r"""WITH found AS (SELECT doc_id AS sample_id, regexp_extract_all(text, '[\p{L}\p{N}_]*\s*[({\[]|[)}\]]') AS t FROM documents),
  marks AS (SELECT sample_id, unnest(t) AS mark, generate_subscripts(t, 1) - 1 AS pos FROM found),
  named AS (SELECT sample_id, pos, CASE WHEN regexp_matches(mark, '^[)}\]]') THEN -1 ELSE 1 END AS step,
    CASE WHEN regexp_matches(mark, '^[\p{L}\p{N}_]') THEN regexp_extract(mark, '^[\p{L}\p{N}_]+') ELSE right(mark, 1) END AS type FROM marks),
  placed AS (SELECT *, sum(step) OVER (PARTITION BY sample_id ORDER BY pos) - CASE WHEN step = 1 THEN 1 ELSE 0 END AS depth FROM named),
  opened AS (SELECT sample_id, pos, type, depth, depth - 1 AS above FROM placed WHERE step = 1),
  linked AS (SELECT c.sample_id, c.pos, c.type, c.depth, p.pos AS parent, p.type AS parent_type FROM opened c
    ASOF LEFT JOIN opened p ON c.sample_id = p.sample_id AND c.above = p.depth AND c.pos > p.pos),
  kids AS (SELECT sample_id, parent, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2)
  SELECT l.sample_id, l.pos::INTEGER AS node_id, l.parent::INTEGER AS parent_id, l.depth::INTEGER AS depth, l.type, l.parent_type,
    coalesce(n, 0)::INTEGER AS n_children FROM linked l LEFT JOIN kids k ON k.sample_id = l.sample_id AND k.parent = l.pos"""


@query("tr1_nesting_tree", f"WITH {NODES_SQL} SELECT sample_id, node_id::INTEGER AS node_id, depth::INTEGER AS depth, type, parent_type, n_children::INTEGER AS n_children FROM nodes")
def nesting_tree(t: Tables):
    return t.nodes().select("sample_id", "node_id", "depth", "type", "parent_type", "n_children")


@query("tr1_bracket_tree", BRACKET_SQL)
def bracket_tree(t: Tables):
    return m.nest(m.bracket_marks(t.documents(), "code")).select("sample_id", "node_id", "parent_id", "depth", "type", "parent_type", "n_children")


@query("tr1_bracket_tree_in_blocks", BRACKET_SQL)
def bracket_tree_in_blocks(t: Tables):
    return m.nest_in_blocks(m.bracket_marks(t.documents(), "code")).select(
        "sample_id", "node_id", "parent_id", "depth", "type", "parent_type", "n_children")


@query("tr1_nesting_tree_in_blocks", f"""WITH {NODES_SQL} SELECT sample_id, node_id::INTEGER AS node_id, parent_id::INTEGER AS parent_id, depth::INTEGER AS depth,
  type, parent_type, n_children::INTEGER AS n_children FROM nodes""")
def nesting_tree_in_blocks(t: Tables):
    """Blocks of 16 marks, so that most pages of the given tables span several."""
    pages = t.texts("pages", "page_id").select(F.col("page_id").alias("sample_id"), "html")
    return m.nest_in_blocks(m.markup_marks(pages, "html"), block=16).select(
        "sample_id", "node_id", "parent_id", "depth", "type", "parent_type", "n_children")


@query("tr2_missing_tree_as_zero", f"""WITH {SHAPE_SQL}, {PAGES_SQL} SELECT p.sample_id, p.language,
  coalesce(s.total_nodes, 0) AS total_nodes, round(coalesce(s.entropy, 0), 6) AS entropy FROM page_samples p
  LEFT JOIN shape s ON s.sample_id = p.sample_id AND p.language IN ('en', 'fr')""")
def missing_tree_as_zero(t: Tables):
    pages = t.pages().select("sample_id", "language", "code")
    supported = pages.where(F.col("language").isin("en", "fr"))
    features = m.shape_features(m.nest(m.markup_marks(supported, "code"))).select("sample_id", "total_nodes", "entropy")
    return m.with_missing_as_zero(pages.drop("code"), features)


query("tr3_depth", shape_sql(DEPTH))(lambda t: shape(t, DEPTH))
query("tr4_size", shape_sql(SIZE))(lambda t: shape(t, SIZE))
query("tr5_branching", shape_sql(BRANCH))(lambda t: shape(t, BRANCH))
query("tr6_decisions", shape_sql(DECISION))(lambda t: shape(t, DECISION))
query("tr7_calls", shape_sql(CALLS))(lambda t: shape(t, CALLS))
query("tr8_type_entropy", shape_sql(TYPES))(lambda t: shape(t, TYPES))
query("tr9_norm_entropy", shape_sql(["norm_entropy"]))(lambda t: shape(t, ["norm_entropy"]))
query("tr10_branch_entropy", shape_sql(["branch_entropy"]))(lambda t: shape(t, ["branch_entropy"]))
query("tr11_shape_features", shape_sql(m.SHAPE_FEATURES))(lambda t: shape(t, m.SHAPE_FEATURES))


@query("a12_correlations_shape", f"WITH {SHAPE_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(nullif(corr({a}, {b}), 'nan'::DOUBLE), 5) AS correlation FROM shape"
    for i, a in enumerate(m.SHAPE_FEATURES) for b in m.SHAPE_FEATURES[i + 1:]), places=5)
def correlations_shape(t: Tables):
    return correlations(shape(t, m.SHAPE_FEATURES), m.SHAPE_FEATURES)


@query("tr12_basic_features", f"""WITH {SHAPE_SQL} SELECT sample_id, total_nodes, max_depth, round(entropy, 6) AS entropy,
  {', '.join(ROLES)} FROM shape""")
def basic_features(t: Tables):
    return m.basic_features(t.nodes(), roles=ROLES)


@query("tr13_enhanced_features", f"""WITH {SHAPE_SQL} SELECT sample_id, total_nodes, round(entropy, 6) AS entropy, max_depth,
  round(avg_depth, 6) AS avg_depth, round(depth_std, 6) AS depth_std, round(avg_branch, 6) AS avg_branching,
  max_children AS max_branching, {', '.join(ROLES)}, leaf_nodes AS num_leaves,
  round(leaf_nodes / total_nodes, 6) AS leaf_ratio, num_loops + num_ifs + 1 AS cyclomatic FROM shape""")
def enhanced_features(t: Tables):
    return m.role_features(t.nodes(), roles=ROLES)


@query("tr14_transitions", f"""WITH {NODES_SQL} SELECT sample_id, parent_type, type, count(*) AS n FROM nodes
  WHERE parent_type IS NOT NULL GROUP BY 1, 2, 3""")
def transitions(t: Tables):
    return m.transitions(t.nodes())


@query("tr15_error_filter", f"""WITH {NODES_SQL} SELECT sample_id, parent_type, type, count(*) AS n FROM nodes
  WHERE parent_type IS NOT NULL AND NOT contains(lower(parent_type), 'div') AND NOT contains(lower(type), 'div') GROUP BY 1, 2, 3""")
def error_filter(t: Tables):
    return m.transitions(t.nodes(), without_errors=True, error=ERROR)


@query("tr16_universal_transitions", f"""WITH {NODES_SQL} SELECT sample_id, {GROUP_SQL.format('parent_type')} AS parent_type,
  {GROUP_SQL.format('type')} AS type, count(*) AS n FROM nodes WHERE parent_type IS NOT NULL GROUP BY 1, 2, 3""")
def universal_transitions(t: Tables):
    return m.transitions(t.nodes(), mapping=TAG_GROUPS)


@query("tr17_path_documents", f"""WITH {NODES_SQL} SELECT page_id AS sample_id, coalesce(string_agg(lower(parent_type || '->' || type), ' ' ORDER BY node_id), '') AS path
  FROM pages LEFT JOIN (SELECT * FROM nodes WHERE parent_type IS NOT NULL) n ON n.sample_id = page_id GROUP BY 1""")
def path_documents(t: Tables):
    pages = t.table("pages").select(F.col("page_id").alias("sample_id"))
    return m.path_tokens(t.nodes(), pages).select("sample_id", m.path_document(F.col("paths")).alias("path"))


PATH_SQL = f"""{NODES_SQL}, {PAGES_SQL}, edges AS (SELECT sample_id, lower(parent_type || '->' || type) AS term FROM nodes
    WHERE parent_type IS NOT NULL),
  v AS (SELECT term, count(*) AS tf, count(DISTINCT sample_id) AS df FROM edges JOIN page_samples USING (sample_id)
    WHERE split = 'train' GROUP BY 1 HAVING count(DISTINCT sample_id) >= 5 ORDER BY tf DESC, term LIMIT 2000),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM page_samples WHERE split = 'train')) / (1 + df)) + 1 AS idf FROM v),
  raw AS (SELECT sample_id, term, count(*) AS tf, count(*) * any_value(idf) AS w FROM edges JOIN idf USING (term) GROUP BY 1, 2)"""


@query("t04_path_tokens", f"WITH {NODES_SQL} SELECT sample_id, lower(parent_type || '->' || type) AS term, count(*) AS tf FROM nodes WHERE parent_type IS NOT NULL GROUP BY 1, 2")
def path_tokens(t: Tables):
    edges = m.transitions(t.nodes())
    return edges.groupBy("sample_id", m.path_term().alias("term")).agg(F.sum("n").alias("tf"))


@query("tr18_path_tfidf", f"""WITH {PATH_SQL} SELECT sample_id, term, tf,
  round(w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)), 6) AS weight FROM raw""")
def path_tfidf(t: Tables):
    pages = t.pages().select("sample_id", "split")
    documents = reused(m.path_tokens(t.nodes(), pages))
    train = documents.where(F.col("split") == "train")
    return terms.tfidf(train, documents, F.col("paths"), 5, 2000)


@query("tr19_error_edge_comparison", f"""WITH {NODES_SQL}, e AS (SELECT sample_id, count(*) AS n_all,
    count(*) FILTER (NOT contains(lower(parent_type), 'div') AND NOT contains(lower(type), 'div')) AS n_clean
    FROM nodes WHERE parent_type IS NOT NULL GROUP BY 1)
  SELECT sample_id, n_all, n_clean, round(1 - n_clean / n_all, 6) AS error_share FROM e""")
def error_edge_comparison(t: Tables):
    return m.error_share(t.nodes(), error=ERROR)
