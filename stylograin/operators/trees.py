"""Syntax trees as node tables, their shape features, and parent-child transitions.

A node table has ``sample_id, node_id, parent_id, depth, n_children, type, parent_type``
and may come from any parser. ``nest`` builds one from open and close marks. All
windows and aggregates of one sample share its hash partitioning, so a tree costs
one shuffle, by sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.operators.joins import mapped_ends
from stylograin.operators.ordering import prefix_sums

# Tags that hold no content.
VOID_TAGS = ["br", "meta", "img", "hr", "input", "link"]

# Node types that count as decisions.
DECISION_TYPES = ["if_statement", "for_statement", "while_statement"]

# Node types behind the role counts of the 8- and 15-feature rows.
ROLE_TYPES = {
    "num_functions": ["FunctionDef"],
    "num_loops": ["For", "While"],
    "num_ifs": ["If"],
    "num_assign": ["Assign"],
    "num_return": ["Return"],
}

# Universal categories and the node types they stand for.
UNIVERSAL_CATEGORIES = {
    "ctrl": ["if_statement", "else_clause", "elif_clause", "for_statement", "while_statement",
             "do_statement", "switch_statement", "case_clause", "switch_expression",
             "for_in_statement", "enhanced_for_statement", "for_range_clause", "if_expression",
             "match_statement"],
    "defn": ["function_definition", "function_declaration", "method_declaration",
             "method_definition", "func_literal", "arrow_function", "function_expression",
             "class_definition", "class_declaration", "class_body", "interface_declaration",
             "constructor_declaration", "lambda"],
    "call": ["call", "call_expression", "method_invocation", "invocation_expression",
             "object_creation_expression"],
    "assign": ["assignment", "assignment_expression", "augmented_assignment",
               "compound_assignment_operator", "short_var_declaration",
               "local_variable_declaration", "variable_declarator"],
    "return": ["return_statement"],
    "block": ["block", "compound_statement", "statement_block"],
    "param": ["parameters", "formal_parameters", "parameter_list", "typed_parameter",
              "default_parameter", "typed_default_parameter"],
    "err": ["try_statement", "catch_clause", "except_clause", "finally_clause"],
    "lit": ["string", "integer", "float", "true", "false", "none", "null_literal", "number",
            "interpreted_string_literal"],
    "id": ["identifier", "field_identifier", "type_identifier"],
    "import": ["import_statement", "import_declaration", "import_spec", "package_clause",
               "using_directive"],
}

# The order of the 18 shape features.
SHAPE_FEATURES = [
    "max_depth", "avg_depth", "depth_var", "total_nodes", "leaf_nodes", "leaf_ratio", "avg_branch",
    "max_children", "branch_variance", "cyclomatic", "decision_nodes", "unique_types", "entropy",
    "norm_entropy", "branch_entropy", "function_calls", "unique_calls", "internal_nodes",
]


def type_map(categories: Mapping[str, Sequence[str]] = UNIVERSAL_CATEGORIES) -> dict[str, str]:
    return {name: category for category, names in categories.items() for name in names}


def markup_marks(df: DataFrame, text: str, key: str = "sample_id",
                 void_tags: Sequence[str] = VOID_TAGS) -> DataFrame:
    """(key, pos, type, step) per tag: 1 opens, -1 closes, 0 stands alone."""
    bare = F.regexp_replace(F.col(text), r"(?is)<(script|style)\b.*?</\1>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"<(/?[a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    rows = df.select(key, F.posexplode(tags).alias("pos", "tag"))
    name = F.lower(F.ltrim(F.col("tag"), F.lit("/")))
    step = (F.when(F.startswith(F.col("tag"), F.lit("/")), -1)
            .when(name.isin(list(void_tags)), 0).otherwise(1))
    return rows.select(key, "pos", name.alias("type"), step.alias("step"))


def bracket_marks(df: DataFrame, text: str, key: str = "sample_id") -> DataFrame:
    """(key, pos, type, step) per bracket; an opening one is named by the word before it."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}_]*\s*[({\[]|[)}\]]"), F.lit(0))
    rows = df.select(key, F.posexplode(found).alias("pos", "mark"))
    bracket = F.substring(F.col("mark"), -1, 1)
    word = F.regexp_extract(F.col("mark"), r"^([\p{L}\p{N}_]+)", 1)
    step = F.when(bracket.isin(")", "}", "]"), -1).otherwise(1)
    return rows.select(key, "pos", F.when(word == "", bracket).otherwise(word).alias("type"),
                       step.alias("step"))


def nest(marks: DataFrame, key: str = "sample_id") -> DataFrame:
    """Node table of open and close marks.

    The depth is the running sum of the steps. Every node then takes part twice: as
    possible parent on its own level and as child on the level above. On each level an
    opening node starts a run, and the children in that run are its children. No join
    is needed, and both windows keep the partitioning by ``key``.
    """
    by_pos = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("step") == 1
    depth = F.sum("step").over(by_pos) - F.when(opens, 1).otherwise(0)
    placed = marks.withColumn("depth", depth.cast("int")).where(F.col("step") >= 0)
    roles = F.array_compact(F.array(
        F.struct((F.col("depth") - 1).alias("level"), F.lit(0).alias("opener")),
        F.when(opens, F.struct(F.col("depth").alias("level"), F.lit(1).alias("opener")))))
    rows = placed.select(key, "pos", "type", "depth", F.inline(roles))
    on_level = Window.partitionBy(key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("opener").over(on_level))
    in_run = Window.partitionBy(key, "level", "run")
    is_opener = F.col("opener") == 1
    rows = rows.withColumns({
        "up_id": F.max(F.when(is_opener, F.col("pos"))).over(in_run),
        "up_type": F.max(F.when(is_opener, F.col("type"))).over(in_run),
        "kids": F.sum(1 - F.col("opener")).over(in_run)})
    return rows.groupBy(key, F.col("pos").alias("node_id")).agg(
        F.max(F.when(~is_opener, F.col("up_id"))).alias("parent_id"),
        F.max("depth").alias("depth"),
        F.coalesce(F.max(F.when(is_opener, F.col("kids"))), F.lit(0)).cast("int").alias("n_children"),
        F.max("type").alias("type"),
        F.max(F.when(~is_opener, F.col("up_type"))).alias("parent_type"))


def nest_in_blocks(marks: DataFrame, key: str = "sample_id", block: int = 65_536) -> DataFrame:
    """``nest`` for samples of any size: the same rows, but no task holds more than ``block`` marks of a sample.

    A sample is cut into blocks of positions. The sum of each block's steps gives the depth at which the next
    ones begin. A node whose parent is not in its block asks, by level, for the last node that earlier blocks opened there: from one
    row per (block, level), a window per level finds it. It then stands in front of the asking block as one more
    opener, so that runs within (block, level) give parents, and children are added up over the blocks.

    This costs more shuffles than ``nest`` and pays off where a sample has millions of marks.
    """
    block_of = F.floor(F.col("pos") / F.lit(block)).cast("bigint")
    sums = prefix_sums(marks, ["pos"], {"step": F.col("step")}, [key], block_of).drop("step_all")
    opens = F.col("step") == 1
    depth = F.col("step_upto") - F.when(opens, 1).otherwise(0)
    placed = sums.withColumns({"depth": depth.cast("int"), "block": block_of}).where(F.col("step") >= 0)
    roles = F.array_compact(F.array(
        F.struct((F.col("depth") - 1).alias("level"), F.lit(0).alias("opener")),
        F.when(opens, F.struct(F.col("depth").alias("level"), F.lit(1).alias("opener")))))
    rows = placed.select(key, "block", "pos", "type", "depth", F.inline(roles))
    is_opener = F.col("opener") == 1
    first_opener = F.min(F.when(is_opener, F.col("pos")))
    first_child = F.min(F.when(~is_opener, F.col("pos")))
    ends = rows.groupBy(key, "block", "level").agg(
        F.max(F.when(is_opener, F.struct("pos", "type", "depth"))).alias("last"),
        F.coalesce(first_child < F.coalesce(first_opener, first_child + 1), F.lit(False)).alias("asks"))
    earlier = Window.partitionBy(key, "level").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = ends.withColumn("up", F.last("last", ignorenulls=True).over(earlier)).where(F.col("asks") & F.col("up").isNotNull())
    fronts = found.select(key, "block", "up.pos", "up.type", "up.depth", "level", F.lit(1).alias("opener"))
    rows = rows.unionByName(fronts)
    on_level = Window.partitionBy(key, "block", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("opener").over(on_level))
    in_run = Window.partitionBy(key, "block", "level", "run")
    rows = rows.withColumns({
        "up_id": F.max(F.when(is_opener, F.col("pos"))).over(in_run),
        "up_type": F.max(F.when(is_opener, F.col("type"))).over(in_run),
        "kids": F.sum(1 - F.col("opener")).over(in_run)})
    return rows.groupBy(key, F.col("pos").alias("node_id")).agg(
        F.max(F.when(~is_opener, F.col("up_id"))).alias("parent_id"),
        F.max("depth").alias("depth"),
        F.coalesce(F.sum(F.when(is_opener, F.col("kids"))), F.lit(0)).cast("int").alias("n_children"),
        F.max("type").alias("type"),
        F.max(F.when(~is_opener, F.col("up_type"))).alias("parent_type"))


def shape_features(nodes: DataFrame, key: str = "sample_id",
                   decisions: Sequence[str] = DECISION_TYPES, call_mark: str = "call") -> DataFrame:
    """The 18 shape features per sample.

    Nodes are first added up per (type, child count); the entropies follow from window
    sums over those few rows, so one pass gives every feature.
    """
    n = F.lit(1).cast("double")
    cells = nodes.groupBy(key, "type", "n_children").agg(
        F.sum(n).alias("c"), F.sum("depth").alias("d1"),
        F.sum(F.col("depth").cast("double") * F.col("depth")).alias("d2"), F.max("depth").alias("dm"))
    whole = Window.partitionBy(key)
    of_type = Window.partitionBy(key, "type")
    of_branch = Window.partitionBy(key, "n_children")
    cells = cells.withColumns({
        "total": F.sum("c").over(whole),
        "c_type": F.sum("c").over(of_type),
        "c_branch": F.sum("c").over(of_branch),
        "first_of_type": F.row_number().over(of_type.orderBy("n_children")) == 1})

    def entropy(count: str) -> Column:
        return F.sum(-(F.col("c") / F.col("total")) * F.log(F.col(count) / F.col("total") + 1e-10))

    c, k = F.col("c"), F.col("n_children")
    is_call = F.contains(F.col("type"), F.lit(call_mark))
    sums = cells.groupBy(key).agg(
        F.sum("c").alias("total_nodes"),
        F.max("dm").cast("double").alias("max_depth"),
        (F.sum("d1") / F.sum("c")).alias("avg_depth"),
        (F.sum("d2") / F.sum("c")).alias("sq_depth"),
        F.sum(F.when(k == 0, c).otherwise(0.0)).alias("leaf_nodes"),
        F.sum(F.when(k > 0, c).otherwise(0.0)).alias("internal_nodes"),
        (F.sum(c * k) / F.sum(c)).alias("avg_branch"),
        (F.sum(c * k * k) / F.sum(c)).alias("sq_branch"),
        F.max(k).cast("double").alias("max_children"),
        F.sum(F.when(F.col("type").isin(list(decisions)), c).otherwise(0.0)).alias("decision_nodes"),
        F.count_if("first_of_type").cast("double").alias("unique_types"),
        entropy("c_type").alias("entropy"),
        entropy("c_branch").alias("branch_entropy"),
        F.sum(F.when(is_call, c).otherwise(0.0)).alias("function_calls"),
        F.count_if(is_call & F.col("first_of_type")).cast("double").alias("unique_calls"))
    kinds = F.col("unique_types")
    derived = {
        "depth_var": F.greatest(F.col("sq_depth") - F.col("avg_depth") ** 2, F.lit(0.0)),
        "branch_variance": F.greatest(F.col("sq_branch") - F.col("avg_branch") ** 2, F.lit(0.0)),
        "leaf_ratio": F.col("leaf_nodes") / (F.col("total_nodes") + 1e-9),
        "cyclomatic": F.col("decision_nodes") + 1.0,
        "norm_entropy": F.when(kinds > 1, F.col("entropy") / F.log(kinds + 1e-10)).otherwise(0.0),
    }
    return sums.withColumns(derived).select(key, *SHAPE_FEATURES)


def role_counts(roles: Mapping[str, Sequence[str]]) -> list[Column]:
    return [F.count_if(F.col("type").isin(list(types))).cast("double").alias(name)
            for name, types in roles.items()]


def role_features(nodes: DataFrame, key: str = "sample_id",
                  roles: Mapping[str, Sequence[str]] = ROLE_TYPES) -> DataFrame:
    """The 15-feature row; its subset ``basic_features`` has 8 of them."""
    counts = nodes.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("total_nodes"),
        F.max("depth").cast("double").alias("max_depth"), F.avg("depth").alias("avg_depth"),
        F.stddev_pop("depth").alias("depth_std"), F.avg("n_children").alias("avg_branching"),
        F.max("n_children").cast("double").alias("max_branching"), *role_counts(roles),
        F.count_if(F.col("n_children") == 0).cast("double").alias("num_leaves"))
    entropies = type_entropy(nodes, key)
    return counts.join(entropies, key).select(
        key, "total_nodes", "entropy", "max_depth", "avg_depth", "depth_std", "avg_branching",
        "max_branching", *roles, "num_leaves",
        (F.col("num_leaves") / F.col("total_nodes")).alias("leaf_ratio"),
        (F.col("num_loops") + F.col("num_ifs") + 1.0).alias("cyclomatic"))


def basic_features(nodes: DataFrame, key: str = "sample_id",
                   roles: Mapping[str, Sequence[str]] = ROLE_TYPES) -> DataFrame:
    """The 8-feature row."""
    counts = nodes.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("total_nodes"),
                                    F.max("depth").cast("double").alias("max_depth"),
                                    *role_counts(roles))
    return counts.join(type_entropy(nodes, key), key).select(
        key, "total_nodes", "max_depth", "entropy", *roles)


def type_entropy(nodes: DataFrame, key: str = "sample_id", column: str = "type",
                 name: str = "entropy") -> DataFrame:
    """Entropy of the distribution of ``column`` among the nodes of a sample."""
    counts = nodes.groupBy(key, column).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(key))
    return counts.withColumn("p", p).groupBy(key).agg(
        F.sum(-F.col("p") * F.log(F.col("p") + 1e-10)).alias(name))


def with_missing_as_zero(samples: DataFrame, features: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every sample keeps its row; one without a tree gets zeros."""
    names = [c for c in features.columns if c != key]
    return samples.join(features, key, "left").fillna(0.0, names)


def has_error(name: Column, mark: str = "error") -> Column:
    return F.contains(F.lower(name), F.lit(mark))


def touches_error(error: str = "error") -> Column:
    """True for an edge with an error at either end."""
    return has_error(F.col("parent_type"), error) | has_error(F.col("type"), error)


def edges(nodes: DataFrame, without_errors: bool = False, mapping: Mapping[str, str] | None = None,
          error: str = "error") -> DataFrame:
    """Nodes that have a parent, as parent-child edges.

    An edge is dropped if either end names an error; its descendants are other edges
    and are judged on their own.
    """
    rows = nodes.where(F.col("parent_type").isNotNull())
    if without_errors:
        rows = rows.where(~touches_error(error))
    return mapped_ends(rows, mapping) if mapping else rows


def transitions(nodes: DataFrame, key: str = "sample_id", without_errors: bool = False,
                mapping: Mapping[str, str] | None = None, error: str = "error") -> DataFrame:
    """(key, parent_type, type, n) per distinct parent-child transition of a sample."""
    return edges(nodes, without_errors, mapping, error).groupBy(key, "parent_type", "type").agg(
        F.count(F.lit(1)).alias("n"))


def error_share(nodes: DataFrame, key: str = "sample_id", error: str = "error") -> DataFrame:
    """Edges of a sample with and without the error filter, and the share that is lost."""
    clean = F.count_if(~touches_error(error))
    n = F.count(F.lit(1))
    return edges(nodes).groupBy(key).agg(n.alias("n_all"), clean.alias("n_clean"),
                                         (1 - clean / n).alias("error_share"))


def path_term(parent: str = "parent_type", child: str = "type") -> Column:
    """An edge as a lower-case term."""
    return F.lower(F.concat(F.col(parent), F.lit("->"), F.col(child)))


def path_tokens(nodes: DataFrame, samples: DataFrame, key: str = "sample_id",
                without_errors: bool = False, mapping: Mapping[str, str] | None = None,
                error: str = "error") -> DataFrame:
    """Samples with ``paths``: the terms of all edges in node order, empty without a tree."""
    listed = edges(nodes, without_errors, mapping, error).groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("node_id", path_term().alias("term")))).alias("edges"))
    return samples.join(listed.select(key, F.col("edges.term").alias("paths")), key, "left").withColumn(
        "paths", F.coalesce("paths", F.array().cast("array<string>")))


def path_document(paths: Column) -> Column:
    return F.array_join(paths, " ")
