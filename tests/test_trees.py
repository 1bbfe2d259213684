import math
import random

import pytest
from pyspark.sql import functions as F

from stylograin.operators import trees as m

NODES = [(0, None, "module"), (1, 0, "function_definition"), (2, 1, "identifier"), (3, 1, "block"), (4, 3, "for_statement"),
         (5, 4, "identifier"), (6, 4, "call"), (7, 3, "ERROR"), (8, 7, "identifier"), (9, 3, "return_statement")]


def node_table(spark):
    kinds = {i: t for i, _, t in NODES}
    parents = {i: p for i, p, _ in NODES}

    def depth(i):
        return 0 if parents[i] is None else 1 + depth(parents[i])

    rows = [(1, i, p, depth(i), sum(q == i for q in parents.values()), t, kinds.get(p)) for i, p, t in NODES]
    return spark.createDataFrame(
        rows, "sample_id long, node_id int, parent_id int, depth int, n_children int, type string, parent_type string")


def test_shape_example(spark):
    row = m.shape_features(node_table(spark)).first()
    want = dict(max_depth=4, avg_depth=2.6, depth_var=1.64, total_nodes=10, leaf_nodes=5, leaf_ratio=0.5, avg_branch=0.9,
                max_children=3, branch_variance=1.09, cyclomatic=2, decision_nodes=1, unique_types=8, entropy=1.973001,
                norm_entropy=0.948813, branch_entropy=1.220607, function_calls=1, unique_calls=1, internal_nodes=5)
    assert list(want) and set(want) == set(m.SHAPE_FEATURES)
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name


def test_edges(spark):
    nodes = node_table(spark)
    assert m.edges(nodes).count() == 9
    assert m.edges(nodes, without_errors=True).count() == 7
    universal = {(r.parent_type, r.type) for r in m.edges(nodes, mapping=m.type_map()).collect()}
    assert {("block", "ctrl"), ("ctrl", "call"), ("module", "defn")} <= universal


def test_type_map_size():
    table = m.type_map()
    assert table["class_body"] == "defn" and len(set(table.values())) == 11


def test_sample_without_tree(spark):
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    nodes = node_table(spark)
    row = m.with_missing_as_zero(samples, m.shape_features(nodes)).where("sample_id = 2").first()
    assert all(row[name] == 0 for name in m.SHAPE_FEATURES)
    paths = {r.sample_id: r.paths for r in m.path_tokens(nodes, samples).collect()}
    assert paths[2] == [] and paths[1][0] == "module->function_definition"


def test_nesting_of_markup(spark):
    html = "<html><body><p>x<br>y</p><script>var a='<b>';</script><ul><li>1<li>2</ul></body></html>"
    nodes = m.nest(m.markup_marks(spark.createDataFrame([(1, html)], "sample_id long, v string"), "v"))
    got = [(r.type, r.parent_type, r.depth, r.n_children) for r in nodes.orderBy("node_id").collect()]
    assert got == [("html", None, 0, 1), ("body", "html", 1, 2), ("p", "body", 2, 1), ("br", "p", 3, 0),
                   ("ul", "body", 2, 1), ("li", "ul", 3, 1), ("li", "li", 4, 0)]


def test_nesting_of_brackets(spark):
    code = "def f(a, b[0]): return {g(a): (1)}"
    nodes = m.nest(m.bracket_marks(spark.createDataFrame([(1, code)], "sample_id long, v string"), "v"))
    got = [(r.type, r.parent_type, r.depth) for r in nodes.orderBy("node_id").collect()]
    assert got == [("f", None, 0), ("b", "f", 1), ("return", None, 0), ("g", "return", 1), ("(", "return", 1)]


def test_tree_invariants(spark, folder):
    from stylograin.catalog.tables import Tables
    nodes = Tables(spark, folder).nodes().persist()
    sums = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_children").alias("kids"),
                     F.count_if(F.col("parent_id").isNull()).alias("roots")).first()
    assert sums.kids == sums.n - sums.roots
    for row in m.shape_features(nodes).collect():
        assert row.entropy <= math.log(row.unique_types) + 1e-6
        assert row.leaf_nodes + row.internal_nodes == row.total_nodes
    nodes.unpersist()


def node_rows(nodes):
    return sorted((str(r.sample_id), r.node_id, r.parent_id, r.depth, r.n_children, r.type, r.parent_type) for r in nodes.collect())


def by_stack_of_levels(marks):
    """The last opener one level up is the parent, whatever the marks."""
    out, kids = {}, {}
    depth, last = {}, {}
    for key, pos, kind, step in sorted(marks, key=lambda x: (str(x[0]), x[1])):
        depth[key] = depth.get(key, 0) + step
        if step >= 0:
            d = depth[key] - (step == 1)
            up = last.get((key, d - 1))
            out[key, pos] = [up[0] if up else None, d, kind, up[1] if up else None]
            if up:
                kids[key, up[0]] = kids.get((key, up[0]), 0) + 1
            if step == 1:
                last[key, d] = (pos, kind)
    return sorted((str(k), p, up, d, kids.get((k, p), 0), kind, up_kind) for (k, p), (up, d, kind, up_kind) in out.items())


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_blocks_give_the_same_trees(spark, block):
    """Balanced or not, deep or flat, with closers below the start, gaps in the positions and a null sample."""
    rng = random.Random(block)
    marks = []
    for key in [*range(12), None]:
        weights = rng.choice([(5, 4, 1), (1, 1, 1), (8, 1, 0), (1, 3, 1)])
        pos = 0
        for _ in range(rng.choice([0, 1, 7, 60, 200])):
            pos += rng.choice([1, 1, 1, 4])
            marks.append((key, pos, rng.choice("abc"), rng.choices([1, -1, 0], weights)[0]))
    df = spark.createDataFrame(marks, "sample_id long, pos int, type string, step int").repartition(5)
    want = by_stack_of_levels(marks)
    assert node_rows(m.nest_in_blocks(df, block=block)) == want
    assert node_rows(m.nest(df)) == want


def test_one_large_sample_in_blocks(spark):
    """One sample of 400,000 marks: 98 blocks, and the parent of most late nodes is many blocks back."""
    step = F.when(F.col("id") < 1000, 1).when(F.col("id") % 2 == 0, 1).otherwise(-1)
    df = spark.range(400_000).select(F.lit(1).alias("sample_id"), F.col("id").cast("int").alias("pos"), F.lit("x").alias("type"), step.alias("step"))
    nodes = m.nest_in_blocks(df, block=4096).persist()
    row = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("n_children").alias("kids"), F.max("depth").alias("deep"),
                    F.count_if(F.col("parent_id").isNull()).alias("roots")).first()
    assert (row.n, row.kids, row.deep, row.roots) == (1000 + 199_500, 199_500, 1000, 1)
    assert nodes.where("n_children = 199500").first().node_id == 999
    nodes.unpersist()
