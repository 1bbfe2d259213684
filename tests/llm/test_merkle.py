from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from stylograin.llm import merkle

FIELDS = ["doc_id", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def level_up(nodes):
    return [h(*nodes[k:k + 8]) for k in range(0, len(nodes), 8)]


def walk(nodes, at):
    """The single node that nodes become, and the siblings of node ``at`` as (left, right) per level."""
    steps = []
    while len(nodes) > 1:
        run = at // 8 * 8
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        nodes, at = level_up(nodes), at // 8
    return nodes[0], steps


def brute(rows, shown):
    """Per row (doc_id, lang, text), in the order of leaves: key, leaf, subroot, root, proof, folded root."""
    groups = {}
    for i, lang, text in rows:
        leaf = h(field(i), field(text))
        groups.setdefault(lang, []).append(((i is not None, i or 0, leaf), i, leaf, h(field(i), field(shown(text)))))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {g: [leaf for _, _, leaf, _ in sorted(groups[g])] for g in names}
    subroots = [walk(leaves[g], 0)[0] for g in names]
    root = walk(subroots, 0)[0]
    out = []
    for k, g in enumerate(names):
        for at, (_, i, leaf, other) in enumerate(sorted(groups[g])):
            steps = walk(leaves[g], at)[1] + walk(subroots, k)[1]
            digest = other
            for left, right in steps:
                digest = h(left, digest, right)
            out.append((i, leaf, subroots[k], root, "".join(a + b for a, b in steps), digest))
    return out


def checked(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = merkle.with_proofs(docs, fields=FIELDS, shown={"text": F.lower("text")}, **options)
    proof = F.concat_ws("", F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b))).alias("proof")
    got = [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root").collect()]
    want = brute(rows, lambda t: t and t.lower())
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("n", [1, 9, 600])
def test_equals_brute_force(spark, n):
    rows = [(7 * k % 1009, "x" if k % 3 else None, f"Text {k}" if k % 2 else f"text {k}") for k in range(n)]
    got = checked(spark, rows)
    assert sum(r[5] == r[3] for r in got) == sum(k % 2 == 0 for k in range(n))


def test_several_tiers_with_small_superblocks(spark):
    langs = [f"l{k:02d}" for k in range(19)] + [None]
    checked(spark, [(k, langs[k % 20] if k < 100 else "l07", f"T{k}") for k in range(700)], levels=1)


def test_nulls_ties_repeated_rows_and_large_keys(spark):
    big = 2 ** 53 + 1
    rows = [(None, None, None), (None, None, None), (None, "a", ""), (1, "a", "x"), (1, "a", "y"), (1, "a", "x"), (big, "a", "Z" * 300_000),
            (big + 1, "a", "é😀"), (2, "", "q"), (-5, "a", " ")]
    checked(spark, rows)


def test_awkward_and_empty_tables(awkward, nothing):
    docs = awkward.withColumn("lang", F.lit("en")).withColumn("leaf", F.lit("x")).withColumn("grp", F.lit(1)).withColumn("pos", F.lit(1))
    found = merkle.with_proofs(docs, fields=["doc_id", "text", "leaf", "grp"])
    assert found.count() == awkward.count()
    assert found.where("folded_root = root").count() == awkward.count()
    assert merkle.with_proofs(nothing.withColumn("lang", F.lit("en"))).collect() == []


def test_all_columns_by_default_and_any_change_shows(spark):
    docs = spark.createDataFrame([(k, "a", k * 2, f"t{k}") for k in range(20)], "doc_id long, lang string, other long, text string")
    found = merkle.with_proofs(docs, shown={"other": F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("other"))})
    assert [r.doc_id for r in found.where("folded_root <> root").collect()] == [3]
