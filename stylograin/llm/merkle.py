"""Merkle tree over a dataset, with a proof for each row, by a cogrouped exchange of subtrees.

Rows of a group are leaves in key order, and every ``FAN`` consecutive nodes become one until
one is left, the group's subroot; subroots in group order become the root the same way. Places
are cut into superblocks of ``FAN`` ** ``levels`` nodes, so that a superblock is a whole subtree:

* up: one task per superblock reduces its nodes to one; these nodes are the next tier;
* down: a tier's nodes and the outer nodes that the superblock needs (one row: what stands left
  and right of it on each level up to the root) are cogrouped by superblock. The function
  reduces locally, joins local and outer siblings to proofs, and for leaves folds them.

No task holds more than one superblock, however large a group is, and there are as many rounds
as tiers: two up to 16 million rows of a group.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylograin.llm.common import stored

FAN = 8
LEVELS = 4

NODES = "grp string, pos long, n long, digest string"
OUTER = "grp string, block long, lefts array<string>, rights array<string>"


def digest_of(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of a row: per field ``-`` if null, else its length in UTF-8 bytes, ``:``, and its value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def joined_digest(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int, most: int) -> int:
    """Rounds from ``n`` nodes to one, inside one superblock at most ``most``."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def subtree(digests: list[str], levels: int) -> list[list[str]]:
    """The levels of a superblock, from its nodes to the single one that they become."""
    out = [digests]
    for _ in range(levels):
        out.append([joined_digest(out[-1][k:k + FAN]) for k in range(0, len(out[-1]), FAN)])
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``at`` in its run, on each level below the last."""
    lefts, rights = [], []
    for level in levels[:-1]:
        run = at // FAN * FAN
        lefts.append("".join(level[run:at]))
        rights.append("".join(level[at + 1:run + FAN]))
        at //= FAN
    return lefts, rights


def folded(digest: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        digest = joined_digest([left, digest, right])
    return digest


def placed(rows: DataFrame, order: list[str], copies: str | None = None) -> DataFrame:
    """Rows in ``order`` within ``grp``, as many times as ``copies`` says, with their place ``pos`` (from 0) and the group's size ``n``.

    Ranges of (grp, order) are sorted and written once with a running number; sums per range
    and group, a few rows per range, turn it into places. No group is in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    if copies is not None:
        sorted_rows = sorted_rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("_copy", copies)
    numbered = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    runs = numbered.groupBy("grp", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("n"))
    found = numbered.withColumn("_part", part).join(runs, ["grp", "_part"])
    return found.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and what their superblocks become, until each group is one node."""
    span = FAN ** most

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        top = subtree(rows.sort_values("pos")["digest"].tolist(), levels_of(n, most))[-1]
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [-(-n // span)], "digest": top})

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = out[-1].select("grp", "pos", "n", "digest").groupBy("grp", F.floor(F.col("pos") / span).alias("block"))
        out.append(stored(blocks.applyInPandas(reduce, NODES), "tier"))
    return out


def cogrouped(nodes: DataFrame, outer: DataFrame, fn, schema: str, most: int) -> DataFrame:
    """``fn`` over each superblock's nodes and its row of outer siblings."""
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / FAN ** most))
    return blocks.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(fn, schema)


def outer_below(higher: list[DataFrame], outer: DataFrame, most: int) -> DataFrame:
    """Outer siblings of the superblocks below ``higher`` tiers, given those of the highest tier's nodes."""
    def join_levels(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = subtree(rows["digest"].tolist(), levels_of(int(rows["n"].iloc[0]), most))
        lefts, rights = list(around["lefts"].iloc[0]), list(around["rights"].iloc[0])
        own = [siblings(levels, at) for at in range(len(rows))]
        return pd.DataFrame({"grp": rows["grp"].tolist(), "block": rows["pos"].tolist(),
                             "lefts": [a + lefts for a, _ in own], "rights": [b + rights for _, b in own]})

    for nodes in reversed(higher):
        outer = stored(cogrouped(nodes, outer, join_levels, OUTER, most), "outer")
    return outer


def with_proofs(docs: DataFrame, *, key: str = "doc_id", group: str = "lang", fields: list[str] | None = None,
                shown: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: its key, ``leaf``, ``subroot`` of its group, ``root`` of all, its proof (``lefts``, ``rights``: the joined
    digests left and right of its path, level by level from the leaf), and ``folded_root``.

    A leaf is ``digest_of`` the ``fields`` (all columns by default). ``folded_root`` is the proof
    folded from the row as it is shown: ``shown`` replaces fields by expressions over the row, so
    that ``folded_root = root`` tells whether a row is the one that the tree was built from.

    A null group is a group and comes first, a null key is the smallest of its group. Rows of one
    key are ordered by their leaf, so repeated rows stand side by side; equal ones are counted before they are
    shuffled. Fields may be null or empty. Other columns are not read. A group of one row has its leaf as subroot, and a
    table without rows gives none.
    """
    fields = fields or docs.columns
    shown = shown or {}
    grp = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))
    rows = docs.select(F.col(key).alias("key"), grp.alias("grp"), digest_of([F.col(f) for f in fields]).alias("digest"),
                       digest_of([shown.get(f, F.col(f)) for f in fields]).alias("shown"))
    counted = rows.groupBy("grp", "key", "digest", "shown").agg(F.count(F.lit(1)).alias("copies"))
    leaves = placed(counted, ["key", "digest", "shown"], "copies")
    trees = tiers(leaves, levels)
    subroots = trees[-1].select("grp", "digest")
    tops = tiers(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"), ["key"]), levels)
    none = F.array().cast("array<string>")
    first = F.lit(0).cast("long").alias("block")
    of_root = outer_below(tops[:-1], tops[-1].select("grp", first, none.alias("lefts"), none.alias("rights")), levels)
    of_group = tops[0].select("key", "pos").join(of_root.select(F.col("block").alias("pos"), "lefts", "rights"), "pos")
    outer = outer_below(trees[1:-1], of_group.select(F.col("key").alias("grp"), first, "lefts", "rights"), levels)

    def fold(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = subtree(rows["digest"].tolist(), levels_of(int(rows["n"].iloc[0]), levels))
        lefts, rights = list(around["lefts"].iloc[0]), list(around["rights"].iloc[0])
        own = [siblings(tree, at) for at in range(len(rows))]
        proofs = [(a + lefts, b + rights) for a, b in own]
        return pd.DataFrame({"grp": rows["grp"].tolist(), "key": rows["key"].tolist(), "leaf": rows["digest"].tolist(),
                             "lefts": [a for a, _ in proofs], "rights": [b for _, b in proofs],
                             "folded_root": [folded(d, a, b) for d, (a, b) in zip(rows["shown"], proofs)]})

    # Keys travel as text: in pandas a null would turn integers into floats.
    shown_leaves = leaves.select("grp", "pos", "n", F.col("key").cast("string").alias("key"), "digest", "shown")
    proved = cogrouped(shown_leaves, outer, fold, "grp string, key string, leaf string, lefts array<string>, rights array<string>, folded_root string", levels)
    named = subroots.withColumnRenamed("digest", "subroot").withColumn("root", tops[-1].select("digest").limit(1).scalar())
    return proved.join(named, "grp").select(F.col("key").cast(docs.schema[key].dataType).alias(key), "leaf", "subroot", "root",
                                            "lefts", "rights", "folded_root")
