"""Exact Jaccard join of word n-gram sets: size-banded tiles, hashed bitmaps, sorted-array intersections.

Bands of set sizes grow so that partners are in one band or in neighbouring ones. A family is a
band and the next. In it a linked pair differs in ``d`` shingles at most, so hash space is cut into more than
``d`` buckets: at least one bucket holds the same shingles in both sets. A tile is a family,
a bucket and its content; all linked pairs meet in some tile, whatever the data are.

A tile names few sets that are unlike, and groups of copies meet in very many tiles. So tiles are read as
sorted runs, and each gives a star from its first member. Tiles of one or two shingles, or none, may be
shared by chance or by a common passage: their members' bitmaps are compared in blocks, and only pairs
whose overlap can be large enough give a star. The stars' components are clusters. Within a cluster,
again by bitmap and then by intersection of the sorted sets, two passes find the links:

* each block of a cluster among itself and against the cluster's first set;
* of clusters that have several blocks and are still in pieces, every block against the blocks of
  sets outside the largest piece.

Bitmaps hold the parity of the shingles per hashed bit, so bits that differ are a lower bound of the shingles
that differ, and bound the overlap from above. Pairs are never emitted, only stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograin.llm.common import SortedArrays, components, mapped, mix, saved_sorted, slices, stored
from stylograin.llm.near_dup import edge_batches, groups, shingles

LARGEST = 1 << 44  # no text has more shingles
FEW = 2            # shingles of a tile that may be shared by chance
NARROW, WIDE = 64, 1 << 16
BLOCK = 1024
BLOCK_BYTES = 16 << 20


class Bands:
    """First sizes of the bands, and of each family its number of buckets and how many of a set's may be empty without notice."""

    def __init__(self, percent: int):
        first = [1]
        while first[-1] < LARGEST:
            first.append(first[-1] * 100 // percent + 1)
        self.first = np.array(first[:-2], np.int64)
        last = np.array(first[1:], np.int64) - 1
        differing = (100 - percent) * (last[:-1] + last[1:]) // (100 + percent)
        self.spare = (differing + 1) // 16
        self.buckets = np.where(differing > 0, differing + 1 + self.spare, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, "right") - 1


def width(size: int) -> int:
    """Bits of the bitmap of a set: a power of two, about twice the set at most."""
    return min(max(NARROW, 1 << max(0, int(size) - 1).bit_length()), WIDE)


def bitmap(members: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the members per hashed bit, as 64-bit words."""
    at = ((members >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def narrowed(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap folded to fewer 64-bit words; parities add up."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def names_of(found: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Twice 64 bits that name each set; 0 for an empty one."""
    filled = np.diff(begin) > 0
    out = [np.zeros(len(filled), np.uint64), np.zeros(len(filled), np.uint64)]
    if filled.any():
        at = begin[:-1][filled]
        out[0][filled] = np.add.reduceat(mix(found ^ np.uint64(0x2545F4914F6CDD1D)), at)
        out[1][filled] = np.add.reduceat(mix(found + np.uint64(0x9E3779B97F4A7C15)), at)
    return out


def sketches(docs: DataFrame, key: str, text: str, size: int, bands: Bands) -> DataFrame:
    """Per row: key, size of its set, names of the set, and its bitmap (null for an empty set)."""
    def sketch(batches):
        for batch in slices(batches, text):
            found, begin = shingles(batch.column(text), size)
            n = np.diff(begin)
            widths = [width(bands.first[b]) for b in bands.of(np.maximum(n, 1)).tolist()]
            made = [bitmap(found[a:b], w).tobytes() if b > a else None for a, b, w in zip(begin[:-1].tolist(), begin[1:].tolist(), widths)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), *[pa.array(x.view(np.int64)) for x in names_of(found, begin)],
                                              pa.array(made, pa.binary())], names=["key", "n_shingles", "name1", "name2", "bitmap"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), sketch, f"key {kind}, n_shingles bigint, name1 bigint, name2 bigint, bitmap binary")


def tiles_of(found: np.ndarray, begin: np.ndarray, family: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Tiles and the index of the set in each, where set ``i`` is in ``family[i]`` (below 0: in none). The last bit of a tile says ``FEW``."""
    n = np.diff(begin)
    buckets = np.where(family >= 0, bands.buckets[np.maximum(family, 0)], 0)
    wanted = (n > 0) & (buckets > 0)
    of = np.repeat(np.arange(len(n)), np.where(wanted, n, 0))
    if not len(of):
        return np.empty(0, np.uint64), of
    members = found[np.repeat(wanted, n)]
    bucket = ((members >> np.uint64(32)) * buckets[of].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    content, held, sets, bucket = np.add.reduceat(mix(members), at), np.diff(at, append=len(of)), of[at], bucket[at]
    empty = buckets - np.bincount(sets, minlength=len(n))
    notable = np.flatnonzero(wanted & (empty > bands.spare[np.maximum(family, 0)]))
    if len(notable):  # sets with more empty buckets than are spare may agree in nothing else
        first = np.searchsorted(sets, [notable, notable + 1])
        missing = [np.setdiff1d(np.arange(buckets[i]), bucket[a:b].astype(np.int64)) for i, a, b in zip(notable.tolist(), *first.tolist())]
        extra = np.repeat(notable, [len(m) for m in missing])
        sets, bucket = np.concatenate([sets, extra]), np.concatenate([bucket, np.concatenate(missing).astype(np.uint64)])
        content, held = np.concatenate([content, np.zeros(len(extra), np.uint64)]), np.concatenate([held, np.zeros(len(extra), np.int64)])
    place = mix((family[sets].astype(np.uint64) << np.uint64(44)) + bucket + np.uint64(1))
    tile = mix(content + place * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return tile - (held > FEW).astype(np.uint64), sets


def tiles(docs: DataFrame, text: str, size: int, bands: Bands) -> DataFrame:
    """(tile, name) for each set; a task gives the tiles of equal sets once."""
    def file(batches):
        done: set[int] = set()
        for batch in slices(batches, text):
            found, begin = shingles(batch.column(text), size)
            name = names_of(found, begin)[0]
            fresh = np.zeros(len(name), bool)
            for i, x in enumerate(name.tolist()):
                if x not in done:
                    done.add(x)
                    fresh[i] = True
            band = np.where(fresh & (np.diff(begin) > 0), bands.of(np.maximum(np.diff(begin), 1)), -1)
            for family in (band, band - 1):
                tile, of = tiles_of(found, begin, family, bands)
                yield pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(name[of].view(np.int64))], names=["tile", "name"])

    return mapped(docs.select(text), file, "tile bigint, name bigint")


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Columns of many batches at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def shared_tiles(filed: DataFrame) -> DataFrame:
    """Of tiles with several sets: (0, first, name) for a star, or (tile, name, null) for each member where the shingles are few."""
    def share(batches):
        tile, first, told = None, None, False
        for tiles_, names in gathered(batches):
            carried = tile is not None
            if carried:
                tiles_, names = np.concatenate([[tile], tiles_]), np.concatenate([[first], names])
            new = np.ones(len(tiles_), bool)
            new[1:] = tiles_[1:] != tiles_[:-1]
            other = np.ones(len(tiles_), bool)
            other[1:] = new[1:] | (names[1:] != names[:-1])
            run = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            star = other & ~new & (names != names[begin][run])
            several = np.zeros(len(begin), bool)
            several[run[star]] = True
            few = tiles_ & 1 == 1
            pairs = np.unique(np.stack([names[begin][run][star & ~few], names[star & ~few]]), axis=1)
            rows = few & several[run] & (star | new)
            if carried and told:
                rows[0] = False
            weak = rows.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(pairs.shape[1], np.int64), tiles_[rows]])), pa.array(np.concatenate([pairs[0], names[rows]])),
                 pa.array(np.concatenate([pairs[1], np.zeros(weak, np.int64)]), mask=np.arange(pairs.shape[1] + weak) >= pairs.shape[1])],
                names=["tile", "a", "b"])
            told = bool(several[-1]) or (carried and told and len(begin) == 1)
            tile, first = tiles_[-1], names[begin[-1]]

    return mapped(filed.repartition("tile").sortWithinPartitions("tile", "name"), share, "tile bigint, a bigint, b bigint")


def dealt(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """``rows`` in groups (``group``, ``first``, ``second``): all of a group of one block, else each pair of blocks."""
    own = F.pmod(F.xxhash64("id", F.lit(29)), blocks).cast("int")
    meet = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda k: F.struct(F.least(own, k).alias("first"), F.greatest(own, k).alias("second")))
    return rows.withColumn("_pair", F.explode(meet)).select("*", "_pair.first", "_pair.second").drop("_pair")


class Parts:
    """Connected parts of the rows of one group; ``join`` merges the parts of a row and of others."""

    def __init__(self, labels: np.ndarray):
        self.label = labels

    def join(self, i: int, others: np.ndarray) -> None:
        self.label[np.isin(self.label, np.unique(self.label[others]))] = self.label[i]

    def stars(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort([ids, self.label])
        begins = np.ones(len(ids), bool)
        begins[1:] = self.label[order][1:] != self.label[order][:-1]
        least = ids[order][begins][np.cumsum(begins) - 1]
        other = least != ids[order]
        return least[other], ids[order][other]


def may_link(bits: np.ndarray, sizes: np.ndarray, i: int, rows: np.ndarray, percent: int) -> np.ndarray:
    """Of ``rows`` those whose overlap with row ``i`` can be large enough, by size and by differing bits."""
    rows = rows[100 * np.minimum(sizes[i], sizes[rows]) >= percent * np.maximum(sizes[i], sizes[rows])]
    both = sizes[i] + sizes[rows]
    differ = np.bitwise_count(bits[rows] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return rows[(100 + percent) * (both - differ) >= 2 * percent * both]


def bitmaps_of(column: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(x, np.uint64) for x in column]
    words = min(len(r) for r in rows)
    return np.stack([narrowed(r, words) for r in rows])


def possible_stars(weak: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Stars (a, b) of the pairs that the bitmaps allow, within each tile."""
    members = stored(weak.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), "tiles")
    named = classes.select(F.col("name1").alias("id"), "n_shingles", "bitmap")
    rows = weak.join(members, "tile").join(named, "id")
    names = ["tile", "first", "second"]

    def compare(batches):
        def each():
            for table in groups(batches, names):
                ids, sizes = table.column("id").to_numpy(), table.column("n_shingles").to_numpy()
                bits = bitmaps_of(table.column("bitmap").to_pylist())
                parts = Parts(np.arange(len(ids)))
                for i in range(len(ids) - 1):
                    rest = i + 1 + np.flatnonzero(parts.label[i + 1:] != parts.label[i])
                    near = may_link(bits, sizes, i, rest, percent)
                    if len(near):
                        parts.join(i, near)
                yield parts.stars(ids)
        yield from edge_batches(each())

    tiled = dealt(rows, "tile", F.ceil(F.col("n") / F.lit(BLOCK)))
    return mapped(tiled.repartition(*names).sortWithinPartitions(*names), compare, "a bigint, b bigint").distinct()


def sets_of(docs: DataFrame, members: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, members) of the documents in ``members`` (id), found where they lie: only these sets leave their task."""
    parts = saved_sorted(members.select("id"), "id", [], "members")

    def collect(batches):
        arrays = SortedArrays(parts, "id")
        for batch in batches:
            batch = batch.filter(batch.column(key).is_valid())
            found, _ = arrays.look_up(batch.column(key).cast(pa.int64()).to_numpy(), [])
            for part in slices([batch.filter(pa.array(found))], text):
                sets, begin = shingles(part.column(text), size)
                made = pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()),
                                                   pa.array([sets[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())], names=["id", "members"])
                yield made.filter(pa.array(np.diff(begin) > 0))

    return mapped(docs.select(key, text), collect, "id bigint, members binary")


def links(rows: DataFrame, names: list[str], percent: int) -> DataFrame:
    """Stars (a, b) of the linked rows of each group ``names``: columns id, members, and piece (rows of one piece are not compared)."""
    def link(batches):
        def each():
            for table in groups(batches, names):
                table = table.sort_by("id")
                ids = table.column("id").to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
                sizes = np.array([len(s) for s in sets])
                bits = width(sizes.max())
                maps = np.stack([bitmap(s, bits) for s in sets])
                _, piece = np.unique(table.column("piece").to_numpy(), return_inverse=True)
                parts = Parts(piece.astype(np.int64))
                for i in range(len(ids) - 1):
                    rest = may_link(maps, sizes, i, i + 1 + np.flatnonzero(parts.label[i + 1:] != parts.label[i]), percent)
                    for at in range(0, len(rest), 256):
                        some = rest[at:at + 256]
                        tokens = np.concatenate([sets[j] for j in some.tolist()])
                        place = np.minimum(np.searchsorted(sets[i], tokens), len(sets[i]) - 1)
                        both = np.add.reduceat(sets[i][place] == tokens, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
                        near = some[100 * both >= percent * (sizes[i] + sizes[some] - both)]
                        if len(near):
                            parts.join(i, near)
                yield parts.stars(ids)
        yield from edge_batches(each())

    return mapped(rows.repartition(*names).sortWithinPartitions(*names), link, "a bigint, b bigint").distinct()


def linked_sets(docs: DataFrame, members: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Stars (a, b) that join all linked sets of each cluster. ``members``: id, cluster, n_shingles."""
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(8 * F.sum("n_shingles") / F.lit(BLOCK_BYTES)))
    clusters = stored(members.groupBy("cluster").agg(n_blocks.alias("blocks"), F.min("id").alias("head")), "clusters")
    members = stored(members.select("id", "cluster").distinct().join(clusters, "cluster"), "members")
    rows = sets_of(docs, members, key, text, size).join(members, "id")
    own = F.pmod(F.xxhash64("id", F.lit(29)), F.col("blocks"))
    everywhere = F.when(F.col("id") == F.col("head"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    within = rows.withColumn("piece", F.col("id")).withColumn("block", F.explode(everywhere)).select("cluster", "block", "id", "piece", "members")
    found = stored(links(within, ["cluster", "block"], percent), "links")
    pieces = components(found).withColumnRenamed("component", "piece")
    large = members.where("blocks > 1").join(pieces, "id", "left").withColumn("piece", F.coalesce("piece", "id"))
    counts = large.groupBy("cluster", "piece").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("minus"), "piece"))["piece"].alias("main"), F.sum("n").alias("all"),
                                         F.max("n").alias("most"))
    open_rows = stored(large.join(main.where("`all` > most"), "cluster"), "open")
    if open_rows.isEmpty():
        return found
    # Blocks of the sets outside the main piece are numbered on their own; each meets all blocks.
    minor = F.col("piece") != F.col("main")
    n_minor = F.greatest(F.lit(1), F.ceil(F.col("blocks") * (F.col("all") - F.col("most")) / F.col("all")))
    in_minor, in_main = F.pmod(F.xxhash64("id", F.lit(31)), n_minor), F.pmod(F.xxhash64("id", F.lit(37)), F.col("blocks"))
    all_minor = F.sequence(F.lit(0).cast("long"), n_minor - 1)
    meet_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(in_minor.alias("first"), (-1 - k).alias("second")))
    meet_minor = F.transform(all_minor, lambda k: F.struct(F.least(in_minor, k).alias("first"), F.greatest(in_minor, k).alias("second")))
    from_main = F.transform(all_minor, lambda k: F.struct(k.alias("first"), (-1 - in_main).alias("second")))
    pairs = F.when(minor, F.concat(meet_main, meet_minor)).otherwise(from_main)
    rows = sets_of(docs, open_rows, key, text, size).join(open_rows, "id").withColumn("_pair", F.explode(pairs))
    across = rows.select("cluster", "_pair.first", "_pair.second", "id", "piece", "members")
    return found.union(links(across, ["cluster", "first", "second"], percent))


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Per row: its key, ``n_shingles`` and ``component_id``, the smallest key that it is linked with, itself included.

    Words are runs of anything but blanks and ASCII white space, A-Z lowered; a set holds the
    distinct shingles of ``size`` words, or the whole text as one if it has fewer. Two rows are linked
    if 100 times the intersection is at least ``percent`` times the union. No link is lost (shingles
    are told apart by 64 bits, equal sets by 128).

    Null, empty and wordless texts have no shingles and are linked with nothing. Rows with a null key
    cannot be named; their component is null. Keys must be integers and should be unique: of rows that repeat one, equal
    texts are judged alike, and links of different texts count for the key. Other columns are not read.
    """
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    bands = Bands(percent)
    rows = stored(sketches(docs, key, text, size, bands).withColumn("key", F.col("key").cast("long")), "sketches")
    named = rows.where("key IS NOT NULL AND n_shingles > 0")
    classes = stored(named.groupBy("name1", "name2").agg(F.min("key").alias("id"), F.first("n_shingles").alias("n_shingles"),
                                                         F.first("bitmap").alias("bitmap")), "classes")
    shared = stored(shared_tiles(tiles(docs.where(F.col(key).isNotNull()), text, size, bands)), "shared")
    weak = shared.where("tile <> 0").select("tile", F.col("a").alias("id")).distinct()
    stars = shared.where("tile = 0").select("a", "b").distinct().union(possible_stars(weak, classes, percent))
    clusters = components(stars).select(F.col("id").alias("name1"), F.col("component").alias("cluster"))
    members = classes.select("name1", "id", "n_shingles").join(clusters, "name1").select("id", "cluster", "n_shingles")
    linked = components(linked_sets(docs, members, key, text, size, percent))
    found = stored(classes.select("name1", "name2", "id").join(linked, "id", "left")
                   .select("name1", "name2", F.coalesce("component", "id").alias("component_id")), "found")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return (rows.drop("bitmap").join(found, ["name1", "name2"], "left")
            .select(F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull(), own).alias("component_id")))
