"""MinHash near-duplicates by an LSH forest.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form a class; one signature
of `SIGNATURE` MinHash values stands for the class. Tree t of the forest orders the classes by the signature read from
position DEPTH * t on, cyclically; classes that share at least DEPTH values there (their longest common prefix in that
order) are neighbours. Regions of more than `REGION` neighbours are cut deeper, twice as many values at a time, until
they fit. Pairs whose signatures agree in too few places for the threshold are left out by a bound that loses about one
pair in 10^5 at the threshold itself; the others are confirmed on their full sets.

Two passes keep pairs few without losing any link. First each region gives a spanning forest of its candidate pairs,
best estimates first; confirmed, it links nearly all of a group of copies. Then every neighbourhood, also those cut
before, that still holds several components is looked at whole: the members outside its largest component meet all
members, block by block, with their full sets, and a block gives only confirmed links, one between two components.

Null or empty text: an empty set, linked with nothing. Fewer words than the shingle's width: the whole sequence is one
shingle. Repeated rows fall in one class. Null doc_id: takes part in links, but is never the smallest id, and its row is
kept only if no row of its component has an id. Memory: about 3 MB of text, or the longest text; a region or block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.llm.common import U64, Words, column, grams, hash_strings, located, mix64, narrow_join, settled, sized_batches, unprefixed, whole_groups
from quillspar.llm.components import components
from quillspar.session import write_table

SIGNATURE, DEPTH, REGION, MEETING, MISS = 128, 4, 128, 256, 1e-5
BATCH_BYTES = 3 << 20
_RANDOM = np.random.RandomState(20240501)
_A = (_RANDOM.randint(0, 1 << 31, SIGNATURE, np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.randint(0, 1 << 32, SIGNATURE, np.int64).astype(np.uint32)


def trees(threshold: float) -> int:
    """Trees for which a pair at the threshold is missed by all with a probability under MISS."""
    return min(SIGNATURE // DEPTH, math.ceil(math.log(MISS) / math.log(1 - threshold**DEPTH)))


def least_agreement(threshold: float) -> int:
    """Agreeing values under which a pair isn't a candidate: 4.3 standard deviations below the threshold."""
    return int(SIGNATURE * threshold - 4.3 * math.sqrt(SIGNATURE * threshold * (1 - threshold)))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one after the other, and where each text's begin."""
    words = Words(texts)
    n, counts = len(texts), np.diff(words.starts)
    hashes = words.hashes()
    owner = np.repeat(np.arange(n), counts)
    found, whose = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(hashes) >= width:
        at = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
        found, whose = grams(hashes, width)[at], owner[at]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        whole = [grams(hashes[words.starts[i] : words.starts[i + 1]], int(counts[i]))[0] for i in few]
        found, whose = np.concatenate([found, np.array(whole, U64)]), np.concatenate([whose, few])
    order = np.lexsort((found, whose))
    found, whose = found[order], whose[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
    found, whose = found[new], whose[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int64)


def set_keys(found: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """16 bytes that name each set."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    out = np.zeros((n, 2), U64)
    for k, salt in enumerate((0x51ED270B, 0x2545F491)):
        mixed = mix64(found + U64(salt))
        total = np.zeros(n, U64)
        np.add.at(total, owner, mixed)
        out[:, k] = mix64(total + np.diff(starts).astype(U64))
    return [row.tobytes() for row in out]


def signatures(found: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """MinHash values (uint32, big-endian) of each set; an empty set has an empty signature."""
    n = len(starts) - 1
    small = (found >> U64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(starts) > 0)
    out = np.zeros((len(full), SIGNATURE), np.uint32)
    # texts of about 64k shingles at a time, so that the products stay in the cache
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(starts[full], starts[full[at]] + 65536)))
        a, b = starts[full[at]], starts[full[to - 1] + 1]
        part, begins = small[a:b], (starts[full[at:to]] - a)
        for k in range(SIGNATURE):
            out[at:to, k] = np.minimum.reduceat(part * _A[k] + _B[k], begins)
        at = to
    rows = out.astype(">u4")
    result = [b""] * n
    for i, f in enumerate(full.tolist()):
        result[f] = rows[i].tobytes()
    return result


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            found, starts = shingle_sets(column(table, "text"), width)
            names = ("doc_id", "_file", "_row")
            arrays = [column(table, c) for c in names]
            arrays += [pa.array(np.diff(starts)), pa.array(set_keys(found, starts), pa.binary()), pa.array(signatures(found, starts), pa.binary())]
            yield from pa.table(arrays, names=[*names, "n_shingles", "node", "signature"]).to_batches()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            found, starts = shingle_sets(column(table, "text"), width)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(found.view(np.int64)))
            yield from pa.table([column(table, "node"), lists], names=["node", "items"]).to_batches()

    return run


def turned(signature: str, tree: str | Column, values: int) -> Column:
    """The first `values` values of the signature in the tree's order."""
    tree = F.col(tree) if isinstance(tree, str) else tree
    return F.substring(F.concat(signature, signature), tree * (4 * DEPTH) + 1, F.lit(4 * values))


class _Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _spanning(least: int):
    """A spanning forest of each region's candidate pairs (rows region, node, signature, by region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "region"):
            region = column(table, "region").to_numpy()
            nodes = column(table, "node").to_pylist()
            signs = np.frombuffer(b"".join(column(table, "signature").to_pylist()), np.uint32).reshape(len(nodes), SIGNATURE)
            left, right, score = [], [], []
            ends = np.searchsorted(region, region, "right")
            for step in range(1, len(region)):
                i = np.flatnonzero(np.arange(len(region)) + step < ends)
                if not len(i):
                    break
                for a in range(0, len(i), 8192):
                    x = i[a : a + 8192]
                    same = (signs[x] == signs[x + step]).sum(axis=1)
                    keep = same >= least
                    left.append(x[keep])
                    right.append(x[keep] + step)
                    score.append(same[keep])
            if not left:
                continue
            left, right, score = map(np.concatenate, (left, right, score))
            forest = _Forest(len(nodes))
            picked = [k for k in np.argsort(-score, kind="stable").tolist() if forest.join(int(left[k]), int(right[k]))]
            yield from _edges([(nodes[left[k]], nodes[right[k]]) for k in picked])

    return run


def _edges(pairs: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    table = pa.table([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["u", "v"])
    yield from table.to_batches(8192)


COLUMNS = 4096


def common_items(items: pa.Array, rows: np.ndarray) -> np.ndarray:
    """How many items each of the given rows' sets shares with every set, as products of 0/1 matrices by blocks of items."""
    lengths = np.diff(items.offsets.to_numpy())
    owner = np.repeat(np.arange(len(items)), lengths)
    _, place, often = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = often > 1  # an item of one set only is common to none
    place, owner = (np.cumsum(shared) - 1)[place[shared[place]]], owner[shared[place]]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(rows), len(items)), np.float64)
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(place, (a, a + COLUMNS))
        dense = np.zeros((len(items), COLUMNS), np.float32)
        dense[owner[lo:hi], place[lo:hi] - a] = 1
        out += dense[rows] @ dense.T
    return out.astype(np.int64)


def _confirmed(percent: int):
    """Confirmed links between the components of each region (rows region, node, part, minor, items, by region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for several in whole_groups(batches, "region"):
            region = column(several, "region").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                table = several.slice(a, b - a)
                nodes = column(table, "node").to_pylist()
                part = pc.dictionary_encode(column(table, "part")).indices.to_numpy()
                rows = np.flatnonzero(column(table, "minor").to_numpy(zero_copy_only=False))
                items = pa.concat_arrays([column(table, "items")])
                sizes = pc.list_value_length(items).to_numpy().astype(np.int64)
                both = common_items(items.take(pa.array(np.arange(len(items)))), rows)
                linked = both * 100 >= (sizes[rows][:, None] + sizes[None, :] - both) * percent
                x, y = np.nonzero(linked & (part[rows][:, None] != part[None, :]))
                forest = _Forest(int(part.max()) + 1)
                yield from _edges([(nodes[rows[i]], nodes[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True) if forest.join(int(part[rows[i]]), int(part[j]))])

    return run


def neighbours(classes: DataFrame, n_trees: int) -> DataFrame:
    """(key, members, tree, node, signature): the classes that share DEPTH values with another in some tree."""
    spread = classes.filter("n_shingles > 0").select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    spread = spread.select("node", "tree", F.xxhash64("tree", turned("signature", "tree", DEPTH)).alias("key"))
    shared = write_table(spread.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    held = write_table(narrow_join(spread, shared, ["key"], "inner"), "held")
    return write_table(held.join(classes.select("node", "signature"), "node"), "neighbours")


def regions(held: DataFrame, most: int = REGION) -> DataFrame:
    """Neighbourhoods cut, where they hold more than `most`, by ever longer prefixes, at last by the node's hash."""
    done = held.filter(F.col("members") <= most).select(F.col("key").alias("region"), "node", "signature")
    large = write_table(held.filter(F.col("members") > most).select(F.col("key").alias("region"), "tree", "node", "signature"), "large")
    depth = DEPTH * 2
    while depth < SIGNATURE and not large.isEmpty():
        deeper = write_table(large.withColumn("region", F.xxhash64("region", turned("signature", "tree", depth))), "deeper")
        sizes = write_table(deeper.groupBy("region").agg(F.count("*").alias("members")), "sizes")
        deeper = deeper.join(sizes, "region")
        done = done.union(deeper.filter((F.col("members") > 1) & (F.col("members") <= most)).select("region", "node", "signature"))
        large = write_table(deeper.filter(F.col("members") > most).drop("members"), "large")
        depth *= 2
    if not large.isEmpty():
        sizes = write_table(large.groupBy("region").agg(F.count("*").alias("members")), "sizes")
        cut = large.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / most)))
        done = done.union(cut.select(F.xxhash64("region", "block").alias("region"), "node", "signature"))
    return done


def left_over(held: DataFrame, labels: DataFrame, most: int = MEETING) -> DataFrame:
    """Neighbourhoods that hold several components: their smaller ones' members met with all members, in blocks."""
    parted = write_table(narrow_join(held.select("key", "node"), labels, ["node"], "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "parted")
    mixed = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
    mixed = write_table(mixed, "mixed")
    parted = write_table(narrow_join(parted, mixed, ["key"], "inner"), "mixed-rows")
    sizes = parted.groupBy("key", "part").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all_n"), F.max("n").alias("main_n"))
    sizes = write_table(sizes, "main")
    rows = narrow_join(parted, sizes, ["key"], "inner").withColumn("minor", F.col("part") != F.col("main"))
    rows = rows.withColumns({"blocks": F.ceil(F.col("all_n") / most), "chunks": F.ceil((F.col("all_n") - F.col("main_n")) / most), "h": F.xxhash64("node")})
    # a member sits in its block, met by each chunk of minor members; a minor member sits in its chunk, met by each block
    own = rows.withColumns({"block": F.pmod("h", "blocks"), "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))})
    met = rows.filter("minor").withColumns({"chunk": F.pmod(F.shiftright("h", 20), "chunks"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    met = met.filter(F.col("block") != F.pmod("h", "blocks"))
    both = own.withColumn("minor", F.col("minor") & (F.pmod(F.shiftright("h", 20), "chunks") == F.col("chunk"))).unionByName(met)
    return both.select(F.xxhash64("key", "block", "chunk").alias("region"), "node", "part", "minor")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("u"), F.col("items").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
    met = pairs.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), F.size("a").alias("na"), F.size("b").alias("nb"))
    return met.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("u", "v").distinct()


def full_sets(docs: DataFrame, signed: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, items) for the distinct nodes given, from the text of one row of each class."""
    wanted = write_table(nodes.select("node").distinct(), "wanted")
    one = narrow_join(signed.select("node", "_file", "_row"), wanted, ["node"], "inner").groupBy("node").agg(F.min(F.struct("_file", "_row")).alias("x"))
    one = write_table(one.select("node", "x._file", "x._row"), "one")
    rows = narrow_join(located(docs, ["text"]).drop("_block"), one, ["_file", "_row"], "inner")
    return write_table(rows.select("node", "text").mapInArrow(_sets(width), "node binary, items array<long>"), "sets")


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: its identity (_file, _row), doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    docs = settled(docs)
    kind = dict(docs.dtypes)["doc_id"]
    rows = located(docs, ["doc_id", "text"]).drop("_block")
    signed = write_table(rows.mapInArrow(_signed(width), f"doc_id {kind}, _file long, _row long, n_shingles long, node binary, signature binary"), "signed")
    classes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = write_table(classes, "classes")
    held = neighbours(classes, trees(percent / 100))
    least = least_agreement(percent / 100)
    spread = regions(held).repartition("region").sortWithinPartitions("region", "signature", "node")
    pairs = write_table(spread.mapInArrow(_spanning(least), "u binary, v binary").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    links = write_table(confirm(pairs, full_sets(docs, signed, ends, width), percent), "links")
    rest = write_table(left_over(held, write_table(components(links), "labels")), "left-over")
    if not rest.isEmpty():
        meeting = rest.join(full_sets(docs, signed, rest, width), "node").repartition("region").sortWithinPartitions("region")
        links = write_table(links.union(meeting.select("region", "node", "part", "minor", "items").mapInArrow(_confirmed(percent), "u binary, v binary")), "links")
    labels = write_table(components(links), "labels")
    named = write_table(narrow_join(classes.select("node", "doc_id"), labels, ["node"], "left").withColumn("root", F.coalesce("root", "node")), "named")
    ids = write_table(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids")
    named = write_table(named.join(ids, "root").select("node", "component_id"), "named")
    out = signed.select("_file", "_row", "doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("node")


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest doc_id (of equal ones, one row)."""
    docs = settled(docs)
    linked = write_table(link(docs, width, percent), "linked")
    first = linked.filter("kept AND n_shingles > 0").groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct("_file", "_row")).alias("x"))
    twice = write_table(first.filter("n > 1"), "twice")
    extra = narrow_join(linked.filter("kept AND n_shingles > 0"), twice, ["component_id"], "inner").filter(F.struct("_file", "_row") != F.col("x"))
    gone = write_table(linked.filter("NOT kept").select("_file", "_row").union(extra.select("_file", "_row")), "gone")
    names = docs.columns
    rows = located(docs, names, "d_").drop("_block")
    return unprefixed(narrow_join(rows, gone, ["_file", "_row"], "left_anti"), names, "d_")
