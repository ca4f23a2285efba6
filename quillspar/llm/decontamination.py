"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case. Documents and benchmark items that
share a run of SEED words are joined; each such pair is tiled: common runs that no tile holds yet are found by running
Karp-Rabin hashes at a search length, extended, and marked from the longest down, cut by the tiles before them; the search
length then halves until runs of MIN_TILE words are marked. Tiles don't overlap and may stand in any order, so a passage
whose parts were reordered is still covered. A document is contaminated by an item of whose words at least COVERAGE are
tiled.

A tile is a run of MIN_TILE words or more that both hold, so the item's words inside runs of MIN_TILE words that the
document holds anywhere bound what tiling can cover. A pair whose bound stays below COVERAGE isn't tiled: a seed that
thousands of items share costs one look at the bound each. best_item and its figures are of the tiled items; null and 0
where there is none.

The benchmark is the query set: it is read in blocks of about BLOCK_BYTES, each sent to all tasks and met with all
documents; a block's result is written and the block freed before the next is read, so a benchmark of any size takes
bounded memory and as many passes as it has blocks. Items of fewer than SEED words are joined by all their words at once;
items without words are left out, as are documents without (never contaminated). item_id may be of any type. Null ids stay
null; repeated items count each, repeated documents give repeated rows. Of items with equal coverage the smallest item_id
is named. An empty benchmark or no documents: nothing is contaminated. Memory: about 3 MB of text, or the longest text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspar.llm.common import MIX1, U64, Words, column, grams, hash_strings, located, mix64, narrow_join, plain_words, settled, sized_batches, unprefixed
from quillspar.session import write_table

MIN_TILE, COVERAGE, FIRST_LENGTH = 3, 0.8, 20
#: A seed is as wide as the narrowest tile, so that no pair that tiling could cover goes unmet.
SEED = MIN_TILE
BLOCK_BYTES, BATCH_BYTES = 4 << 20, 3 << 20


class Rolling:
    """Karp-Rabin hashes of all windows of a sequence: differences of prefix hashes, for any length."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(len(tokens), MIX1, U64)]))
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(tokens) * self.powers[:-1])])
            self.inverse = np.cumprod(np.concatenate([np.ones(1, U64), np.full(len(tokens), U64(pow(int(MIX1), -1, 1 << 64)), U64)]))

    def windows(self, length: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that hold no marked token."""
        n = len(self.tokens) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        used = np.concatenate([[0], np.cumsum(marked)])
        at = np.flatnonzero(used[length:] == used[:n])
        return at, (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def _matches(p: Rolling, t: Rolling, length: int, mp: np.ndarray, mt: np.ndarray) -> list[tuple[int, int, int]]:
    """(run, i, j) of the runs of unmarked equal tokens of at least `length` that can't be extended to either side."""
    ip, hp = p.windows(length, mp)
    it, ht = t.windows(length, mt)
    order = np.argsort(ht, kind="stable")
    lo, hi = np.searchsorted(ht[order], hp), np.searchsorted(ht[order], hp, "right")
    found = []
    for i, a, b in zip(ip[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
        js = it[order[a:b]]
        if i and not mp[i - 1]:  # only where the run begins
            js = js[(js == 0) | mt[js - 1] | (t.tokens[js - 1] != p.tokens[i - 1])]
        for j in js.tolist():
            most = min(len(p.tokens) - i, len(t.tokens) - j)
            stop = (p.tokens[i : i + most] != t.tokens[j : j + most]) | mp[i : i + most] | mt[j : j + most]
            run = int(np.argmax(stop)) if stop.any() else most
            if run >= length:
                found.append((run, i, j))
    return found


def tile(item: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE) -> int:
    """How many tokens of the item greedy tiling with runs of the text covers."""
    p, t = Rolling(item), Rolling(text)
    mp, mt = np.zeros(len(item), bool), np.zeros(len(text), bool)
    min_tile = min(min_tile, len(item))
    length = max(min_tile, min(FIRST_LENGTH, len(item)))
    while True:
        # longest first; a run that a tile has cut comes back as what is left of it
        waiting = [(-run, i, j) for run, i, j in _matches(p, t, length, mp, mt)]
        heapq.heapify(waiting)
        while waiting:
            run, i, j = heapq.heappop(waiting)
            free = np.concatenate([[False], ~(mp[i : i - run] | mt[j : j - run]), [False]])
            cuts = np.flatnonzero(free[1:] != free[:-1]).tolist()
            if cuts == [0, -run]:
                mp[i : i - run] = True
                mt[j : j - run] = True
                continue
            for a, b in zip(cuts[::2], cuts[1::2], strict=True):
                if b - a >= length:
                    heapq.heappush(waiting, (a - b, i + a, j + a))
        if length == min_tile:
            return int(mp.sum())
        length = max(min_tile, length // 2)


class Block:
    """Some benchmark items: their tokens, and by width the sorted seed hashes with the items that hold them."""

    def __init__(self, ids: list, texts: list):
        words = Words(plain_words(pc.utf8_lower(pa.array([x or "" for x in texts], pa.string()))), lower=False)
        hashes = words.hashes()
        self.ids, self.tokens = [], []
        held: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (a, b) in enumerate(zip(words.starts[:-1], words.starts[1:], strict=True)):
            if b > a:
                width = int(min(SEED, b - a))
                held.setdefault(width, []).append((np.unique(grams(hashes[a:b], width)), len(self.ids)))
                self.ids.append(ids[k])
                self.tokens.append(hashes[a:b])
        self.seeds = {}
        for width, each in held.items():
            names = np.concatenate([x for x, _ in each])
            items = np.concatenate([np.full(len(x), i) for x, i in each])
            order = np.argsort(names, kind="stable")
            self.seeds[width] = (names[order], items[order])

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> dict[int, set[int]]:
        """The items that share a seed with each text."""
        out: dict[int, set[int]] = {}
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for width, (names, items) in self.seeds.items():
            found = grams(hashes, width)
            lo = np.searchsorted(names, found)
            at = np.flatnonzero(names[np.minimum(lo, len(names) - 1)] == found)
            at = at[owner[at] == owner[at + width - 1]]
            pairs = np.unique(owner[at] * (len(names) + 1) + lo[at])
            for x in pairs.tolist():
                doc, a = divmod(x, len(names) + 1)
                b = int(np.searchsorted(names, names[a], "right"))
                out.setdefault(doc, set()).update(items[a:b].tolist())
        return out


def most_covered(item: np.ndarray, held: np.ndarray, width: int) -> int:
    """Tokens of the item inside runs of `width` tokens whose hashes are among the sorted `held`: no tiling covers more."""
    found = grams(item, width)
    known = held[np.minimum(np.searchsorted(held, found), len(held) - 1)] == found if len(held) else np.zeros(len(found), bool)
    marks = np.zeros(len(item) + 1, np.int64)
    marks[:-width] += known  # a run begins here, and ends `width` tokens on
    marks[width:] -= known
    return int((np.cumsum(marks)[:-1] > 0).sum())


def _tiled(block, kind: pa.DataType, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Block = block.value
        for table in sized_batches(batches, "text", BATCH_BYTES):
            words = Words(plain_words(pc.utf8_lower(pc.fill_null(column(table, "text"), ""))), lower=False)
            hashes = words.hashes()
            n = table.num_rows
            best, covered, size, over = [None] * n, [0] * n, [0] * n, [0] * n
            for doc, found in items.candidates(hashes, words.starts).items():
                text = hashes[words.starts[doc] : words.starts[doc + 1]]
                held = {w: np.unique(grams(text, w)) for w in {min(MIN_TILE, len(items.tokens[k])) for k in found}}
                top = None
                for k in sorted(found):
                    m = len(items.tokens[k])
                    if most_covered(items.tokens[k], held[min(MIN_TILE, m)], min(MIN_TILE, m)) < coverage * m:
                        continue
                    c = tile(items.tokens[k], text)
                    over[doc] += c >= coverage * m
                    rank = (-c / m, k)  # items stand in the order of their ids
                    if c and (top is None or rank < top):
                        top, best[doc], covered[doc], size[doc] = rank, items.ids[k], c, m
            rows = [column(table, c) for c in ("doc_id", "_file", "_row")]
            rows += [pa.array(np.diff(words.starts)), pa.array(best, kind), pa.array(covered, pa.int64()), pa.array(size, pa.int64()), pa.array(over, pa.int64())]
            yield from pa.table(rows, names=["doc_id", "_file", "_row", "n_words", "best_item", "covered_words", "item_words", "n_items"]).to_batches()

    return run


def tilings(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: _file, _row, doc_id, n_words, best_item, covered_words, item_words, coverage, n_items, contaminated."""
    spark = docs.sparkSession
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    rows = located(docs, ["doc_id", "text"]).drop("_block")
    numbered = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    fields = f"doc_id {doc_kind}, _file long, _row long, n_words long, best_item {item_kind}, covered_words long, item_words long, n_items long"
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = None
    for k in range(blocks):
        items = numbered.filter(F.col("block") == k).orderBy(F.col("item_id").asc_nulls_last(), "text").select("item_id", "text").collect()  # one block
        block = spark.sparkContext.broadcast(Block([r.item_id for r in items], [r.text for r in items]))
        one = rows.mapInArrow(_tiled(block, kind, coverage), fields)
        if blocks > 1:
            one = write_table(one.filter("item_words > 0") if k else one, "tiled")
            block.destroy()
        found = one if found is None else found.unionAll(one)
    if blocks > 1:
        rank = F.struct(-F.try_divide(F.col("covered_words").cast("double"), F.col("item_words")), F.col("best_item").isNull(), "best_item")
        best = F.min_by(F.struct("best_item", "covered_words", "item_words"), F.when(F.col("item_words") > 0, rank))
        found = found.groupBy("_file", "_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), best.alias("b"), F.sum("n_items").alias("n_items"))
        found = found.select("doc_id", "_file", "_row", "n_words", "b.best_item", F.coalesce("b.covered_words", F.lit(0)).alias("covered_words"), F.coalesce("b.item_words", F.lit(0)).alias("item_words"), "n_items")
    share = F.coalesce(F.try_divide(F.col("covered_words").cast("double"), F.col("item_words")), F.lit(0.0))
    return found.withColumns({"coverage": share, "contaminated": F.col("n_items") > 0})


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the contaminated documents."""
    docs = settled(docs)
    gone = write_table(tilings(docs, benchmark, coverage).filter("contaminated").select("_file", "_row"), "gone")
    names = docs.columns
    return unprefixed(narrow_join(located(docs, names, "d_").drop("_block"), gone, ["_file", "_row"], "left_anti"), names, "d_")
