"""Repeated byte strings by a distributed difference-cover suffix sort.

Only the equality of the suffixes' first `length` bytes is asked for, so the suffix order is built that far and no
further, by the steps of the difference-cover method:

* Cover. Sorting two thirds of all byte positions (residues mod 3) would shuffle some ten times the input. The cover here
  is read from the content: a position is sampled if a hash of its 8 bytes falls in 1 of `RATE`. Equal strings have
  their samples at equal distances, which is what the cover is for, and the sample is a thirtieth of the positions.
* Sort the sample by tuples of `TUPLE` bytes: tuple names go to tasks by range, are sorted there, and equal neighbours
  are the repeated ones.
* Recurse on names: a longer string can repeat only if every sampled tuple inside it does, so each suffix whose
  `length`-byte prefix holds a tuple without an equal neighbour is ranked alone and leaves the sort. What the tasks need
  to know of the names is a Bloom filter of a fixed greatest size; a full filter makes more suffixes stay, no fewer.
* Merge the remaining suffixes, sampled or not: named by their `length` bytes, dealt out by range, sorted, and compared
  with their neighbours. Equal neighbours repeat.

Names are 64-bit fingerprints. Copies of a whole text are found first; one of each takes part in the sort, and all of
them are covered as a whole. Names are sent once per batch of rows, so text that thousands of documents share does not
pile up in a task: no task holds more than one range of names.

Null text: no bytes. Texts shorter than `length`: nothing to remove. Repeated rows: copies of each other. Whole texts are
used; memory is a batch of about 2 MB of text (or the longest text) times forty, or one range of names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm.common import MIX1, U64, column, located, mix64, narrow_join, quoted, settled, sized_batches, whole_groups
from quillspar.session import fits_broadcast, write_table

LENGTH, TUPLE, RATE = 200, 64, 32
BATCH_BYTES = 2 << 20
#: Names of a range: about this many bytes of text give one range.
RANGE_BYTES = 12 << 20
MOST_FILTER_BITS, BITS_A_NAME = 1 << 28, 16
SINGLE, FIRST, COPY = 0, 1, 2


class Suffixes:
    """The texts of a batch as one run of bytes, with the hash of the 8 bytes at each position."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([pc.fill_null(texts, "")])
        _, offsets, data = texts.buffers()
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.starts = ends - ends[0]
        self.bytes = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[ends[0] : ends[-1]]
        x = self.bytes.astype(U64)
        for shift in (1, 2, 4):
            y = x.copy()
            y[:-shift] |= x[shift:] << U64(8 * shift)
            x = y
        self.words = mix64(x)

    def starting(self, length: int) -> np.ndarray:
        """Whether `length` bytes from each position on lie in its text."""
        inside = np.zeros(len(self.bytes), bool)
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            inside[a : max(a, b - length + 1)] = True
        return inside

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the `length` bytes at the given positions; `length` is a multiple of 8."""
        out = np.full(len(at), length, U64)
        for j in range(0, length, 8):
            out *= MIX1
            out += self.words[at + j]
        return mix64(out)

    def sample(self) -> np.ndarray:
        return np.flatnonzero(((self.words >> U64(40)) % U64(RATE) == 0) & self.starting(TUPLE))

    def remaining(self, names: Filter, length: int) -> np.ndarray:
        """Positions whose `length` bytes hold no sampled tuple that is alone."""
        at = self.sample()
        alone = np.zeros(len(self.bytes) + 1, np.int32)
        alone[at[~names.has(self.names(at, TUPLE))] + 1] = 1
        np.cumsum(alone, out=alone)
        start = np.flatnonzero(self.starting(length))
        return start[alone[start + (length - TUPLE + 1)] == alone[start]]


class Filter:
    """A Bloom filter with one section for each range of names."""

    def __init__(self, bits: np.ndarray, ranges: int):
        self.bits, self.ranges = bits, ranges

    @staticmethod
    def places(names: np.ndarray, ranges: int, section: int) -> tuple[np.ndarray, np.ndarray]:
        base = range_of(names, ranges).astype(U64) * U64(section)
        mixed = names * MIX1
        return base + (mixed >> U64(33)) % U64(section), base + (mixed & U64(0xFFFFFFFF)) % U64(section)

    def has(self, names: np.ndarray) -> np.ndarray:
        found = np.ones(len(names), bool)
        for x in self.places(names, self.ranges, len(self.bits) * 8 // self.ranges):
            found &= (self.bits[(x >> U64(3)).astype(np.int64)] >> (x & U64(7)).astype(np.uint8)) & 1 == 1
        return found


def range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges are equal, as names are spread evenly; `ranges` is a power of two."""
    return (names >> U64(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(names), np.int64)


def _dealt(batch: int, names: np.ndarray, ranges: int) -> pa.Table:
    """A row for each range with names: the batch's distinct names in order, and a bit for each that it holds twice."""
    names, counts = np.unique(names, return_counts=True)
    cuts = np.searchsorted(range_of(names, ranges), np.arange(ranges + 1))
    parts = np.flatnonzero(np.diff(cuts))
    rows = {
        "batch": pa.array(np.full(len(parts), batch, np.int64)),
        "part": pa.array(parts.astype(np.int64)),
        "names": pa.array([names[cuts[p] : cuts[p + 1]].tobytes() for p in parts], pa.binary()),
        "twice": pa.array([np.packbits(counts[cuts[p] : cuts[p + 1]] > 1).tobytes() for p in parts], pa.binary()),
    }
    return pa.table(rows)


DEALT = "batch long, part long, names binary, twice binary"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Tables of rows with a number that another pass over the same files gives them again."""
    counts: dict[tuple, int] = {}
    for table in sized_batches(batches, "text", BATCH_BYTES, ("_file", "_block")):
        key = (table.column("_file")[0].as_py(), table.column("_block")[0].as_py())
        counts[key] = counts.get(key, -1) + 1
        seed = np.array([key[0], key[1], counts[key]], np.int64).view(U64)
        yield int(mix64(mix64(mix64(seed[:1]) + seed[1:2]) + seed[2:]).view(np.int64)[0]), table


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All names of a range, whether each one repeats, and where each row's begin."""
    rows = [np.frombuffer(x, U64) for x in column(table, "names").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    names = np.concatenate(rows)
    repeated = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)) for t, x in zip(column(table, "twice").to_pylist(), rows, strict=True)]).astype(bool)
    order = np.argsort(names)
    inorder = names[order]
    same = inorder[1:] == inorder[:-1]
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return names, repeated, starts


def _by_range(dealt: DataFrame, ranges: int) -> DataFrame:
    return dealt.repartition(ranges, "part").sortWithinPartitions("part")


def repeated_tuples(rows: DataFrame, ranges: int) -> Filter:
    """The filter of the sampled tuples that occur twice or more."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _batches(batches):
            texts = Suffixes(column(table.filter(pc.not_equal(table.column("role"), COPY)), "text"))
            yield from _dealt(number, texts.names(texts.sample(), TUPLE), ranges).to_batches()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            for part in np.unique(column(table, "part").to_numpy()).tolist():
                names, repeated, _ = _sorted(table.filter(pc.equal(table.column("part"), part)))
                names = np.unique(names[repeated])
                yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "names": pa.array([names.tobytes()], pa.binary()), "n": pa.array([len(names)])})

    spark = rows.sparkSession
    names = write_table(_by_range(rows.mapInArrow(sampled, DEALT), ranges).mapInArrow(found, "part long, names binary, n long"), "tuples")
    most = names.agg(F.max("n")).first()[0] or 1
    section = min(MOST_FILTER_BITS // ranges, 1 << max(6, (BITS_A_NAME * most - 1).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("names").to_pylist(), strict=True):
                bits = np.zeros(section, bool)
                for x in Filter.places(np.frombuffer(blob, U64), ranges, section):
                    bits[(x - U64(part * section)).astype(np.int64)] = True
                yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros(max(1, section * ranges // 8), np.uint8)  # at most MOST_FILTER_BITS
    for row in names.mapInArrow(marked, "part long, bits binary").toLocalIterator():
        bits[row.part * section // 8 :][: section // 8] = np.frombuffer(row.bits, np.uint8)
    return Filter(bits, ranges)


def covered(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs covered by `length` bytes from each of the sorted positions on."""
    if not len(at):
        return []
    new = np.flatnonzero(np.diff(at) > length) + 1
    return list(zip(at[np.concatenate([[0], new])].tolist(), (at[np.concatenate([new - 1, [len(at) - 1]])] + length).tolist(), strict=True))


RESULT = "_file long, _row long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _result(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", kind), ("_file", pa.int64()), ("_row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS), ("text", pa.string()), ("batch", pa.int64()), ("ord", pa.int64()), ("role", pa.int32())])


def _settled(row: dict, data: bytes, spans: list[tuple[int, int]]) -> dict:
    kept, at = hashlib.sha256(), 0
    for a, b in spans:
        kept.update(data[at:a])
        at = b
    kept.update(data[at:])
    return row | {"n_bytes": len(data), "n_removed": sum(b - a for a, b in spans), "kept_sha256": kept.hexdigest(), "spans": [{"first": a, "last": b} for a, b in spans], "text": None}


def find(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs: _file, _row, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first byte, byte after)."""
    if length < TUPLE or length % 8:
        raise ValueError(f"length must be a multiple of 8, {TUPLE} at least")
    spark = docs.sparkSession
    rows = located(docs, ["doc_id", "text"])
    keyed = rows.select("_file", "_row", F.md5(F.encode("text", "UTF-8")).alias("key"), F.octet_length("text").alias("size"))
    copies = keyed.filter(F.col("size") >= length).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("_file", "_row")).alias("x"))
    copies = write_table(copies.filter("n > 1").select("key", "x"), "copies")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = 1 << max(4, (total // RANGE_BYTES).bit_length())
    if fits_broadcast(copies):  # a shuffle would lose the order in which every pass must see the rows
        rows = rows.withColumn("key", F.md5(F.encode("text", "UTF-8"))).join(F.broadcast(copies), "key", "left")
        role = F.when(F.col("x").isNull(), SINGLE).when(F.struct("_file", "_row") == F.col("x"), FIRST).otherwise(COPY)
        rows = rows.select("doc_id", "text", "_file", "_block", "_row", role.cast("int").alias("role"))
    else:
        rows = rows.withColumn("role", F.lit(SINGLE).cast("int"))
    names = repeated_tuples(rows, ranges)
    shared = spark.sparkContext.broadcast((names.bits, ranges))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*shared.value)
        for number, table in _batches(batches):
            texts = Suffixes(column(table.filter(pc.not_equal(table.column("role"), COPY)), "text"))
            yield from _dealt(number, texts.names(texts.remaining(known, length), length), ranges).to_batches()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            for part in np.unique(column(table, "part").to_numpy()).tolist():
                one = table.filter(pc.equal(table.column("part"), part))
                _, repeated, starts = _sorted(one)
                bits = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                rows = {"batch": column(one, "batch"), "ord": column(one, "part"), "bits": pa.array(bits, pa.binary()), "n": pa.array(np.diff(starts))}
                yield from pa.table(rows).to_batches(64)

    answers = write_table(_by_range(rows.mapInArrow(merged, DEALT), ranges).mapInArrow(compared, "batch long, ord long, bits binary, n long"), "answers")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, {RESULT}, text string, batch long, ord long, role int"

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the rows that are settled; the text of those that need an answer."""
        known = Filter(*shared.value)
        for number, table in _batches(batches):
            taking = table.column("role").to_numpy() != COPY
            texts = Suffixes(column(table.filter(pa.array(taking)), "text"))
            open_ = np.zeros(table.num_rows, bool)
            at = texts.remaining(known, length)
            open_[np.flatnonzero(taking)[np.unique(np.searchsorted(texts.starts, at, "right") - 1)]] = True
            out = []
            for i, row in enumerate(table.select(["doc_id", "text", "_file", "_row", "role"]).to_pylist()):
                row |= {"batch": number, "ord": i}
                if open_[i]:
                    out.append(row | {"n_bytes": None, "n_removed": None, "kept_sha256": None, "spans": None})
                else:
                    data = (row["text"] or "").encode()
                    out.append(_settled(row, data, [(0, len(data))] if row["role"] != SINGLE else []))
            yield from pa.Table.from_pylist(out, _result(table.schema.field("doc_id").type)).to_batches()

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From a batch's answers and then its open rows: these rows' results."""
        known = Filter(*shared.value)
        for several in whole_groups(batches, "batch"):
            numbers = column(several, "batch").to_numpy()
            for number in np.unique(numbers):
                table = several.filter(pa.array(numbers == number))
                bits = table.filter(pc.is_valid(table.column("bits")))
                open_ = table.filter(pc.is_null(table.column("bits")))
                if not open_.num_rows:
                    continue
                flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(bits.column("bits").to_pylist(), bits.column("n").to_pylist(), strict=True)]
                texts = Suffixes(column(open_, "text"))
                at = texts.remaining(known, length)
                _, where = np.unique(texts.names(at, length), return_inverse=True)
                again = at[np.concatenate(flags).astype(bool)[where]]
                cuts = np.searchsorted(again, texts.starts)
                out = []
                for i, row in enumerate(open_.drop_columns(["bits", "n"]).to_pylist()):
                    data = row["text"].encode()
                    spans = [(0, len(data))] if row["role"] != SINGLE else covered(again[cuts[i] : cuts[i + 1]] - texts.starts[i], length)
                    out.append(_settled(row, data, spans))
                yield from pa.Table.from_pylist(out, _result(table.schema.field("doc_id").type)).to_batches()

    rows = write_table(rows.mapInArrow(parted, fields), "parted")
    waiting = rows.filter("kept_sha256 IS NULL").unionByName(answers.select("batch", "ord", "bits", "n"), allowMissingColumns=True)
    waiting = waiting.repartition("batch").sortWithinPartitions("batch", F.col("bits").isNull(), "ord")
    results = rows.filter("kept_sha256 IS NOT NULL").union(waiting.mapInArrow(answered, fields))
    return results.withColumn("n_spans", F.size("spans").cast("long")).drop("text", "batch", "ord", "role")


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated strings cut out of their texts; bytes of a character that a cut splits go too."""
    docs = settled(docs)
    cuts = write_table(find(docs, length).filter("n_removed > 0").select("_file", "_row", "spans"), "cuts")
    names, schema = docs.columns, docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            arrays = [batch.column(f"c{i}") for i in range(len(names))]
            spans = batch.column("cuts").to_pylist()
            if any(spans):
                texts = arrays[at].to_pylist()
                for i, gone in enumerate(spans):
                    if gone:
                        data, parts, last = texts[i].encode(), [], 0
                        for s in gone:
                            parts.append(data[last : s["first"]])
                            last = s["last"]
                        texts[i] = b"".join([*parts, data[last:]]).decode("utf-8", "ignore")
                arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = located(docs, names, "d_").drop("_block")
    joined = narrow_join(rows, cuts, ["_file", "_row"], "left")
    return joined.select(*[quoted(f"d_{c}").alias(f"c{i}") for i, c in enumerate(names)], F.col("spans").alias("cuts")).mapInArrow(cut, schema)
