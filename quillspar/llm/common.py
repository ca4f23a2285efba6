"""Row identities, Arrow batches and text arrays shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.session import fits_broadcast, write_table

U64 = np.uint64
MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Word separators of every contract: ASCII space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"


ARROW_BYTES = 8 << 20


def light_batches(spark: SparkSession) -> None:
    """Hold Arrow batches between the JVM and Python to ARROW_BYTES (Spark's own bound is 64 MB), for this session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def located(docs: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """`columns` of docs with the stable identity of each row: _file (hash of its path), _block (start of its split), _row.

    With a `prefix` the columns carry it, so that no name of theirs can clash with the operator's own. A frame that isn't
    a plain scan is written to the scratch folder first; an operator that locates its rows twice settles them before.
    """
    light_batches(docs.sparkSession)
    meta = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.row_index").alias("_row")]
    picked = [quoted(c).alias(prefix + c) for c in columns]
    if is_scan(docs):
        return docs.select(*picked, *meta)
    return write_table(docs.select(*picked), "rows").select(*[quoted(prefix + c) for c in columns], *meta)


def is_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a file: a scan under projections and deterministic filters, nothing else."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.file_block_start", "_metadata.row_index").schema  # noqa: B018  resolves the hidden columns
    except AnalysisException:
        return False
    return True


def settled(docs: DataFrame) -> DataFrame:
    """docs if it is a plain scan, else its rows written to the scratch folder, so that all passes see the same ones."""
    return docs if is_scan(docs) else write_table(docs, "rows")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unprefixed(rows: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """The columns that `located` gave a prefix, by their own names."""
    return rows.select(*[quoted(prefix + c).alias(c) for c in columns])


def narrow_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with a written table of narrow rows: broadcast while its counted rows are few, else by shuffle."""
    return left.join(F.broadcast(right) if fits_broadcast(right) else right, keys, how)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    x = (x ^ (x >> U64(32))) * MIX1
    x = (x ^ (x >> U64(29))) * MIX2
    return x ^ (x >> U64(32))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of a string or binary array (vocabulary-sized: one call per value)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.to_numpy(zero_copy_only=False)), U64, len(values))


#: Bytes that end a word become a space, A-Z become a-z; bytes from 0x80 on belong to words.
_TABLE = np.array([32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def plain_words(texts: pa.Array) -> pa.Array:
    """Texts with their words in lower case and everything else turned into spaces, by one table look-up a byte."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    _, offsets, data = texts.buffers()
    fresh = _TABLE[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(fresh)], offset=texts.offset)


class Words:
    """The words of a batch of texts: `codes` into `vocabulary`, text i owning codes[starts[i]:starts[i+1]]."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        flat = pc.list_flatten(split)
        full = pc.not_equal(flat, "")
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        offsets = split.offsets.to_numpy()
        self.starts = ends[offsets - offsets[0]].astype(np.int64)
        coded = pc.filter(flat, full).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.vocabulary = coded.dictionary

    def hashes(self) -> np.ndarray:
        return hash_strings(self.vocabulary)[self.codes] if len(self.codes) else np.zeros(0, U64)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` hashes, by start; shorter than `hashes` by width - 1."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, U64)
    for i in range(width):
        out = mix64(out + hashes[i : i + n] + MIX1)
    return out


def release() -> None:
    """Give freed memory back: Python workers live on between stages, beside other workers and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def sized_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, keys: tuple[str, ...] = ()) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about `most_bytes` of `column`; a table never mixes values of `keys`.

    A single row beyond the size makes a table of its own, so memory is bounded by the size or the longest text.
    """
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        marks = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            marks[1:] |= v[1:] != v[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
        at, begun = 0, 0
        while at < batch.num_rows:
            if at > begun and marks[at] or size and size + lengths[at] > most_bytes:
                if at > begun:
                    held.append(batch.slice(begun, at - begun))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, begun = [], 0, at
            size += int(lengths[at])
            at += 1
        if at > begun:
            held.append(batch.slice(begun, at - begun))
    if held:
        yield pa.Table.from_batches(held)
    release()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From rows sorted by `key`: tables that hold each key's rows together."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        column = table.column(key)
        last = column[-1]
        same = pc.equal(column, last).to_numpy()
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()
    release()


def column(table: pa.Table, name: str) -> pa.Array:
    out = table.column(name).combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)
