"""Quality rules by cross-document line frequency.

Each line is lower-cased, its ASCII white space collapsed, and hashed; lines without a word don't count. A document is
known by one hash of the whole set of its lines, so copies are one document. Per host (the source) a line counts the
distinct documents that hold it. A line in more than max(`min_documents`, `max_share` of the host's distinct documents)
is boilerplate and removed. A document is rejected if the base rules fail, or if more than `depleted_percent` of its words
stood in removed lines.

Null text: no words, rejected by the base rules. Null host: a host of its own. Repeated rows: each is judged alone and
they count as one document. Empty tables give none. Extra columns of any name are kept by `clean`. Memory: batches of
about 3 MB of text, or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm.common import U64, Words, column, grams, hash_strings, located, mix64, narrow_join, quoted, settled, sized_batches
from quillspar.session import write_table

MIN_DOCUMENTS, MAX_SHARE, DEPLETED_PERCENT = 10, 0.01, 70
MIN_WORDS, REPEAT_PERCENT = 50, 50
BATCH_BYTES = 3 << 20
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def normal_lines(lines: pa.Array) -> pa.Array:
    return pc.ascii_trim(pc.replace_substring_regex(pc.utf8_lower(lines), r"[\x20\x09-\x0D]+", " "), " ")


def line_hashes(lines: pa.Array) -> np.ndarray:
    return hash_strings(normal_lines(lines)).astype(np.int64)


def repeated_words(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: the words inside 3-word windows that the text holds twice or more."""
    n = len(starts) - 1
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    inside = owner[:-2] == owner[2:]
    at = np.flatnonzero(inside)
    keys = mix64(grams(hashes, 3)[at] + mix64(owner[at].astype(U64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(hashes), bool)
    for i in range(3):
        marked[at[twice] + i] = True
    return np.bincount(owner[marked], minlength=n)


def measure(texts: pa.Array) -> dict[str, pa.Array]:
    """The base measures and the distinct lines of each text: hashes, words, and the xor of the hashes."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    words = Words(texts, lower=False)
    counts = np.diff(words.starts)
    owner = np.repeat(np.arange(n), counts)
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {
        "n_words": counts,
        "word_chars": np.bincount(owner, chars[words.codes], n).astype(np.int64) if len(owner) else np.zeros(n, np.int64),
        "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy().astype(np.int64),
        "n_repeat_words": repeated_words(words.hashes(), words.starts),
    }
    split = pc.split_pattern(texts, "\n")
    coded = pc.list_flatten(split).dictionary_encode()
    lines, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    own_words = np.diff(Words(lines, lower=False).starts)
    line_owner = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    full = own_words[codes] > 0
    codes, line_owner = codes[full], line_owner[full]
    pairs = np.unique(line_owner * len(lines) + codes) if len(codes) else np.zeros(0, np.int64)
    out["n_dup_lines"] = np.bincount(line_owner, minlength=n) - np.bincount(pairs // max(1, len(lines)), minlength=n)
    hashes = line_hashes(lines)
    # lines of a text that are equal once normalised are one line, with their words added up
    order = np.lexsort((hashes[codes], line_owner))
    held, who, many = hashes[codes][order], line_owner[order], own_words[codes][order]
    new = np.ones(len(held), bool)
    new[1:] = (held[1:] != held[:-1]) | (who[1:] != who[:-1])
    first = np.flatnonzero(new)
    summed = np.add.reduceat(many, first) if len(first) else np.zeros(0, np.int64)
    each = np.bincount(who[first], minlength=n)
    offsets = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
    held = held[first]
    whole = np.zeros(n, np.int64)
    whole[each > 0] = np.bitwise_xor.reduceat(held, offsets[:-1][each > 0]) if len(held) else 0
    arrays = {k: pa.array(v, pa.int64()) for k, v in out.items()}
    arrays["lines"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(held, pa.int64()))
    arrays["line_words"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(summed.astype(np.int64), pa.int64()))
    arrays["whole"] = pa.array(whole)
    return arrays


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sized_batches(batches, "text", BATCH_BYTES):
        found = measure(column(table, "text"))
        rows = {k: column(table, k) for k in ("doc_id", "source", "_file", "_row")} | {k: found[k] for k in (*MEASURES, "lines", "line_words", "whole")}
        yield from pa.table(rows).to_batches()


def judge(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, depleted_percent: int = DEPLETED_PERCENT) -> DataFrame:
    """Per row: its identity (_file, _row), doc_id, the measures, base_failed, removed (line hashes), removed_words, kept."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = located(docs.withColumn("source", F.col(host)) if host != "source" else docs, ["doc_id", "source", "text"]).drop("_block")
    schema = f"doc_id {kind}, source string, _file long, _row long, {', '.join(f'{m} long' for m in MEASURES)}, lines array<long>, line_words array<long>, whole long"
    measured = write_table(rows.withColumn("source", F.col("source").cast("string")).mapInArrow(_measured, schema), "lines")
    measured = measured.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    held = measured.select("source", "_file", "_row", "whole", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    held = held.select("source", "_file", "_row", "whole", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    # one row of each distinct document: what it holds is counted by plain partial sums, however large its host is
    one = write_table(measured.filter(F.size("lines") > 0).groupBy("source", "whole").agg(F.first("lines").alias("lines")), "distinct")
    limits = one.groupBy("source").agg(F.greatest(F.lit(float(min_documents)), F.lit(max_share) * F.count("*")).alias("most"))
    limits = write_table(limits, "hosts")
    known = one.select("source", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count("*").alias("documents"))
    known = known.filter(F.col("documents") > min_documents)
    common = write_table(narrow_join(known, limits, ["source"], "inner").filter("documents > most").select("source", "line"), "common")
    lost = narrow_join(held, common, ["source", "line"], "inner").groupBy("_file", "_row").agg(F.collect_list("line").alias("removed"), F.sum("words").alias("removed_words"))
    lost = write_table(lost, "lost")
    out = narrow_join(measured.select("doc_id", "_file", "_row", *MEASURES), lost, ["_file", "_row"], "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") * 100 <= F.col("n_words") * depleted_percent))


def _stripped(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = batch.column("gone").to_pylist()
            at = columns.index("text")
            arrays = [batch.column(f"c{i}") for i in range(len(columns))]
            if any(removed):
                texts = arrays[at].to_pylist()
                for i, gone in enumerate(removed):
                    if gone and texts[i]:
                        parts, gone = texts[i].split("\n"), set(gone)
                        hashes = line_hashes(pa.array(parts, pa.string()))
                        texts[i] = "\n".join(p for p, h in zip(parts, hashes.tolist(), strict=True) if h not in gone)
                arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def clean(docs: DataFrame, **options: object) -> DataFrame:
    """The kept documents, with docs' columns, their texts without the removed lines."""
    docs = settled(docs)
    verdicts = judge(docs, **options)
    touched = write_table(verdicts.filter(~F.col("kept") | (F.col("removed_words") > 0)).select("_file", "_row", "kept", "removed"), "touched")
    names = docs.columns
    rows = located(docs, names, "d_").drop("_block")
    joined = narrow_join(rows, touched, ["_file", "_row"], "left").filter(F.coalesce("kept", F.lit(True)))
    joined = joined.select(*[quoted(f"d_{c}").alias(f"c{i}") for i, c in enumerate(names)], F.col("removed").alias("gone"))
    return joined.mapInArrow(_stripped(names), docs.schema)


ORACLE = rf"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM rows),
tokens AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
windows AS (SELECT rid, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM tokens WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM windows WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, w2, w3) > 1),
again AS (SELECT rid, CAST(count(DISTINCT i + k) AS BIGINT) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY rid),
sums AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM tokens GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rows),
lines AS (
  SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal FROM raw),
dups AS (SELECT rid, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM lines WHERE words > 0 GROUP BY rid),
held AS (SELECT rid, normal, sum(words) AS words FROM lines WHERE words > 0 GROUP BY rid, normal),
sets AS (SELECT rid, host, md5(string_agg(normal, chr(10) ORDER BY normal)) AS whole FROM held JOIN rows USING (rid) GROUP BY rid, host),
limits AS (SELECT host, greatest({MIN_DOCUMENTS}, {MAX_SHARE}::DOUBLE * count(DISTINCT whole)) AS most FROM sets GROUP BY host),
common AS (
  SELECT host, normal FROM held JOIN sets USING (rid) JOIN limits USING (host) GROUP BY host, normal, most HAVING count(DISTINCT whole) > most),
lost AS (SELECT rid, CAST(sum(words) AS BIGINT) AS removed_words FROM held JOIN sets USING (rid) JOIN common USING (host, normal) GROUP BY rid),
judged AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM rows LEFT JOIN sums USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN again USING (rid) LEFT JOIN lost USING (rid)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND 100 * removed_words <= {DEPLETED_PERCENT} * n_words AS kept FROM based
"""
