"""Source divergence audit: how far the sources of a language part in their use of terms, and by which terms.

Null text, lang and source count as ''. Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased. A language
keeps the V terms that at least LEAST of its documents hold. A group (lang, source) gives a kept term of `count` places
there p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N its places of kept terms; q is a language's own p. The divergence of
two such numbers is f = floor((p - q)^2 / (p + q)). Everything is counted over whole texts and in whole numbers.

Postings (lang, source, term, count) are added up in tasks before they are shuffled. Terms that stand out are searched
under upper bounds: a group's terms of equal count share p, so the smallest language count among them bounds f of the whole
bucket; buckets are opened best first, a block of terms at a time, until the bounds of all that are left lie strictly below
the k-th value found. Pairs of sources are added up from the postings: terms that neither has count as a number, terms
that one has come from its buckets, and only terms that both have are met (a pair of postings for each pair of sources
that share a term, which the result lists anyway). No table, or no kept terms: every pair of sources has 0, and no terms.
Repeated rows are documents of their own; ids and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.common import Words, column, light_batches, sized_batches
from quillspar.session import drop_table, write_table

LEAST, TOP, UNIT = 10, 10, 1_000_000_000
BATCH_BYTES = 12 << 20
#: Terms a group opens in its first block, and how many times as many in each that follows.
FIRST, GROWTH = 16, 8

#: Letters stay (A-Z in lower case), bytes from 0x80 on too; all else parts terms.
_TABLE = np.array([b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256)], np.uint8)


def _lettered(texts: pa.Array) -> pa.Array:
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    _, offsets, data = texts.buffers()
    fresh = _TABLE[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(fresh)], offset=texts.offset)


def count_batch(table: pa.Table) -> pa.RecordBatch:
    """(lang, source, term, count, docs) of a batch of documents."""
    words = Words(_lettered(column(table, "text")), lower=False)
    langs, sources = (column(table, c).dictionary_encode() for c in ("lang", "source"))
    n_sources, n_terms = max(len(sources.dictionary), 1), max(len(words.vocabulary), 1)
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    owner = np.repeat(np.arange(table.num_rows), np.diff(words.starts))
    in_document, counts = np.unique(owner * n_terms + words.codes, return_counts=True)
    key, at = np.unique(group[in_document // n_terms] * n_terms + in_document % n_terms, return_inverse=True)
    total, docs = np.bincount(at, counts, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    group, term = key // n_terms, key % n_terms
    columns = [langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)), words.vocabulary.take(pa.array(term)), pa.array(total), pa.array(docs.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): places of each term in each group, and documents that hold it."""
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sized_batches(batches, "text", BATCH_BYTES):
            yield count_batch(table)

    parts = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def parts_of(count: Column, places: Column, terms: Column) -> Column:
    """p of a count in a group of so many places, in a language of so many kept terms; in decimals, as counts grow."""
    wide = lambda c: c.cast("decimal(20,0)")
    share = F.call_function("div", wide(count + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(places + 2 * terms))
    return (share + 1).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Counts:
    """The written tables of a corpus: kept postings with p and q, buckets, and one row a group."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
        raw = write_table(count_terms(named), "terms")
        kept = raw.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).filter(F.col("docs") >= least).drop("docs")
        posted = write_table(raw.drop("docs").join(kept, ["lang", "term"]), "postings")
        drop_table(raw)
        places = posted.groupBy("lang", "source").agg(F.sum("count").alias("places"))
        groups = named.select("lang", "source").distinct().join(places, ["lang", "source"], "left").fillna(0, ["places"])
        terms = posted.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
        langs = groups.groupBy("lang").agg(F.sum("places").alias("lang_places")).join(terms, "lang", "left").fillna(0, ["terms"])
        #: lang, source, places, lang_places, terms
        self.groups = write_table(groups.join(langs, "lang"), "groups")
        sized = posted.join(self.groups, ["lang", "source"])
        p, q = parts_of(F.col("count"), F.col("places"), F.col("terms")), parts_of(F.col("lang_count"), F.col("lang_places"), F.col("terms"))
        #: lang, source, term, count, p, q
        self.postings = write_table(sized.select("lang", "source", "term", "count", p.alias("p"), q.alias("q")), "shares")
        drop_table(posted)
        buckets = self.postings.groupBy("lang", "source", "count").agg(F.first("p").alias("p"), F.min("q").alias("least_q"), F.max("q").alias("most_q"), F.count("*").alias("size"))
        #: lang, source, count, p, least_q, most_q, size: a group's terms of equal count
        self.buckets = write_table(buckets, "buckets")


def top_terms(counts: Counts, k: int = TOP) -> DataFrame:
    """(lang, source, term, value): a group's terms with p > q by value, all that reach its k-th value, best first search."""
    group = Window.partitionBy("lang", "source")
    bound = F.when(F.col("p") > F.col("least_q"), apart(F.col("p"), F.col("least_q")))
    ranked = counts.buckets.withColumn("bound", bound).filter("bound is not null")
    opened = F.sum("size").over(group.orderBy(F.desc("bound"), "count").rowsBetween(Window.unboundedPreceding, -1))
    left = write_table(ranked.withColumn("before", F.coalesce(opened, F.lit(0))).select("lang", "source", "count", "bound", "before"), "bounds")
    found, low, high = None, 0, FIRST
    while True:
        # the block: buckets next in the order of bounds that may still hold a term among the first k of their group
        block = left.filter(F.col("before").between(low, high - 1))
        if found is not None:
            block = block.join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth").drop("kth")  # noqa: F821
        rows = counts.postings.join(block.select("lang", "source", "count"), ["lang", "source", "count"]).filter("p > q")
        rows = rows.select("lang", "source", "term", apart(F.col("p"), F.col("q")).alias("value"))
        rows = rows if found is None else rows.unionByName(found)
        best = rows.withColumn("place", F.row_number().over(group.orderBy(F.desc("value"), "term"))).filter(F.col("place") <= k).drop("place")
        best = write_table(best, "best")
        if found is not None:
            drop_table(found)
        found, low, high = best, high, high * GROWTH
        kth = found.groupBy("lang", "source").agg(F.when(F.count("*") == k, F.min("value")).alias("kth"))
        open_ = left.filter(F.col("before") >= low).join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth")
        if open_.isEmpty():
            drop_table(left)
            return found


def source_pairs(counts: Counts) -> DataFrame:
    """(lang, source, other, value): f added up over all kept terms, for each ordered pair of a language's sources."""
    idle = parts_of(F.lit(0).cast("long"), F.col("places"), F.col("terms"))
    rest = F.when(F.col("terms") > 0, idle).otherwise(F.lit(1))  # p of a kept term that the group lacks
    group = counts.groups.select("lang", "source", "terms", rest.alias("rest"))
    mine, theirs = group, group.select("lang", F.col("source").alias("other"), F.col("rest").alias("other_rest"))
    pairs = mine.join(theirs, "lang").filter("source <> other")
    neither = pairs.select("lang", "source", "other", (F.col("terms") * apart(F.col("rest"), F.col("other_rest"))).alias("value"))
    # a term that one of the two has: what its p adds beyond that of a term that neither has
    alone = counts.buckets.join(pairs, ["lang", "source"])
    alone = alone.withColumn("value", F.col("size") * (apart(F.col("p"), F.col("other_rest")) - apart(F.col("rest"), F.col("other_rest"))))
    alone = alone.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    # a term that both have: what is left to add beyond the two
    own = counts.postings.join(group.select("lang", "source", "rest"), ["lang", "source"]).select("lang", "term", "source", "p", "rest")
    met = own.join(own.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("rest").alias("other_rest")), ["lang", "term"]).filter("source < other")
    p, a, q, b = (F.col(c) for c in ("p", "rest", "other_p", "other_rest"))
    both = met.select("lang", "source", "other", (apart(p, q) - apart(p, b) - apart(a, q) + apart(a, b)).alias("value")).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    flipped = lambda df: df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    out = neither.unionByName(alone).unionByName(flipped(alone)).unionByName(both).unionByName(flipped(both))
    return out.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, k: int = TOP, least: int = LEAST) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` for all other sources, part `term` to rank k."""
    counts = Counts(docs, least)
    terms = top_terms(counts, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = source_pairs(counts).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return terms.unionByName(pairs).withColumn("rank", F.row_number().over(order))


ORACLE = r"""
WITH named AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
said AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM named),
kept AS (SELECT lang, term, count(*) AS lang_count FROM said GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
counted AS (SELECT lang, source, term, count(*) AS n FROM said GROUP BY lang, source, term),
vocabulary AS (SELECT lang, count(*) AS v, sum(lang_count) AS places FROM kept GROUP BY lang),
grouped AS (SELECT DISTINCT lang, source FROM named),
full_counts AS (
  SELECT g.lang, g.source, k.term, k.lang_count, coalesce(c.n, 0) AS n
  FROM grouped g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS places FROM full_counts),
shares AS (
  SELECT s.lang, s.source, s.term, s.n,
    CAST(1 + (1000000000::HUGEINT * (s.n + 2)) // (s.places + 2 * v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (s.lang_count + 2)) // (v.places + 2 * v.v) AS BIGINT) AS q
  FROM sized s JOIN vocabulary v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM valued)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
