"""Mix sources to target weights: repetition rates per source, floor copies plus one seeded coin per document.

Size of a document: its words (a null or empty text has none). Sources stand in code point order, null last, and
weigh 5, 2, 1, repeating. They share `budget` times all words by weight; a source stops at `most` times its own words
and what it leaves is shared out again by weight, until none is above (solved by one pass over the sorted caps).
Each document is emitted floor(rate) times, plus once more if the coin seeded by its doc_id falls under the fraction.

Null doc_id: tossed as the text "null". Repeated rows: each is mixed, with the same coin. Empty tables and sources
without words: target 0, nothing emitted. `mix` keeps every column of docs; its own column is named copy_no, with as many
underscores after it as it takes to be new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.llm.common import WORD, quoted
from quillspar.session import fits_broadcast, write_table

WEIGHTS, BUDGET, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD + "+", "w")
    return F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]++", "")).cast("long")


def source_rates(sizes: DataFrame, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size): one row per source."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on: the windows without keys order aggregates, not documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = each.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(float(budget)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    placed = ranked.withColumns({"place": F.row_number().over(order), "level": left / weight_left})
    open_level = F.min_by("level", F.when(F.col("ratio") > F.col("level"), F.col("place"))).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(open_level, F.lit(float("inf"))) * F.col("weight"))
    placed = placed.withColumn("target", target)
    return placed.select("source", "source_size", "target", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))


def coin(doc_id: str | Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def copies(rate: str, doc_id: str, seed: str = SEED) -> Column:
    whole = F.floor(F.col(rate))
    return (whole + (coin(doc_id, seed) < F.col(rate) - whole).cast("long")).cast("long")


def plan_sources(docs: DataFrame, budget: float = BUDGET, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and the sources' rates, both written to the scratch folder."""
    sizes = write_table(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    return sizes, write_table(source_rates(sizes, budget, most), "rates")


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with source_size, target and rate of their source; sources beyond a counted bound are joined by shuffle."""
    side = rates.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(side) if fits_broadcast(rates) else side, rows["source"].eqNullSafe(side["_source"])).drop("_source")


def weigh(docs: DataFrame, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, rate, copies, taken."""
    sizes, rates = plan_sources(docs, budget, most)
    out = with_rates(sizes, rates).withColumn("copies", copies("rate", "doc_id", seed))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, budget: float = BUDGET, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: docs' own columns and copy_no (from 1), one row per emitted copy."""
    _, rates = plan_sources(docs, budget, most)
    names, number = docs.columns, "copy_no"
    while number.lower() in {c.lower() for c in names}:
        number += "_"
    rows = docs.select("source", F.col("doc_id").alias("tossed"), *[quoted(c).alias(f"d_{c}") for c in names])
    times = copies("rate", "tossed", seed)
    out = with_rates(rows, rates).withColumn("copy_no", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))))
    return out.select(*[quoted(f"d_{c}").alias(c) for c in names], F.col("copy_no").alias(number))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
each AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM each),
capped AS (SELECT *, source_size * 2 AS cap, CAST(source_size * 2 AS DOUBLE) / weight AS ratio FROM ranked),
placed AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place,
    (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM capped),
opened AS (SELECT arg_min(level, place) AS open_level FROM placed WHERE ratio > level),
rates AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(open_level, 'inf'::DOUBLE) * weight) AS target FROM placed, opened),
tossed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    CASE WHEN r.source_size = 0 THEN 0 ELSE r.target / r.source_size END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS coin
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM tossed
"""
