"""Closest known keys for words, from an index of deletions instead of distances to every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this length a word meets keys by its deletions; beyond, by pieces of the keys.
SHORT = 20


def _shorter(strings: Column) -> Column:
    """All strings that one deletion makes of some strings of one length."""
    cut = lambda v, i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v)))
    return F.array_distinct(F.flatten(F.transform(F.filter(strings, lambda v: v != ""), lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: cut(v, i)))))


def deletions(df: DataFrame, column: str, most: int) -> DataFrame:
    """(column, v): each string that up to `most` deletions make of a string. Two strings within that distance share one."""
    levels = [f"_{i}" for i in range(most + 1)]
    out = df.select(column, F.array(column).alias(levels[0]))
    for before, after in zip(levels, levels[1:], strict=False):  # columns, so that a level is made once
        out = out.withColumn(after, _shorter(F.col(before)))
    return out.select(column, F.explode(F.concat(*levels)).alias("v"))


def _piece(n: Column, i: int, most: int) -> tuple[Column, Column]:
    """Start (from 0) and length of piece i of most + 1 even pieces of a string of n characters."""
    start, end = F.floor(n * i / (most + 1)), F.floor(n * (i + 1) / (most + 1))
    return start.cast("int"), (end - start).cast("int")


def _pairs(words: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """Pairs (w, k) that may lie within `most` edits: none that does is missing, some come several times.

    Short words share a string of deletions with such a key. Of a key's most + 1 pieces at least one stands unchanged in a
    longer word, moved by at most `most` places.
    """
    w, k = F.length("w"), F.length("k")
    short, near = deletions(words.filter(w <= SHORT), "w", most), deletions(keys.filter(k <= SHORT + most), "k", most)
    by_deletions = short.join(near, "v").select("w", "k")
    pieces, places = [], []
    for i in range(most + 1):
        start, size = _piece(k, i, most)
        pieces.append(F.struct(F.lit(i).alias("i"), F.col("k").substr(start + 1, size).alias("v")))
        for longer in range(-most, most + 1):
            start, size = _piece(w + longer, i, most)
            for moved in range(-most, most + 1):
                at = start + moved
                places.append(F.when((at >= 0) & (at + size <= w), F.struct((w + longer).alias("n"), F.lit(i).alias("i"), F.col("w").substr(at + 1, size).alias("v"))))
    cut = keys.filter(k > SHORT - most).select("k", k.alias("n"), F.explode(F.array(*pieces)).alias("p")).select("k", "n", "p.i", "p.v")
    seen = words.filter(w > SHORT).select("w", F.explode(F.array_distinct(F.array_compact(F.array(*places)))).alias("p")).select("w", "p.n", "p.i", "p.v")
    return by_deletions.unionByName(seen.join(cut, ["n", "i", "v"]).select("w", "k"))


def closest_known(words: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """words with the known key (ord, key) at the smallest edit distance, up to `most`, letter case aside.

    The least ord wins ties. Words without such a key, and null ones, have no suggestion and no distance; rows that repeat
    a word stay. Null keys are left out. Both sides may be large: they meet by equal strings only.
    """
    keys = known.filter("key IS NOT NULL").groupBy(F.lower("key").alias("k")).agg(F.min(F.struct("ord", "key")).alias("first"))
    lower = words.filter("word IS NOT NULL").select(F.lower("word").alias("w")).distinct()
    scored = _pairs(lower, keys.select("k"), most).withColumn("distance", F.levenshtein("w", "k", most)).filter("distance >= 0").distinct()
    best = scored.join(keys, "k").groupBy("w").agg(F.min(F.struct("distance", "first")).alias("best"))
    out = words.withColumn("_w", F.lower("word")).join(best, F.col("_w") == F.col("w"), "left")
    return out.select(*[words[c] for c in words.columns], F.col("best.first.key").alias("suggestion"), F.col("best.distance").cast("int").alias("distance"))
