"""Snapshots, drift, change lists, caches, metrics over time, limits and batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.session import write_table


def set_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Snapshots (dimension, item) to (dimension, change, severity, n, items): one row for each kind of change that is there."""
    both = before.select("dimension", "item", F.lit(1).alias("was"), F.lit(0).alias("is")).union(after.select("dimension", "item", F.lit(0), F.lit(1)))
    each = both.groupBy("dimension", "item").agg(F.max("was").alias("was"), F.max("is").alias("is")).filter("was <> is")
    change = F.when(F.col("is") == 1, "added").otherwise("removed")
    severity = F.when(change == "added", "info").when(F.col("dimension") == "frameworks", "critical").otherwise("warning")
    named = each.select("dimension", change.alias("change"), severity.alias("severity"), "item")
    return named.groupBy("dimension", "change", "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))


def size_drift(before: DataFrame, after: DataFrame, least: float = 0.5, warn: float = 1.0) -> DataFrame:
    """Counts (item, n) that changed by more than a share of what they were, both above 0."""
    joined = before.select("item", F.col("n").alias("was")).join(after.select("item", F.col("n").alias("is")), "item").filter("was > 0 AND is > 0")
    ratio = F.abs(F.col("is") - F.col("was")) / F.col("was")
    out = joined.withColumn("ratio", ratio).filter(F.col("ratio") > least)
    return out.select("item", "was", "is", text.half_up(F.col("ratio") * 100).cast("long").alias("percent"), F.when(F.col("ratio") > warn, "warning").otherwise("info").alias("severity"))


def count_drift(was: Column, now: Column) -> Column:
    """Severity of a change in a count of cycles."""
    return F.when(now > was, "warning").when(now < was, "info")


def changed_hashes(cached: DataFrame, current: DataFrame) -> DataFrame:
    """current (key, content) with its hash and whether the cached (key, hash) differs or is missing."""
    hashed = current.withColumn("hash", F.sha2("content", 256))
    joined = hashed.join(cached.withColumnRenamed("hash", "old"), "key", "left")
    return joined.select("key", "hash", (~F.col("hash").eqNullSafe(F.col("old"))).alias("changed"))


def publishable(flagged: DataFrame, all_if_none: bool = False) -> DataFrame:
    """Changed rows; with `all_if_none`, every row where nothing changed."""
    if not all_if_none:
        return flagged.filter("changed")
    none = flagged.agg(F.coalesce(~F.max("changed"), F.lit(True))).scalar()
    return flagged.filter(F.col("changed") | none)


def change_status(code: Column) -> Column:
    """Added, removed or (with all other codes, renames by the old name) modified."""
    return F.when(code == "A", "added").when(code == "D", "removed").otherwise("modified")


def enriched(changes: DataFrame) -> DataFrame:
    """(status, file) with the route of route files, whether it is noise, and the impacted module of what isn't."""
    f = F.col("file")
    noise = f.rlike(rules.NOISE)
    return changes.withColumns({"route": F.when(text.is_changed_route(f) & F.col("status").isin("added", "removed"), text.changed_route_path(f)), "noise": noise, "module": F.when(~noise, text.impacted_module(f))})


def trend(history: DataFrame) -> DataFrame:
    """(ts, coverage, health) of the last row against the one before: changes and directions (beyond 1 and 2)."""
    order = Window.orderBy("ts")  # a history is capped by retention, so it is one small partition
    last = history.withColumns({"c": F.col("coverage") - F.lag("coverage").over(order), "h": F.col("health") - F.lag("health").over(order), "rank": F.row_number().over(Window.orderBy(F.desc("ts")))}).filter("rank = 1")
    way = lambda x, least: F.when(x > least, "up").when(x < -least, "down").otherwise("stable")
    c, h = F.coalesce("c", F.lit(0.0)), F.coalesce("h", F.lit(0.0))
    return last.select("ts", F.round(c, 1).alias("coverage_change"), way(c, 1).alias("coverage_trend"), F.round(h, 0).alias("health_change"), way(h, 2).alias("health_trend"))


def retained(history: DataFrame, key: str, order: str, keep: int = 90) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("event_id")))
    return history.withColumn("rank", rank).filter(F.col("rank") <= keep).drop("rank")


def staleness(docs: DataFrame, now: Column, limit: int = 90) -> DataFrame:
    """(newest, days, stale, score, stale_files) of (file, mtime)."""
    days = lambda t: F.floor((F.unix_timestamp(now) - F.unix_timestamp(t)) / 86400)
    found = docs.agg(F.max_by("file", F.struct("mtime", "file")).alias("newest"), F.max("mtime").alias("last"), F.count_if(days(F.col("mtime")) > limit).alias("stale_files"))
    score = text.half_up(F.greatest(F.lit(0.0), F.lit(100.0) - days(F.col("last")) / limit * 100)).cast("long")
    return found.select("newest", days(F.col("last")).alias("days"), (days(F.col("last")) > limit).alias("stale"), score.alias("score"), "stale_files")


def quality(counts: DataFrame) -> DataFrame:
    """(severity, n) issues to the score: 100 less 10, 5 or 2 for each of up to five."""
    weight = F.when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).otherwise(2)
    return counts.filter("n > 0").agg(F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(weight * F.least("n", F.lit(5))), F.lit(0))).cast("long").alias("score"), F.count("*").alias("issues"))


def weighted_coverage(modules: Column, api: Column, pages: Column) -> Column:
    return F.coalesce(modules, F.lit(0.0)) * 0.5 + F.coalesce(api, F.lit(100.0)) * 0.3 + F.coalesce(pages, F.lit(100.0)) * 0.2


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """One row for each burst: its first and last time and its events; a burst ends after `gap` without another."""
    window = F.session_window(ts, gap)
    return events.groupBy(key, window).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("session_window")


class Bucket:
    """A token bucket: refilled by whole windows gone by, if at least one has, and then counted from now."""

    def __init__(self, most: int, window: int, tokens: int | None = None, since: int | None = None):
        self.most, self.window, self.since = most, window, since
        self.tokens = most if tokens is None else tokens

    def take(self, now: int) -> bool:
        if self.since is None:
            self.since = now
        gone = now - self.since
        if gone >= self.window:
            self.tokens, self.since = min(self.most, self.tokens + gone // self.window * self.most), now
        if self.tokens > 0:
            self.tokens -= 1
            return True
        return False


def rate_limited(calls: DataFrame, key: str, most: int, window_ms: int) -> DataFrame:
    """calls (key, event_id, at_ms) with `allowed` by a bucket for each key; state goes on over a key's sorted rows.

    Rows stream by partition, sorted by key and time, so a key's rows need not fit in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, bucket = object(), None
        for pdf in batches:
            allowed = []
            for k, at in zip(pdf[key], pdf["at_ms"], strict=True):
                if k != held:
                    held, bucket = k, Bucket(most, window_ms)
                allowed.append(bucket.take(int(at)))
            yield pdf.assign(allowed=allowed)

    rows = calls.select(key, "event_id", "at_ms")
    return rows.repartition(key).sortWithinPartitions(key, "at_ms", "event_id").mapInPandas(run, rows.schema.simpleString()[7:-1] + ",allowed:boolean")


def delays(base: int, factor: int, most: int, retries: int) -> Column:
    """Waiting times before each retry: exponential, up to `most`; jitter is left to the caller."""
    return F.transform(F.sequence(F.lit(0), F.lit(retries - 1)), lambda i: F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(float(factor)), i)))


def retryable(status: Column) -> Column:
    return status.isin(429, 500, 502, 503, 504)


def batches(items: DataFrame, order: str, size: int) -> DataFrame:
    """items with a batch number of `size` rows each: ordered by ranges, written once, and numbered by the counts of the parts before."""
    ordered = items.orderBy(order).withColumn("_at", F.monotonically_increasing_id())
    placed = write_table(ordered, "ordered").withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.floor((F.col("_at") - F.col("_first") + F.col("_before")) / size)
    return placed.join(counts, "_part").withColumn("batch", number.cast("long")).drop("_at", "_part", "_n", "_first", "_before")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing with incoming's rows put in its place or added, and what was done."""
    kept = existing.join(incoming.select(key), key, "left_anti").withColumn("action", F.lit("kept"))
    done = incoming.join(existing.select(key, F.lit(True).alias("_old")), key, "left")
    return kept.unionByName(done.withColumn("action", F.when(F.col("_old"), "updated").otherwise("created")).drop("_old"))


def closest(words: DataFrame, known: list[str], most: int = 3) -> DataFrame:
    """words with the known key at the smallest edit distance, up to `most`; the first known wins ties."""
    each = F.array(*[F.struct(F.levenshtein(F.lower("word"), F.lit(k.lower())).alias("distance"), F.lit(i).alias("ord"), F.lit(k).alias("key")) for i, k in enumerate(known)])
    best = F.array_min(each)
    return words.select("word", F.when(best["distance"] <= most, best["key"]).alias("suggestion"), F.when(best["distance"] <= most, best["distance"]).alias("distance"))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by three numeric parts."""
    parts = lambda x: F.transform(F.slice(F.concat(F.split(x, r"\."), F.array(F.lit("0"), F.lit("0"), F.lit("0"))), 1, 3), lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("long"), F.lit(0)))
    x, y = parts(a), parts(b)
    out = F.lit(0)
    for i in (2, 1, 0):
        out = F.when(x[i] > y[i], 1).when(x[i] < y[i], -1).otherwise(out)
    return out


def injection_errors(strings: DataFrame) -> DataFrame:
    """(context, value) exploded by the shell characters found in it, and by command substitution."""
    hits = F.filter(F.array(*map(F.lit, rules.SHELL_CHARACTERS)), lambda c: F.contains(F.col("value"), c))
    substitution = F.when(F.col("value").contains("$(") | F.col("value").contains("${"), F.array(F.lit("substitution"))).otherwise(F.array().cast("array<string>"))
    return strings.select("context", "value", F.explode(F.concat(hits, substitution)).alias("error"))


def should_notify(policy: Column, change: Column, threshold: float) -> Column:
    return F.when(policy == "always", True).when(policy == "never", False).otherwise(change.isNull() | (F.abs(change) >= threshold))


def branch_allowed(branch: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns (exact, or with *) names the branch; no patterns allow all."""
    if not patterns:
        return F.lit(True)
    import re

    return branch.rlike("|".join("^" + ".*".join(re.escape(p) for p in x.split("*")) + "$" for x in patterns))


def branch_slug(branch: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(branch, F.lit("/"), F.lit("-")), r"[^a-zA-Z0-9_-]", ""))


def masked(column: Column) -> Column:
    return F.concat(F.substring(column, 1, 4), F.lit("***"), F.substring(column, -4, 4))
