"""Files to modules, modules to domains, roles and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.session import write_table


def module_key(files: DataFrame, roots: list[str]) -> DataFrame:
    """files with `key`: the longest root that is the path or above it, and the next segment; else the first segment or root.

    Roots are configuration, so the longest is found by a chain of conditions, longest first, and no join is needed.
    """
    path = text.slashed(F.col("path"))
    segments = F.split(path, "/")
    key = F.when(F.size(segments) > 1, segments[0]).otherwise("root")
    for root in sorted(roots, key=len):
        below = F.substring_index(F.substring(path, len(root) + 2, 1 << 20), "/", 1)
        inner = F.when(below == "", root).otherwise(F.concat(F.lit(f"{root}/"), below))
        key = F.when(path == root, root).when(path.startswith(f"{root}/"), inner).otherwise(key)
    return files.withColumn("key", key)


def count_modules(keyed: DataFrame) -> DataFrame:
    """(key, file_count, first_ord)."""
    return keyed.groupBy("key").agg(F.count("*").alias("file_count"), F.min("ord").alias("first_ord"))


def domain_of(path: Column, hints: list[tuple[str, list[str]]] | None = None) -> Column:
    """STRUCT(domain, keyword): hints first, then the default domains; the first keyword found wins."""
    lowered = F.lower(path)
    found = F.struct(F.lit("Other").alias("domain"), F.lit(None).cast("string").alias("keyword"))
    pairs = [(d, k) for d, ks in [*(hints or []), *rules.DOMAINS] for k in ks]
    # one pass of a regex finds whether any keyword is there at all; then the ordered list decides which
    hits = F.filter(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(k).alias("keyword")) for d, k in pairs]), lambda x: lowered.contains(x["keyword"]))
    return F.coalesce(F.get(hits, F.lit(0)), found)


def longest_prefix(left: DataFrame, modules: DataFrame, column: str) -> DataFrame:
    """left with `module`: equal key, with or without extension, else the longest key above it; ties go to the first in order.

    Each path is expanded into its own prefixes, so the range join is an equi-join that shuffles on the prefix.
    """
    parts = F.split(text.slashed(F.col(column)), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), (i == F.size(parts)).alias("exact")))
    rows = write_table(left.withColumn("_id", F.monotonically_increasing_id()), "numbered")  # both sides of the join must see the same ids
    spread = rows.select("_id", F.explode(prefixes).alias("p")).select("_id", "p.prefix", "p.exact")
    bare = F.regexp_replace("key", r"\.[^/.]+$", "")
    keys = modules.select(F.col("key"), F.col("first_ord"), F.explode(F.array_distinct(F.array("key", bare))).alias("prefix"))
    found = spread.join(keys, "prefix")
    best = found.groupBy("_id").agg(F.max_by("key", F.struct("exact", F.when(F.col("exact"), 0).otherwise(F.length("key")), -F.col("first_ord"))).alias("module"))
    return rows.join(best, "_id", "left").drop("_id")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, fan_in, fan_out) for all nodes (key); edges (src, dst)."""
    ins = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("fan_in"))
    outs = edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("fan_out"))
    joined = nodes.join(ins, "key", "left").join(outs, "key", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fan_in", "fan_out")})


def with_roles(measured: DataFrame, least: int = 3, share: float = 0.05) -> DataFrame:
    """(…, fan_in, fan_out) with is_hub, is_orphan, is_leaf, is_orchestrator and the role in words."""
    total = measured.agg(F.count("*")).scalar()  # a scalar subquery: a window over all rows would be one task
    hub = F.col("fan_in") >= F.greatest(F.lit(least), F.floor(total * share))
    i, o = F.col("fan_in"), F.col("fan_out")
    flagged = measured.withColumns({"is_hub": hub, "is_orphan": (i == 0) & (o == 0), "is_leaf": (o == 0) & (i > 0), "is_orchestrator": (o >= 5) & (i < o)})
    return flagged.withColumn("role", role_of())


def role_of() -> Column:
    i = F.col("fan_in")
    return (
        F.when(F.col("is_orphan"), "isolated").when(F.col("is_hub") & (i >= 15), "critical shared").when(F.col("is_hub"), "shared")
        .when(F.col("is_orchestrator"), "orchestrator").when(F.col("is_leaf"), "leaf").when((i > 0) & (F.col("fan_out") > 0), "connector")
    )


def file_health() -> Column:
    """0 to 100 from complexity, max_function, fan_in, fan_out, exports, coverage, high and medium findings."""
    c, f, k = F.col("complexity"), F.col("max_function"), F.col("fan_in") * F.col("fan_out")
    lost = F.when(c > 10, F.least(F.lit(25), c - 10)).otherwise(0)
    lost += F.when(c > 30, F.least(F.lit(15), (c - 30) * 2)).otherwise(0)
    lost += F.when(f > 8, F.least(F.lit(15), (f - 8) * 2)).otherwise(0)
    lost += F.when(k > 20, F.least(F.lit(15), F.floor((k - 20) / 5))).otherwise(0)
    lost += F.when(F.col("exports") > 0, F.when(F.col("coverage") < 0.5, 10).when(F.col("coverage") < 0.8, 5).otherwise(0)).otherwise(0)
    lost += F.col("high") * 10 + F.col("medium") * 5
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost)).cast("long")


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").when(score >= 20, "D").otherwise("F")


def repository_health() -> Column:
    """0 to 100 from cycles, orphans, files, externals, edges and has_tests."""
    share = F.col("orphans") / F.greatest(F.col("files"), F.lit(1))
    score = F.lit(100) - F.least(F.lit(30), F.col("cycles") * 10) - F.when(share > 0.2, 20).when(share > 0.1, 10).otherwise(0)
    score = score - F.when(F.col("externals") > 100, 15).when(F.col("externals") > 50, 5).otherwise(0) - F.when(F.col("has_tests"), 0).otherwise(10)
    score = F.when((F.col("cycles") == 0) & (F.col("edges") > 0), F.least(F.lit(100), score + 5)).otherwise(score)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


def documentation_health() -> Column:
    x = F.col("coverage") * 0.35 + F.col("freshness") * 0.25 + F.col("quality") * 0.25 + F.col("completeness") * 0.15
    return text.half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))).cast("long")


def owners(paths: DataFrame, owner_rules: list[tuple[int, str, list[str]]]) -> DataFrame:
    """paths with `owners` of the last ownership rule (ord, pattern, owners) that matches; empty if none does."""
    path = text.slashed(F.col("path"))
    found = F.array().cast("array<string>")
    for _, pattern, names in sorted(owner_rules):
        found = F.when(owned(path, pattern), F.array(*map(F.lit, names))).otherwise(found)
    return paths.withColumn("owners", found)


def owned(path: Column, pattern: str) -> Column:
    clean = pattern.removeprefix("/")
    if clean.endswith("/"):
        return path.startswith(clean) | path.contains(f"/{clean}")
    return path.rlike(glob_regex(clean))


def glob_regex(pattern: str) -> str:
    """Only dots are escaped; ** spans folders, * stays in one; a pattern without a slash matches a segment anywhere."""
    body = ".*".join("[^/]*".join(x.split("*")) for x in pattern.replace(".", "\\.").split("**"))
    return f"(^|/){body}$" if "/" in pattern else f"(^|/){body}($|/)"
