"""Sources of a repository: files, manifests, workspaces, ownership rules, captured diffs, ids in urls."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.operators.changes import batches, change_status
from quillspar.sources.tree import RepositorySource, glob_to_regex  # noqa: F401

WARN_FILES, MOST_FILES = 10_000, 50_000


def tree(spark: SparkSession, root: str, include: list[str] = (), ignore: list[str] = (), content: bool = True) -> DataFrame:
    """(path, size, content) of the files below root; globs and filters on path are applied while folders are listed."""
    spark.dataSource.register(RepositorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"root": root, "include": "\n".join(include), "ignore": "\n".join(ignore), "content": str(content).lower()}
    return spark.read.format("repository").options(**options).load()


def scan(spark: SparkSession, root: str, include: list[str], ignore: list[str], most: int | None = MOST_FILES) -> DataFrame:
    """(ord, path, content) of the files below root that an include glob names and no ignore glob does; unreadable ones are empty."""
    kept = tree(spark, root, include, ignore).select("path", "content")
    if most is not None:
        n = tree(spark, root, include, ignore, content=False).count()
        if n > most:
            raise ValueError(f"{n} files match, {most} is the most; narrow the globs")
        if n > WARN_FILES:
            warnings.warn(f"{n} files match; narrower globs make reports easier to read", stacklevel=2)
    # numbers follow the paths' order; without the guardrail they are made by ranges of paths, in no single task
    if most is not None:
        return kept.withColumn("ord", F.row_number().over(Window.orderBy("path")))
    return batches(kept, "path", 1).withColumn("ord", (F.col("batch") + 1).cast("int")).drop("batch")


def _dependencies(manifest: Column) -> Column:
    maps = [F.coalesce(F.from_json(F.get_json_object(manifest, f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies", "optionalDependencies")]
    return F.array_distinct(F.concat(*map(F.map_keys, maps)))


def technologies(repo: DataFrame) -> DataFrame:
    """(kind, name): frameworks, test and build tools and languages shown by root manifests and file extensions."""
    manifest = repo.filter("path = 'package.json'").select("content", F.explode_outer(_dependencies(F.col("content"))).alias("package"))
    dim = repo.sparkSession.createDataFrame([(k, n, p) for k, n, ps in rules.PACKAGES for p in ps], "kind string, name string, package string")
    by_package = manifest.join(F.broadcast(dim), "package").select("kind", "name")  # a constant of some 60 rows
    node = manifest.filter((F.get_json_object("content", "$.type") == "module") | F.get_json_object("content", "$.bin").isNotNull() | F.get_json_object("content", "$.engines.node").isNotNull())
    files = repo.sparkSession.createDataFrame(list(rules.MANIFESTS), "path string, word string, kind string, name string")
    by_file = repo.join(F.broadcast(files), "path").filter(F.contains(F.lower("content"), F.col("word"))).select("kind", "name")
    ext = repo.sparkSession.createDataFrame(list(rules.LANGUAGES), "ext string, name string")
    by_ext = repo.withColumn("ext", text.extension(F.col("path"))).join(F.broadcast(ext), "ext").select(F.lit("language").alias("kind"), "name")
    return by_package.union(node.select(F.lit("language"), F.lit("Node.js"))).union(by_file).union(by_ext).distinct()


def pnpm_packages(repo: DataFrame) -> DataFrame:
    """Patterns listed below the key packages."""
    lines = repo.filter("path = 'pnpm-workspace.yaml'").select(F.posexplode(F.split("content", "\n")).alias("n", "line"))
    key = F.when(F.col("line").rlike(r"^\S"), F.regexp_extract("line", r"^(\S+?):", 1))
    current = lines.withColumn("key", F.last(key, ignorenulls=True).over(Window.orderBy("n")))  # one small file
    item = F.regexp_extract("line", r"^\s+-\s*['\"]?([^'\"\s]+)['\"]?\s*$", 1)
    return current.filter((F.col("key") == "packages") & (item != "")).select(item.alias("pattern"))


def workspaces(repo: DataFrame) -> DataFrame:
    """(name, path, version, dependencies) of packages; npm and yarn patterns first, then pnpm's, then Lerna's."""
    root = repo.filter("path = 'package.json'")
    listed = F.coalesce(F.from_json(F.get_json_object("content", "$.workspaces"), "array<string>"), F.from_json(F.get_json_object("content", "$.workspaces.packages"), "array<string>"))
    npm = root.select(F.lit(1).alias("prio"), F.explode(listed).alias("pattern"))
    lerna = repo.filter("path = 'lerna.json'").select(F.lit(3), F.explode(F.from_json(F.get_json_object("content", "$.packages"), "array<string>")))
    every = npm.union(pnpm_packages(repo).select(F.lit(2), "pattern")).union(lerna)
    first = every.withColumn("least", F.min("prio").over(Window.partitionBy())).filter("prio = least")
    folders = first.select(F.regexp_replace("pattern", r"/?\*.*$", "").alias("folder"))
    manifests = repo.filter(F.col("path").endswith("/package.json")).withColumn("dir", F.regexp_replace("path", "/package.json$", "")).withColumn("folder", F.regexp_replace("dir", "/[^/]*$", ""))
    found = manifests.join(folders.distinct(), "folder", "left_semi")
    name, version = F.get_json_object("content", "$.name"), F.get_json_object("content", "$.version")
    deps = F.map_keys(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>"))
    return found.select(F.coalesce(name, F.regexp_extract("dir", "[^/]*$", 0)).alias("name"), F.col("dir").alias("path"), F.coalesce(version, F.lit("0.0.0")).alias("version"), F.coalesce(F.array_join(deps, ","), F.lit("")).alias("dependencies"))


def owner_rules(repo: DataFrame) -> DataFrame:
    """(ord, pattern, owners) of the first of the usual files with a rule; owners hold @, lines without one are dropped."""
    prio = F.when(F.col("path") == "CODEOWNERS", 1).when(F.col("path") == ".github/CODEOWNERS", 2).when(F.col("path") == "docs/CODEOWNERS", 3)
    lines = repo.withColumn("prio", prio).filter("prio IS NOT NULL").select("prio", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    found = lines.filter(~F.trim("line").startswith("#")).withColumns({"pattern": parts[0], "owners": F.filter(F.slice(parts, 2, 1000), lambda x: x.contains("@"))}).filter(F.size("owners") > 0)
    found = found.withColumn("least", F.min("prio").over(Window.partitionBy())).filter("prio = least")
    return found.select(F.row_number().over(Window.orderBy("n")).alias("ord"), "pattern", F.array_join("owners", ",").alias("owners"))  # one small file


def diff(lines: DataFrame) -> DataFrame:
    """(status, file) of a captured name-status listing; renames count as modified, by the old name."""
    parts = F.split("value", "\t")
    return lines.filter(F.size(parts) > 1).select(change_status(parts[0]).alias("status"), parts[1].alias("file"))


def page_id(url: Column) -> Column:
    """32 hex digits of a page, plain or with dashes."""
    plain = F.regexp_extract(url, r"([0-9a-f]{32})(?:[?#]|$)", 1)
    dashed = F.replace(F.regexp_extract(url, r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1), F.lit("-"), F.lit(""))
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(dashed, F.lit("")))


def wiki_space(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/spaces/([^/]+)", 1), F.lit(""))


def wiki_page(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/pages/(\d+)", 1), F.lit(""))
