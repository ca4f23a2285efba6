"""Architecture baselines: built from facts in long form, saved run by run, loaded, and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions import text
from quillspar.operators import changes

#: A snapshot's rows: sets have items, counts have n; a module's size is a count by item.
SCHEMA = "dimension string, item string, n long"
SETS = ("modules", "api", "pages", "dependencies", "frameworks")


def snapshot(modules: DataFrame, files: int | Column, sets: dict[str, DataFrame], counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of SCHEMA from modules (key, file_count), named sets of one column, and named counts of one row."""
    rows = modules.select(F.lit("modules").alias("dimension"), F.col("key").alias("item"), F.col("file_count").cast("long").alias("n"))
    total = F.lit(files) if isinstance(files, int) else files
    rows = rows.union(modules.agg(F.first(total).cast("long").alias("n")).select(F.lit("files"), F.lit(None).cast("string"), "n"))
    for name, items in sets.items():
        rows = rows.union(items.distinct().select(F.lit(name), F.col(items.columns[0]).cast("string"), F.lit(None).cast("long")))
    for name, one in (counts or {}).items():
        rows = rows.union(one.select(F.lit(name), F.lit(None).cast("string"), F.col(one.columns[0]).cast("long")))
    return rows


def save(rows: DataFrame, root: str, run: int) -> None:
    """Append a run's snapshot; earlier runs stay, so the one that is being compared with is never overwritten."""
    rows.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/run={run}")


def load(spark: SparkSession, root: str, run: int | None = None) -> DataFrame | None:
    """The snapshot of a run, or of the last one; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = [int(s.getPath().getName()[4:]) for s in fs.listStatus(at) if s.getPath().getName()[:4] == "run=" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    known = [r for r in found if run is None or r == run]
    return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/run={max(known)}") if known else None


def _count(rows: DataFrame, name: str) -> Column:
    return F.coalesce(rows.filter(F.col("dimension") == name).agg(F.max("n")).scalar(), F.lit(0))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, type, severity, items) of all that differs between two snapshots."""
    inside = lambda rows: rows.filter(F.col("dimension").isin(*SETS)).select("dimension", "item")
    found = changes.set_drift(inside(before), inside(after)).select(F.col("dimension").alias("category"), F.col("change").alias("type"), "severity", "items")
    sizes = lambda rows: rows.filter("dimension = 'modules'").select("item", "n")
    grown = changes.size_drift(sizes(before), sizes(after))
    found = found.union(grown.select(F.lit("modules"), F.lit("size-change"), "severity", F.format_string("%s: %d to %d files (+%d%%)", "item", "was", "is", "percent")))
    one = before.sparkSession.range(1)
    cycles = one.select(_count(before, "cycles").alias("was"), _count(after, "cycles").alias("is")).filter("was <> is")
    found = found.union(cycles.select(F.lit("cycles"), F.when(F.col("is") > F.col("was"), "increased").otherwise("decreased"), changes.count_drift(F.col("was"), F.col("is")), F.format_string("%d to %d", "was", "is")))
    schema = changes.set_drift(*(rows.filter("dimension = 'graphql'").select("dimension", "item") for rows in (before, after)))
    part = lambda change, sign: F.max(F.when(F.col("change") == change, F.concat(F.lit(sign), F.col("n").cast("string"), F.lit(" types: "), "items")))
    merged = schema.agg(part("added", "+").alias("a"), part("removed", "-").alias("r")).filter("a IS NOT NULL OR r IS NOT NULL")
    found = found.union(merged.select(F.lit("graphql"), F.lit("schema-changed"), F.when(F.col("r").isNotNull(), "warning").otherwise("info"), F.concat_ws("; ", "a", "r")))
    scale = one.select(_count(before, "files").alias("was"), _count(after, "files").alias("is")).filter("was > 0 AND is > 0")
    ratio = F.abs(F.col("is") - F.col("was")) / F.col("was")
    words = F.format_string("%d to %d files (%s%d%%)", "was", "is", F.when(F.col("is") > F.col("was"), "+").otherwise(""), text.half_up(ratio * 100).cast("long"))
    return found.union(scale.filter(ratio > 0.2).select(F.lit("scale"), F.lit("file-count-change"), F.when(ratio > 0.5, "warning").otherwise("info"), words))


def drift_summary(found: DataFrame) -> DataFrame:
    """One row: drifts by severity, and the same in words."""
    totals = found.agg(F.count("*").alias("drifts"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    words = F.format_string("%d drifts: %d critical, %d warnings, %d informational", "drifts", "critical", "warning", "info")
    return totals.withColumn("summary", F.when(F.col("drifts") > 0, words).otherwise("no drift"))


def run_over_run(spark: SparkSession, rows: DataFrame, root: str, run: int) -> DataFrame | None:
    """Drift of a run against the last saved one (None without one); the run is saved either way."""
    before = load(spark, root)
    save(rows, root, run)
    return None if before is None else drift(before, load(spark, root, run))
