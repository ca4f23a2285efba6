"""Facts of a repository kept by path, edges and degrees corrected by what changed: rebuilds that cost what a change costs.

A batch holds rows (path, content, deleted, seq); of a path's rows the one with the greatest seq counts. Files whose content
is the one already held are left alone; the others are parsed, and nothing else is. Everything derived is then corrected by
rows added and withdrawn (+1 and -1): how often a file key imports a target, how many files carry a key, which edges stand
(an import of a key that some code file carries), and the degrees. A file that comes or goes moves the edges of files that
import it without their being read: they are looked up by target.

All tables of a batch are committed as one version that names the batch, so a batch given again changes nothing, and a
batch that failed half-way is done again from the version before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspar.functions import rules, text
from quillspar.operators import parsing
from quillspar.session import drop_table, write_table
from quillspar.sources.versions import BUCKETS, Change, Snapshot, Store, Table

_BY_PATH = ("path",)
TABLES = {
    "files": Table("path string, hash string, key string", _BY_PATH, _BY_PATH),
    "imports": Table("path string, specifier string, target string, package string", ("path", "specifier"), _BY_PATH),
    "measures": Table("path string, complexity long, lines long, functions long, max_function long", _BY_PATH, _BY_PATH),
    "findings": Table("path string, id string, severity string, cwe string, line long", ("path", "id", "line"), _BY_PATH),
    "exports": Table("path string, name string, kind string, line long, description string, params string, returns string, deprecated string", ("path", "line", "kind"), _BY_PATH),
    "keys": Table("key string, files long", ("key",), ("key",)),
    "links": Table("target string, src string, imports long", ("target", "src"), ("target",)),
    "edges": Table("src string, dst string", ("src", "dst"), ("src",)),
    "degrees": Table("key string, fan_in long, fan_out long", ("key",), ("key",)),
}
PARSED = ("imports", "measures", "findings", "exports")


def parse(files: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = write_table) -> dict[str, DataFrame]:
    """The facts of files (path, content), by table, from one parse that `keep` writes."""
    known = keep(parsing.parsed(files), "parsed")
    each = lambda c: known.select("path", F.explode(c).alias("x")).select("path", "x.*")
    imports = parsing.resolved(known.select("path", F.explode("specifiers").alias("specifier")))
    return {"imports": imports, "measures": known.filter("analysed").select("path", "measures.*"), "findings": each("findings"), "exports": each("exports")}


def code_key(path: Column) -> Column:
    return F.when(text.extension(path).isin(*rules.CODE_EXTENSIONS), text.file_key(path))


class LiveFacts:
    """Fact tables in a store, moved from version to version by batches of changes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.store = Store(spark, root, TABLES, buckets)

    def table(self, name: str, at: Snapshot | None = None) -> DataFrame:
        return self.store.read(name, at or self.store.snapshot())

    def apply(self, changes: DataFrame, batch: int) -> Snapshot:
        """Take in a batch; batches have growing numbers, and one that is not above the last is taken for done."""
        base = self.store.snapshot()
        if base.version and batch <= base.meta["batch"]:
            return base
        made: list[DataFrame] = []

        def kept(df: DataFrame, tag: str) -> DataFrame:
            made.append(write_table(df, tag))
            return made[-1]

        last = changes.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "seq").alias("c"))
        last = last.select("path", F.coalesce("c.content", F.lit("")).alias("content"), F.coalesce("c.deleted", F.lit(False)).alias("deleted"))
        last = kept(last.withColumn("hash", F.sha2("content", 256)), "batch")
        held = self.store.near("files", base, last).select("path", F.col("hash").alias("old_hash"), F.col("key").alias("old_key"))
        both = last.join(held, "path", "left")
        moved = both.filter((F.col("deleted") & F.col("old_hash").isNotNull()) | (~F.col("deleted") & ~F.col("hash").eqNullSafe(F.col("old_hash"))))
        fresh = parse(moved.filter("NOT deleted").select("path", "content"), kept)
        moved = kept(moved.drop("content").withColumn("key", F.when(~F.col("deleted"), code_key(F.col("path")))), "moved")
        gone, live = moved.select("path"), moved.filter("NOT deleted")
        fresh["imports"] = kept(fresh["imports"], "imports")
        where = self.store.touched("files", gone)

        # imports by target, as counts that this batch adds or takes away
        source = text.file_key(F.col("path"))
        was = self.store.read("imports", base, where).join(gone, "path", "left_semi")
        pairs = lambda df, n: df.filter("target IS NOT NULL").select("target", source.alias("src"), F.lit(n).alias("n"))
        links = pairs(was, -1).unionByName(pairs(fresh["imports"], 1)).groupBy("target", "src").agg(F.sum("n").alias("d")).filter("d <> 0")
        old_links = self.store.near("links", base, links).withColumnRenamed("imports", "old")
        link_rows = links.join(old_links, ["target", "src"], "left").select("target", "src", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("d")).alias("imports"))
        link_rows = kept(link_rows, "links")

        # files by key
        keys = moved.filter("old_key IS NOT NULL").select(F.col("old_key").alias("key"), F.lit(-1).alias("n")).unionByName(moved.filter("key IS NOT NULL").select("key", F.lit(1).alias("n")))
        keys = keys.groupBy("key").agg(F.sum("n").alias("d")).filter("d <> 0")
        old_keys = self.store.near("keys", base, keys).withColumnRenamed("files", "old")
        key_rows = keys.join(old_keys, "key", "left").select("key", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("d")).alias("files"))
        key_rows = kept(key_rows, "keys")
        turned = key_rows.filter("(old > 0) <> (files > 0)").select(F.col("key").alias("target"))

        # the pairs whose edge may come or go: those whose imports changed, and all that name a key that came or went
        named = self.store.near("links", base, turned).join(turned, "target", "left_semi").join(link_rows.select("target", "src"), ["target", "src"], "left_anti")
        touched = link_rows.select("target", "src", "old", "imports").unionByName(named.select("target", "src", F.col("imports").alias("old"), "imports"))
        touched = kept(touched, "touched")
        near = self.store.near("keys", base, touched.select(F.col("target").alias("key"))).select(F.col("key").alias("target"), F.col("files").alias("held"))
        now = key_rows.select(F.col("key").alias("target"), F.col("old").alias("files_old"), F.col("files").alias("files_new"))
        known = touched.join(near, "target", "left").join(now, "target", "left")
        before = (F.col("old") > 0) & (F.coalesce("files_old", "held", F.lit(0)) > 0)
        after = (F.col("imports") > 0) & (F.coalesce("files_new", "held", F.lit(0)) > 0)
        flips = kept(known.filter(before != after).select("src", F.col("target").alias("dst"), F.when(after, 1).otherwise(-1).alias("n")), "flips")

        ends = flips.select(F.col("dst").alias("key"), F.col("n").alias("i"), F.lit(0).alias("o")).unionByName(flips.select(F.col("src").alias("key"), F.lit(0).alias("i"), F.col("n").alias("o")))
        ends = ends.groupBy("key").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        old = self.store.near("degrees", base, ends)
        grown = ends.join(old, "key", "left").select("key", (F.coalesce("fan_in", F.lit(0)) + F.col("i")).alias("fan_in"), (F.coalesce("fan_out", F.lit(0)) + F.col("o")).alias("fan_out"))

        changed = {
            "files": Change(gone, live.select("path", "hash", "key"), where),
            **{t: Change(gone, fresh[t], where) for t in PARSED},
            "links": Change(link_rows.select("target", "src"), link_rows.filter("imports > 0").select("target", "src", "imports")),
            "keys": Change(key_rows.select("key"), key_rows.filter("files > 0").select("key", "files")),
            "edges": Change(flips.filter("n < 0").select("src", "dst"), flips.filter("n > 0").select("src", "dst")),
            "degrees": Change(ends.select("key"), grown.filter("fan_in > 0 OR fan_out > 0")),
        }
        out = self.store.commit(base, changed, {"batch": batch, "parsed": live.count()})
        for df in made:
            drop_table(df)
        return out

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in a stream of changes, each micro-batch as one batch."""

        def take(batch: DataFrame, number: int) -> None:
            self.apply(batch, number)

        return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
