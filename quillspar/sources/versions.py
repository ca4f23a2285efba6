"""Keyed tables with a log of versions: a write replaces only the buckets it touches, and readers stay on one version.

A store is a folder: `log/` holds one small JSON file a version, which names for each table its columns, its keys and the
Parquet files' folder of each bucket; `data/` holds the folders. A commit writes the touched buckets' new rows beside the old
ones and then adds the next log file. Whoever adds it first wins; the other gets `Conflict` and can begin again from the
new version. A write that fails leaves folders that no version names, and the old version is read as before.
"""

from __future__ import annotations

import functools
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspar.session import drop_path, drop_table, write_table

BUCKETS = 16
#: Tables of a commit that are written at the same time.
AT_ONCE = 4


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


@dataclass(frozen=True)
class Table:
    """A table's columns (DDL), the columns that identify a row, and those of them that choose its bucket."""

    schema: str
    keys: tuple[str, ...]
    by: tuple[str, ...]

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Change:
    """Rows to go, by the table's keys or some of them that include `by`, and rows to come.

    Both are read twice unless `where` names the buckets that they lie in: frames that are dear or may change are written first.
    """

    gone: DataFrame | None = None
    rows: DataFrame | None = None
    where: list[int] | None = None


@dataclass(frozen=True)
class Snapshot:
    version: int
    folders: dict[str, dict[int, str]] = field(default_factory=dict)
    meta: dict[str, object] = field(default_factory=dict)


class Store:
    """Tables in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = BUCKETS):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def _listed(self, name: str) -> list[str]:
        at = self._path(name)
        fs = at.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._listed("log") if n.endswith(".json") and n[0].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The latest version, or the one named; version 0 is the empty store."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Snapshot(0)
        stream = self._path("log").getFileSystem(self._conf).open(self._path(f"log/{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Snapshot(version, {t: {int(b): p for b, p in folders.items()} for t, folders in held["folders"].items()}, held["meta"])

    def read(self, name: str, at: Snapshot, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a snapshot; only some of its buckets' folders if they are named."""
        folders = at.folders.get(name, {})
        wanted = [p for b, p in sorted(folders.items()) if buckets is None or b in buckets]
        schema = self.tables[name].schema
        if not wanted:
            return self.spark.range(0).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in StructType.fromDDL(schema)])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{p}" for p in wanted])

    def touched(self, name: str, *frames: DataFrame | None) -> list[int]:
        """The buckets of some rows: numbers below `buckets`."""
        found: set[int] = set()
        for df in frames:
            if df is not None:
                found |= {r[0] for r in df.select(self.tables[name].bucket(self.buckets)).distinct().collect()}
        return sorted(found)

    def near(self, name: str, at: Snapshot, rows: DataFrame) -> DataFrame:
        """The table's buckets in which the rows' keys lie (rows hold the table's `by` columns)."""
        return self.read(name, at, self.touched(name, rows))

    def commit(self, base: Snapshot, changes: dict[str, Change], meta: dict[str, object] | None = None) -> Snapshot:
        """The next version after `base`: each table without the rows that go and with those that come.

        The frames of a change may read from the store itself, as no folder of an earlier version is touched. Raises
        Conflict if another version followed `base` first.
        """
        folders = {t: dict(f) for t, f in base.folders.items()}
        with ThreadPoolExecutor(AT_ONCE) as pool:  # the tables' writes don't depend on each other
            for name, written in zip(changes, pool.map(lambda t: self._written(t, base, changes[t]), changes), strict=True):
                own = folders.setdefault(name, {})
                for b, folder in written.items():
                    own.pop(b, None)
                    if folder:
                        own[b] = folder
        return self._log(Snapshot(base.version + 1, folders, meta or {}))

    def _written(self, name: str, base: Snapshot, change: Change) -> dict[int, str | None]:
        """The new folder of each touched bucket, None for those left without rows."""
        table = self.tables[name]
        where = self.touched(name, change.rows, change.gone) if change.where is None else change.where
        if not where:
            return {}
        kept = self.read(name, base, where)
        if change.gone is not None:
            gone = change.gone.distinct()
            same = functools.reduce(lambda a, b: a & b, [kept[c].eqNullSafe(gone[c]) for c in table.keys if c in gone.columns])
            kept = kept.join(gone, same, "left_anti").select(*kept.columns)
        out = kept if change.rows is None else kept.unionByName(change.rows.select(*kept.columns))
        folder = f"{name}-{uuid.uuid4().hex}"
        # a bucket's rows go to several tasks if there are many of them
        out.withColumn("_bucket", table.bucket(self.buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{folder}")
        found = {int(n.split("=")[1]) for n in self._listed(f"data/{folder}") if n.startswith("_bucket=")}
        return {b: f"{folder}/_bucket={b}" if b in found else None for b in where}

    def _log(self, snapshot: Snapshot) -> Snapshot:
        text = json.dumps({"folders": snapshot.folders, "meta": snapshot.meta})
        held, final = self._path(f"log/.{uuid.uuid4().hex}.tmp"), self._path(f"log/{snapshot.version:012d}.json")
        fs = held.getFileSystem(self._conf)
        stream = fs.create(held, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            # as streaming queries log their batches: the rename fails if the file is there already
            self._fs.FileContext.getFileContext(held.toUri(), self._conf).rename(held, final, self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(held, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {snapshot.version} is there already") from e
            raise
        return snapshot

    def trim(self, keep: int) -> None:
        """Delete all but the last `keep` versions, and the folders that none of those names. No writer may be at work."""
        known = self.versions()
        used = {p.split("/")[0] for v in known[-keep:] for f in self.snapshot(v).folders.values() for p in f.values()}
        for v in known[:-keep]:
            drop_path(self.spark, f"{self.root}/log/{v:012d}.json")
        for name in set(self._listed("data")) - used:
            drop_path(self.spark, f"{self.root}/data/{name}")


def upsert(store: Store, name: str, rows: DataFrame, tries: int = 5) -> Snapshot:
    """Put rows into a table, each in place of the row with its keys; begun again after another writer's commit.

    Rows that repeat a key: one of them stays, the smallest by all columns.
    """
    keys = store.tables[name].keys
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else rows.distinct()
    one = write_table(one, "upsert")
    where = store.touched(name, one)
    try:
        for attempt in range(tries):
            try:
                return store.commit(store.snapshot(), {name: Change(one.select(*keys), one, where)})
            except Conflict:
                if attempt == tries - 1:
                    raise
    finally:
        drop_table(one)
    raise AssertionError
