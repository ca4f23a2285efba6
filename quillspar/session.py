"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[*]", **extra: str) -> SparkSession:
    """A session with this library's defaults; `extra` overrides them (dots written as __)."""
    conf = DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a fresh local one only where it is unset on a single machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspar-"))
    return sc._jsc.sc().getCheckpointDir().get()


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/quillspar/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by write_table that nothing reads any more."""
    path = getattr(df, "_quill_path", None)
    if path:
        drop_path(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that operators have written to the scratch folder; their frames can't be read any more."""
    drop_path(spark, f"{scratch_root(spark).rstrip('/')}/quillspar")


#: A written table beyond either bound is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small enough to be sent to every executor, by its files' bytes and its counted rows."""
    path = getattr(table, "_quill_path", None)
    if path:
        jvm, jsc = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(jsc.hadoopConfiguration()).getContentSummary(at).getLength() > max_bytes:
            return False
    return table.limit(max_rows + 1).count() <= max_rows
