"""Messages that are sent again when it is time: a queue with due times, what was sent, and what was given up, in one store.

A message is sent by a client, called in tasks. An answer that may pass (the statuses of the policy, or no answer) puts the
message back with a later due time: the answer's own Retry-After if it gives one, else a delay that grows up to a bound. Jitter
is a hash of key and attempt, so a repeated run states the same times. Other failures, and the last attempt's, are dead letters.

All tables move in one version of the store. Calls are at least once: a lost executor repeats the calls of its task, with the same
key and attempt, by which a receiver can tell them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspar.operators import changes
from quillspar.session import drop_table, write_table
from quillspar.sources.versions import BUCKETS, Change, Conflict, Snapshot, Store, Table

#: (key, payload, attempt) to the status and the seconds of Retry-After, either of which may be None. May raise.
Client = Callable[[str, str, int], tuple[int | None, float | None]]

_MESSAGE, _BY_KEY = ("key", "batch"), ("key",)
TABLES = {
    "queue": Table("key string, batch long, payload string, attempt int, due_ms long", _MESSAGE, _BY_KEY),
    "sent": Table("key string, batch long, attempts int, status int, due_ms long, at_ms long", _MESSAGE, _BY_KEY),
    "dead": Table("key string, batch long, payload string, attempts int, status int, error string, due_ms long, at_ms long", _MESSAGE, _BY_KEY),
}
_ANSWERS = "key string, batch long, payload string, attempt int, due_ms long, status int, after double, error string"


@dataclass(frozen=True)
class Policy:
    retries: int = 3
    base_ms: int = 500
    most_ms: int = 4000
    factor: int = 2
    jitter_ms: int = 0

    def delay(self, key: Column, attempt: Column, after: Column) -> Column:
        """Milliseconds from an attempt (from 0) to the next one; Retry-After stands as it is, without jitter."""
        grown = F.get(changes.delays(self.base_ms, self.factor, self.most_ms, max(self.retries, 1)), attempt)
        jitter = F.conv(F.substring(F.md5(F.concat_ws(":", key, attempt.cast("string"))), 1, 8), 16, 10).cast("long") % self.jitter_ms if self.jitter_ms else F.lit(0)
        return F.when(after.isNull(), grown + jitter).otherwise(F.greatest(F.lit(0.0), after) * 1000).cast("long")


class Outbox:
    """A queue of messages in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, client: Client, policy: Policy | None = None, buckets: int = BUCKETS):
        self.store, self.client, self.policy = Store(spark, root, TABLES, buckets), client, policy or Policy()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, self.store.snapshot())

    def add(self, rows: DataFrame, batch: int, now_ms: int) -> Snapshot:
        """Messages (key, payload), due at once. Batches have growing numbers; one not above the last is taken for done.

        Rows of a batch that repeat a key are one message, of the least payload; keys must not be null.
        """
        one = write_table(rows.groupBy("key").agg(F.min("payload").alias("payload")), "messages")
        queued = one.select("key", F.lit(batch).cast("long").alias("batch"), "payload", F.lit(0).alias("attempt"), F.lit(now_ms).cast("long").alias("due_ms"))
        where = self.store.touched("queue", one)

        def change(base: Snapshot) -> Snapshot:
            if base.version and batch <= base.meta["batch"]:
                return base
            return self.store.commit(base, {"queue": Change(rows=queued, where=where)}, {"batch": batch})

        return self._again(change, one)

    def deliver(self, now_ms: int) -> Snapshot:
        """Call the client for each message that is due, and put down what came of it."""
        base, client, p = self.store.snapshot(), self.client, self.policy

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                answers: list[tuple] = []
                for key, payload, attempt in zip(*[batch.column(c).to_pylist() for c in ("key", "payload", "attempt")], strict=True):
                    try:
                        answers.append((*client(key, payload, attempt), None))
                    except Exception as e:  # whatever a client raises is an answer that did not come
                        answers.append((None, None, f"{type(e).__name__}: {e}"))
                status, after, error = zip(*answers, strict=True) if answers else ((), (), ())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.int32()), pa.array(after, pa.float64()), pa.array(error, pa.string())], names=[*batch.schema.names, "status", "after", "error"])

        due = self.store.read("queue", base).filter(F.col("due_ms") <= now_ms)
        done = write_table(due.mapInArrow(call, _ANSWERS), "answers")  # written, so that nothing calls twice
        attempts, at = (F.col("attempt") + 1).alias("attempts"), F.lit(now_ms).cast("long").alias("at_ms")
        sent = F.coalesce(F.col("status").between(200, 399), F.lit(False))
        again = (F.col("status").isNull() | changes.retryable(F.col("status"))) & (F.col("attempt") < p.retries)
        later = (F.lit(now_ms) + p.delay(F.col("key"), F.col("attempt"), F.col("after"))).alias("due_ms")
        back = done.filter(~sent & again).select("key", "batch", "payload", (F.col("attempt") + 1).alias("attempt"), later)
        where = self.store.touched("queue", done)
        parts = {
            "queue": Change(done.select(*_MESSAGE), back, where),
            "sent": Change(rows=done.filter(sent).select("key", "batch", attempts, "status", "due_ms", at), where=where),
            "dead": Change(rows=done.filter(~sent & ~again).select("key", "batch", "payload", attempts, "status", "error", "due_ms", at), where=where),
        }
        return self._again(lambda base: self.store.commit(base, parts, base.meta) if where else base, done)

    def _again(self, change: Callable[[Snapshot], Snapshot], made: DataFrame, tries: int = 5) -> Snapshot:
        """A commit, begun again after another writer's: messages are added and answered apart, so both changes stand."""
        try:
            for _ in range(tries - 1):
                try:
                    return change(self.store.snapshot())
                except Conflict:
                    continue
            return change(self.store.snapshot())
        finally:
            drop_table(made)

    def next_due(self) -> int | None:
        return self.table("queue").agg(F.min("due_ms")).first()[0]

    def drain(self, clock: Callable[[], int], sleep: Callable[[float], None] = time.sleep) -> None:
        """Deliver until the queue is empty, each message not before it is due. One drain of a folder runs at a time."""
        while (due := self.next_due()) is not None:
            if due > (now := clock()):
                sleep((due - now) / 1000)
            self.deliver(max(due, clock()))

    def follow(self, messages: DataFrame, checkpoint: str, clock: Callable[[], int], every: str = "1 second") -> StreamingQuery:
        """Take in a stream of messages (key, payload) and deliver what is due with each micro-batch; `drain` sends what is left."""

        def take(rows: DataFrame, number: int) -> None:
            self.add(rows, number, clock())
            self.deliver(clock())

        return messages.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(take).start()
