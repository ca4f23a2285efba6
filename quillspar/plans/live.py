"""Queries over tables that are kept under changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspar.plans.base import query
from quillspar.session import scratch_root
from quillspar.sources import versions
from quillspar.sources.adapters import CODE, code, read
from quillspar.streaming.outbox import Outbox, Policy
from quillspar.streaming.rebuild import LiveFacts


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/quillspar/{name}-{uuid.uuid4().hex}"


@query(f"""WITH alive AS (SELECT d, key FROM {CODE} WHERE d % 10 <> 3),
e AS (SELECT DISTINCT c.key AS src, t.key AS dst FROM alive c, (VALUES (0), (1), (2)) AS v(i) JOIN alive t ON t.d = c.d // (i + 2) WHERE c.d % 4 > i AND t.d < c.d AND c.d % 10 <> 4),
ends AS (SELECT dst AS key, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e)
SELECT key, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, (SELECT count(*) FROM {CODE} WHERE d % 10 = 4 OR d % 20 = 7) AS parsed FROM ends GROUP BY key""")
def rebuilt_degrees(spark, sf_dir):
    """Degrees after two batches: all files but a twentieth; then a tenth goes, a tenth is emptied, and the twentieth comes."""
    live, d = LiveFacts(spark, _folder(spark, "live")), F.col("ord")
    files = code(spark, sf_dir).select("ord", "path", "content", F.lit(False).alias("deleted"), F.lit(0).alias("seq"))
    live.apply(files.filter(d % 20 != 7).drop("ord"), 0)
    later = files.filter((d % 10).isin(3, 4) | (d % 20 == 7))
    later = later.select("path", F.when(d % 10 == 4, "").otherwise(F.col("content")).alias("content"), (d % 10 == 3).alias("deleted"), F.lit(1).alias("seq"))
    at = live.apply(later, 1)
    return live.table("degrees", at).withColumn("parsed", F.lit(at.meta["parsed"]).cast("long"))


@query("""SELECT url, coalesce(min(page_id) FILTER (WHERE page_id % 3 = 0), min(page_id)) AS page_id, CASE WHEN bool_or(page_id % 3 = 0) THEN 'updated' ELSE 'created' END AS state
FROM pages GROUP BY url""")
def upserted_pages(spark, sf_dir):
    """Pages by url, created in one version and a third of them updated in the next."""
    pages = read(spark, sf_dir, "pages").select("url", "page_id")
    store = versions.Store(spark, _folder(spark, "pages"), {"pages": versions.Table("url string, page_id long, state string", ("url",), ("url",))})
    versions.upsert(store, "pages", pages.withColumn("state", F.lit("created")))
    at = versions.upsert(store, "pages", pages.filter("page_id % 3 = 0").withColumn("state", F.lit("updated")))
    return store.read("pages", at)


def _answer(key: str, payload: str, attempt: int) -> tuple[int | None, float | None]:
    """A receiver that takes half of what it gets, by key and attempt."""
    turn = (int(key) * 7 + attempt * 3) % 10
    return (200, None) if turn < 5 else {5: (503, None), 6: (500, None), 7: (429, 7.0), 8: (404, None), 9: (502, None)}[turn]


@query("""WITH RECURSIVE calls AS (SELECT event_id AS id, 0 AS attempt, CAST(0 AS BIGINT) AS due_ms FROM events UNION ALL
SELECT id, attempt + 1, CAST(10000 * attempt + CASE WHEN (id * 7 + attempt * 3) % 10 = 7 THEN 7000 ELSE least(4000, 500 * pow(2, attempt)) + CAST('0x' || substr(md5(id || ':' || attempt), 1, 8) AS BIGINT) % 250 END AS BIGINT)
FROM calls WHERE attempt < 3 AND (id * 7 + attempt * 3) % 10 IN (5, 6, 7, 9))
SELECT CAST(id AS VARCHAR) AS key, CASE WHEN turn < 5 THEN 'sent' ELSE 'dead' END AS state, attempt + 1 AS attempts, CASE turn WHEN 5 THEN 503 WHEN 6 THEN 500 WHEN 7 THEN 429 WHEN 8 THEN 404 WHEN 9 THEN 502 ELSE 200 END AS status, due_ms, CAST(10000 * attempt AS BIGINT) AS at_ms
FROM (SELECT *, (id * 7 + attempt * 3) % 10 AS turn FROM calls) WHERE turn < 5 OR turn = 8 OR attempt = 3""")
def deliveries(spark, sf_dir):
    """All events sent to a receiver that fails by turns, looked at every ten seconds until none is left."""
    box = Outbox(spark, _folder(spark, "outbox"), _answer, Policy(retries=3, base_ms=500, most_ms=4000, jitter_ms=250))
    box.add(read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("payload")), 0, 0)
    for now in range(0, 40_000, 10_000):
        box.deliver(now)
    sent, dead = (box.table(t).select("key", F.lit(t).alias("state"), "attempts", "status", "due_ms", "at_ms") for t in ("sent", "dead"))
    return sent.unionByName(dead)
