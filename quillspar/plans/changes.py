"""Queries over snapshots, caches, histories, limits and text hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.operators import changes as c
from quillspar.operators import spelling
from quillspar.plans.base import query, sql_in
from quillspar.plans.structure import FILES, files
from quillspar.sources.adapters import quoted, read, sql_values, values

_MONTHS = ("1995-03", "1995-04")
_SNAP = "(SELECT 'modules' AS dimension, 'c' || o_custkey AS item FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '{0}' UNION SELECT 'frameworks', o_orderpriority || o_orderstatus || (o_custkey % 40) FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '{0}')"


def snapshot(spark: SparkSession, sf_dir: str, month: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").filter(F.date_format("o_orderdate", "yyyy-MM") == month)
    modules = orders.select(F.lit("modules").alias("dimension"), F.concat(F.lit("c"), "o_custkey").alias("item"))
    return modules.union(orders.select(F.lit("frameworks"), F.concat("o_orderpriority", "o_orderstatus", F.pmod("o_custkey", F.lit(40))))).distinct()


@query(f"""WITH a AS {_SNAP.format(_MONTHS[0])}, b AS {_SNAP.format(_MONTHS[1])}, d AS (
  SELECT dimension, 'added' AS change, 'info' AS severity, item FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
  UNION ALL SELECT dimension, 'removed', CASE WHEN dimension = 'frameworks' THEN 'critical' ELSE 'warning' END, item FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
SELECT dimension, change, severity, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM d GROUP BY 1, 2, 3""")
def drift(spark, sf_dir):
    return c.set_drift(*(snapshot(spark, sf_dir, m) for m in _MONTHS))


_SIZES = "(SELECT 'p' || o_orderpriority || (o_custkey % 25) AS item, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '{}' GROUP BY 1)"


@query(f"""SELECT item, was, "is", CAST(floor(ratio * 100 + 0.5) AS BIGINT) AS percent, CASE WHEN ratio > 1.0 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT item, a.n AS was, b.n AS "is", CAST(abs(b.n - a.n) AS DOUBLE) / a.n AS ratio FROM {_SIZES.format(_MONTHS[0])} a JOIN {_SIZES.format(_MONTHS[1])} b USING (item)) WHERE ratio > 0.5""")
def size_drift(spark, sf_dir):
    def counts(month: str) -> DataFrame:
        orders = read(spark, sf_dir, "orders").filter(F.date_format("o_orderdate", "yyyy-MM") == month)
        return orders.groupBy(F.concat(F.lit("p"), "o_orderpriority", F.pmod("o_custkey", F.lit(25))).alias("item")).agg(F.count("*").alias("n"))

    return c.size_drift(*(counts(m) for m in _MONTHS))


_CYCLES = [(1, 0, 2), (2, 3, 1), (3, 2, 2)]


@query(f"SELECT id, CASE WHEN now > was THEN 'warning' WHEN now < was THEN 'info' END AS severity FROM {sql_values(_CYCLES, 'id, was, now')}")
def cycle_drift(spark, sf_dir):
    return values(spark, _CYCLES, "id int, was int, now int").select("id", c.count_drift(F.col("was"), F.col("now")).alias("severity"))


@query("SELECT doc_id AS key, sha256(coalesce(text, '')) AS hash, CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 7 = 0 THEN true ELSE false END AS changed FROM documents")
def document_hashes(spark, sf_dir):
    current = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("content"))
    cached = current.filter("key % 5 <> 0").select("key", F.sha2(F.when(F.col("key") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("hash"))
    return c.changed_hashes(cached, current)


@query("SELECT doc_id AS key FROM documents WHERE doc_id % 5 = 0")
def documents_to_publish(spark, sf_dir):
    current = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("content"))
    cached = current.filter("key % 5 <> 0").select("key", F.sha2("content", 256).alias("hash"))
    return c.publishable(c.changed_hashes(cached, current)).select("key")


_NOISE, _ROOTS = quoted(rules.NOISE), sql_in(rules.IMPACT_ROOTS)
_CHANGES = f"(SELECT CASE ord % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS status, path AS file FROM {FILES})"
_ROUTE = "CASE WHEN contains(file, '/app/') THEN '/' || regexp_replace(regexp_replace(regexp_replace(substr(file, instr(file, '/app/') + 5), '/page\\.(ts|tsx|js|jsx)$', ''), '/route\\.(ts|tsx|js|jsx)$', ''), '\\[(.*?)\\]', ':\\1', 'g') WHEN contains(file, '/pages/api/') THEN '/api/' || regexp_replace(substr(file, instr(file, '/pages/api/') + 11), '\\.(ts|tsx|js|jsx)$', '') ELSE file END"
_ISROUTE = "(contains(file, '/pages/api/') OR regexp_matches(file, '/route\\.(ts|js)$|/page\\.(tsx|jsx|ts|js)$'))"


def change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("A"), F.lit("D"), F.lit("R100"), F.lit("M")), F.pmod("ord", F.lit(4)).cast("int") + 1)
    return files(spark, sf_dir).select(c.change_status(code).alias("status"), F.col("path").alias("file"))


@query(f"SELECT status, file, CASE WHEN {_ISROUTE} AND status <> 'modified' THEN {_ROUTE} END AS route, regexp_matches(file, {_NOISE}) AS noise, 'src/' || split_part(file, '/', 3) AS module FROM {_CHANGES}")
def change_impact(spark, sf_dir):
    return c.enriched(change_list(spark, sf_dir))


@query(f"SELECT DISTINCT 'src/' || split_part(file, '/', 3) AS module FROM {_CHANGES} WHERE NOT regexp_matches(file, {_NOISE})")
def impacted_modules(spark, sf_dir):
    return c.enriched(change_list(spark, sf_dir)).select("module").filter("module IS NOT NULL").distinct().orderBy("module")


_DAYS = "(SELECT CAST(ts AS DATE) AS ts, round(avg(value), 6) AS coverage, round(max(value), 6) AS health FROM events GROUP BY 1)"


@query(f"""SELECT CAST(ts AS VARCHAR) AS ts, round(c, 1) AS coverage_change, CASE WHEN c > 1 THEN 'up' WHEN c < -1 THEN 'down' ELSE 'stable' END AS coverage_trend, round(h, 0) AS health_change, CASE WHEN h > 2 THEN 'up' WHEN h < -2 THEN 'down' ELSE 'stable' END AS health_trend
FROM (SELECT ts, coverage - lag(coverage) OVER (ORDER BY ts) AS c, health - lag(health) OVER (ORDER BY ts) AS h FROM {_DAYS}) ORDER BY ts DESC LIMIT 1""")
def metric_trend(spark, sf_dir):
    history = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("ts")).agg(F.round(F.avg("value"), 6).alias("coverage"), F.round(F.max("value"), 6).alias("health"))
    return c.trend(history).withColumn("ts", F.col("ts").cast("string"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 90")
def retained_history(spark, sf_dir):
    return c.retained(read(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "user_id")


_OWN = "(SELECT o_orderkey AS file, o_orderdate AS mtime FROM orders)"
_DAYSINCE = "floor((epoch(TIMESTAMP '1998-09-01') - epoch({})) / 86400)"


@query(f"SELECT arg_max(file, (mtime, file)) AS newest, CAST({_DAYSINCE.format('max(mtime)')} AS BIGINT) AS days, {_DAYSINCE.format('max(mtime)')} > 90 AS stale, CAST(floor(greatest(0.0, 100.0 - {_DAYSINCE.format('max(mtime)')} / 90.0 * 100) + 0.5) AS BIGINT) AS score, count(*) FILTER (WHERE {_DAYSINCE.format('mtime')} > 90) AS stale_files FROM {_OWN}")
def document_staleness(spark, sf_dir):
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderdate").alias("mtime"))
    return c.staleness(docs, F.to_timestamp(F.lit("1998-09-01 00:00:00")))


_ISSUES = [("a", "high", 3), ("b", "medium", 9), ("c", "low", 1), ("d", "low", 0)]


@query("SELECT CAST(100 - 30 - 25 - 2 AS BIGINT) AS score, CAST(3 AS BIGINT) AS issues")
def quality_score(spark, sf_dir):
    return c.quality(values(spark, _ISSUES, "type string, severity string, n long"))


@query("SELECT 100.0 * count(*) FILTER (WHERE length(text) > 500) / count(*) * 0.5 + 30 + 100.0 * count(*) FILTER (WHERE lang = 'en') / count(*) * 0.2 AS coverage FROM documents")
def weighted_coverage(spark, sf_dir):
    share = lambda x: F.try_divide(100.0 * F.count_if(x), F.count("*"))
    found = read(spark, sf_dir, "documents").agg(share(F.length("text") > 500).alias("m"), share(F.col("lang") == "en").alias("p"))
    return found.select(c.weighted_coverage(F.col("m"), F.lit(None).cast("double"), F.col("p")).alias("coverage"))


_MADE = [(k, "text" if i % 3 else " ") for i, k in enumerate(rules.DOCUMENT_KEYS)] + [("code_health", "x")]


@query(f"SELECT key AS missing FROM {sql_values([(k,) for k in rules.DOCUMENT_KEYS], 'key')} WHERE key NOT IN (SELECT key FROM {sql_values(_MADE, 'key, content')} WHERE trim(content) <> '')")
def missing_documents(spark, sf_dir):
    known = values(spark, [(k,) for k in rules.DOCUMENT_KEYS], "missing string")
    made = values(spark, _MADE, "missing string, content string").filter(F.trim("content") != "")
    return known.join(made, "missing", "left_anti")


@query("""SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst""")
def debounced_bursts(spark, sf_dir):
    out = c.debounced(read(spark, sf_dir, "events"), "user_id", "ts", "2 hours")
    short = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", "n", short("first").alias("first"), short("last").alias("last"))


@query()
def rate_limited_calls(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return c.rate_limited(calls, "user_id", 2, 3_600_000)


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 50) AS BIGINT) AS batch FROM events")
def request_batches(spark, sf_dir):
    return c.batches(read(spark, sf_dir, "events").select("event_id"), "event_id", 50)


@query("SELECT CAST(least(30000, 1000 * pow(2, attempt - 1)) AS DOUBLE) AS delay_ms, attempt FROM range(1, 7) AS t(attempt)")
def retry_delays(spark, sf_dir):
    return spark.range(1).select(F.posexplode(c.delays(1000, 2, 30000, 6)).alias("i", "delay_ms")).select("delay_ms", (F.col("i") + 1).cast("long").alias("attempt"))


@query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'updated' ELSE 'kept' END AS action FROM supplier UNION ALL SELECT -n_nationkey - 1, 'created' FROM nation")
def comment_upsert(spark, sf_dir):
    have = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("body"))
    new = have.filter("key % 2 = 0").union(read(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long"), "n_name"))
    return c.upsert(have, new, "key").select("key", "action")


_KNOWN = ["include", "ignore", "publishers", "notion", "domains", "features"]
_WORDS = [("includes",), ("ignor",), ("Publishers",), ("motion",), ("zzzzzzzz",), ("feature",), ("doman",)]


@query(f"""SELECT word, CASE WHEN d <= 3 THEN k END AS suggestion, CASE WHEN d <= 3 THEN d END AS distance FROM (SELECT word, arg_min(key, levenshtein(lower(word), lower(key)) * 100 + ord) AS k, min(levenshtein(lower(word), lower(key))) AS d
FROM {sql_values(_WORDS, 'word')}, {sql_values(list(enumerate(_KNOWN)), 'ord, key')} GROUP BY word)""")
def closest_keys(spark, sf_dir):
    return c.closest(values(spark, _WORDS, "word string"), _KNOWN)


_VOCABULARY = "(SELECT DISTINCT unnest(regexp_extract_all({}, '[A-Za-z]+')) AS {} FROM {})"


@query(f"""SELECT word, CASE WHEN min(d) <= 3 THEN arg_min(key, (d, key)) END AS suggestion, CASE WHEN min(d) <= 3 THEN CAST(min(d) AS INT) END AS distance
FROM (SELECT word, key, levenshtein(lower(word), lower(key)) AS d FROM {_VOCABULARY.format('text', 'word', 'benchmark')}, {_VOCABULARY.format('text', 'key', 'conversations')}) GROUP BY word""")
def closest_words(spark, sf_dir):
    """For each word of the benchmark the closest word of the conversations."""
    found = lambda t, name: read(spark, sf_dir, t).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias(name)).distinct()
    known = found("conversations", "key")
    return spelling.closest_known(found("benchmark", "word"), known.select(F.col("key").alias("ord"), "key"))


_VERSIONS = [("1.2.3", "1.2.3"), ("1.2", "1.2.1"), ("2.0.0", "1.9.9"), ("1.10.0", "1.9.0")]


@query("SELECT * FROM (VALUES ('1.2.3', '1.2.3', 0), ('1.2', '1.2.1', -1), ('2.0.0', '1.9.9', 1), ('1.10.0', '1.9.0', 1)) AS v(a, b, compared)")
def version_order(spark, sf_dir):
    return values(spark, _VERSIONS, "a string, b string").select("a", "b", c.version_compare(F.col("a"), F.col("b")).alias("compared"))


@query(f"SELECT page_id AS context, error FROM (SELECT page_id, unnest({[*rules.SHELL_CHARACTERS]!r}) AS error, url FROM pages) WHERE contains(url, error) UNION ALL SELECT page_id, 'substitution' FROM pages WHERE contains(url, '$(') OR contains(url, '${{')".replace("{{", "{"))
def injection_errors(spark, sf_dir):
    return c.injection_errors(read(spark, sf_dir, "pages").select(F.col("page_id").alias("context"), F.col("url").alias("value"))).select("context", "error")


_SAFE = [("docs/a.md",), ("../x",), ("/etc/passwd",), ("C:\\x",), (None,)]


@query(f"SELECT path, CASE WHEN path IS NULL THEN 'not_a_string' WHEN contains(path, '..') THEN 'traversal' WHEN starts_with(path, '/') OR regexp_matches(path, '^[a-zA-Z]:') THEN 'absolute' END AS error FROM {sql_values(_SAFE, 'path')}")
def safe_paths(spark, sf_dir):
    return values(spark, _SAFE, "path string").select("path", text.safe_path_error(F.col("path")).alias("error"))


_NOTIFY = [(1, "always", 0.0), (2, "never", 50.0), (3, "significant", None), (4, "significant", -12.0), (5, "significant", 3.0)]


@query(f"SELECT id, CASE policy WHEN 'always' THEN true WHEN 'never' THEN false ELSE change IS NULL OR abs(change) >= 10 END AS notify FROM {sql_values(_NOTIFY, 'id, policy, change')}")
def notifications(spark, sf_dir):
    return values(spark, _NOTIFY, "id int, policy string, change double").select("id", c.should_notify(F.col("policy"), F.col("change"), 10.0).alias("notify"))


@query("SELECT DISTINCT source AS branch, regexp_matches(source, '^src1.*$|^src7$') AS allowed FROM documents")
def allowed_branches(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("source").alias("branch"), c.branch_allowed(F.col("source"), ["src1*", "src7"]).alias("allowed")).distinct()


_BRANCHES = [("Feature/Auth_2",), ("release/1.2",), ("main",)]


@query("SELECT * FROM (VALUES ('Feature/Auth_2', 'feature-auth_2'), ('release/1.2', 'release-12'), ('main', 'main')) AS v(branch, slug)")
def branch_slugs(spark, sf_dir):
    return values(spark, _BRANCHES, "branch string").select("branch", c.branch_slug(F.col("branch")).alias("slug"))


@query("SELECT user_id, substr(CAST(1000000000 + user_id AS VARCHAR), 1, 4) || '***' || right(CAST(1000000000 + user_id AS VARCHAR), 4) AS masked FROM (SELECT DISTINCT user_id FROM events)")
def masked_ids(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id").distinct().select("user_id", c.masked((F.lit(1000000000) + F.col("user_id")).cast("string")).alias("masked"))
