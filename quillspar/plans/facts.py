"""Queries over the facts of source files: each document is a file whose facts its id tells, so the SQL needs no parser."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspar.functions import rules
from quillspar.operators import baselines, context, documents, facts, graph, modules, parsing, workflows
from quillspar.plans.base import query, sql_first_match
from quillspar.plans.sources_and_text import golden
from quillspar.plans.structure import _GRADE, _SCORE
from quillspar.sources import repository
from quillspar.sources.adapters import CODE, CODE_EDGES, CODE_FINDINGS, CODE_HEAD, CODE_SNIPPET, EDGES, FILES, code, edges, files, quoted, read, sql_values, values

_FACTS = f"""(SELECT key || '.js' AS file, key, 1 + nf * (d % 13) + nf * (nf - 1) // 2 AS complexity, d % 13 + nf AS max_function, fan_in, fan_out, nf AS exports,
  CASE WHEN d % 2 = 1 THEN 1.0::DOUBLE / nf ELSE 0.0::DOUBLE END AS coverage, CAST(d % 5 = 0 AS BIGINT) AS high, CAST(d % 3 = 0 AS BIGINT) AS medium, CAST(d % 5 = 0 AS BIGINT) + CAST(d % 3 = 0 AS BIGINT) + CAST(d % 7 = 0 AS BIGINT) AS findings
  FROM (SELECT c.d, c.nf, c.key, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM {CODE} c LEFT JOIN (SELECT dst AS key, count(*) AS n FROM {CODE_EDGES} GROUP BY 1) i USING (key) LEFT JOIN (SELECT src AS key, count(*) AS n FROM {CODE_EDGES} GROUP BY 1) o USING (key)))"""
HEALTH = f"(SELECT *, {_GRADE} AS grade FROM (SELECT *, CAST({_SCORE} AS BIGINT) AS score FROM {_FACTS}))"


def health(spark, sf_dir):
    return facts.code_health(code(spark, sf_dir))


@query(f"SELECT file, score, grade, complexity, max_function, fan_in, fan_out, CAST(floor(coverage * 100 + 0.5) AS BIGINT) AS doc_percent, findings, high FROM {HEALTH}")
def code_health(spark, sf_dir):
    return health(spark, sf_dir).drop("lines")


_HALF = "CAST(floor(coalesce(avg({0}), {1}) + 0.5) AS BIGINT)"


@query(f"""SELECT *, files || ' files · average ' || avg_score || ' · ' || grade_a || ' A, ' || grade_b || ' B, ' || grade_c || ' C, ' || grade_d || ' D, ' || grade_f || ' F' AS summary FROM (
  SELECT count(*) AS files, {_HALF.format('score', 100)} AS avg_score, {_HALF.format('complexity', 0)} AS avg_complexity, count(*) FILTER (WHERE score < 60) AS hotspots, {', '.join(f"count(*) FILTER (WHERE grade = '{g}') AS grade_{g.lower()}" for g in 'ABCDF')} FROM {HEALTH})""")
def code_health_totals(spark, sf_dir):
    return facts.health_totals(health(spark, sf_dir))


@query(f"SELECT path, name, line, complexity FROM (SELECT key || '.js' AS path, 'f' || i AS name, {CODE_HEAD} + 1 + i * (2 + d % 13) + i * (i - 1) // 2 AS line, 1 + d % 13 + i AS complexity, d, i FROM {CODE}, (VALUES (0), (1), (2)) AS v(i) WHERE i < nf) ORDER BY complexity DESC, path, i LIMIT 15")
def hottest_functions(spark, sf_dir):
    return facts.hottest_functions(parsing.functions(code(spark, sf_dir))).select("path", "name", "line", "complexity")


@query(f"SELECT src, dst FROM {CODE_EDGES}")
def code_import_edges(spark, sf_dir):
    return parsing.import_edges(code(spark, sf_dir))


@query(f"SELECT DISTINCT 'pkg' || (d % 7) AS package FROM {CODE} WHERE d % 2 = 0")
def code_packages(spark, sf_dir):
    return parsing.external_packages(code(spark, sf_dir))


@query(f"""SELECT path, id, category, replace(id, '-', ' ') AS name, severity, cwe, line, {CODE_SNIPPET} AS snippet FROM {CODE_FINDINGS}""")
def findings_in_place(spark, sf_dir):
    return facts.findings_in_place(code(spark, sf_dir))


@query(f"""SELECT *, findings || ' findings · ' || high || ' high · ' || medium || ' medium · ' || low || ' low · in ' || files || ' files' AS summary FROM (
  SELECT count(*) AS findings, count(DISTINCT path) AS files, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in rules.SEVERITIES)} FROM {CODE_FINDINGS})""")
def security_totals(spark, sf_dir):
    return facts.security_totals(facts.findings_in_place(code(spark, sf_dir)))


@query(f"SELECT category, count(*) AS findings, count(DISTINCT path) AS files FROM {CODE_FINDINGS} GROUP BY category")
def findings_by_category(spark, sf_dir):
    return facts.findings_by_category(facts.findings_in_place(code(spark, sf_dir)))


@query(f"SELECT *, CAST(floor(documented * 100.0 / exports + 0.5) AS BIGINT) AS percent FROM (SELECT CAST(sum(nf) AS BIGINT) AS exports, count(*) FILTER (WHERE d % 2 = 1) AS documented, count(*) FILTER (WHERE d % 10 = 1) AS deprecated, count(*) AS files FROM {CODE})")
def documentation_totals(spark, sf_dir):
    return facts.documentation_totals(parsing.exports(code(spark, sf_dir)))


@query(f"SELECT key || '.js' AS path, 'f0' AS name, 'use another' AS deprecated FROM {CODE} WHERE d % 10 = 1")
def deprecated_exports(spark, sf_dir):
    return facts.deprecated_exports(parsing.exports(code(spark, sf_dir)))


@query(f"""SELECT key || '.js' AS path, 'f0' AS name, CASE WHEN d % 10 = 1 THEN '| Part | Type | Note |' || chr(10) || '|---|---|---|' || chr(10) || '| deprecated |  | use another |' || chr(10) || '| input `a` | number | the input |' || chr(10) || chr(10) || 'Does it.' ELSE 'Does it.' END AS text FROM {CODE} WHERE d % 2 = 1""")
def documentation_texts(spark, sf_dir):
    return facts.documentation(code(spark, sf_dir)).select("path", "name", facts.documentation_text().alias("text"))


@query("SELECT 'src/m3/f3.js' AS path, 'f0' AS name, 'Does it.' AS description")
def export_lookup(spark, sf_dir):
    documented = facts.documentation(code(spark, sf_dir))
    return facts.export_doc(facts.file_docs(documented, "src/m3/f3.js"), "f0").select("path", "name", "description")


_ENTRIES = "(SELECT doc_id AS ord, 'd' || doc_id AS label, CASE doc_id % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'api' ELSE 'page' END AS kind, doc_id % 7 > 2 AS described, doc_id % 5 AS files FROM documents)"
_ISSUES = f"""(SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord) AS rank FROM (
  SELECT 'undocumented_modules' AS type, 'medium' AS severity, * FROM {_ENTRIES} WHERE kind = 'module' AND NOT described AND files > 0 UNION ALL SELECT 'undocumented_apis', 'high', * FROM {_ENTRIES} WHERE kind = 'api' AND NOT described
  UNION ALL SELECT 'undocumented_pages', 'low', * FROM {_ENTRIES} WHERE kind = 'page' AND NOT described UNION ALL SELECT 'empty_modules', 'low', * FROM {_ENTRIES} WHERE kind = 'module' AND files = 0))"""


@query(f"SELECT type, severity, count(*) AS n, string_agg(label, ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS samples FROM {_ISSUES} GROUP BY type, severity")
def quality_issues(spark, sf_dir):
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "module").when(d % 3 == 1, "api").otherwise("page")
    rows = read(spark, sf_dir, "documents").select(d.alias("ord"), F.concat(F.lit("d"), d.cast("string")).alias("label"), kind.alias("kind"), (d % 7 > 2).alias("described"), (d % 5).alias("files"))
    return facts.quality_issues(rows)


_MODULE_KEYS = f"(SELECT DISTINCT 'src/m' || (d % 20) AS key FROM {CODE})"
_CROSSING = f"(SELECT regexp_replace(src, '/f[0-9]+$', '') AS s, regexp_replace(dst, '/f[0-9]+$', '') AS t FROM {CODE_EDGES})"
_ROLES = f"""(SELECT *, fan_in >= greatest(5, floor((SELECT count(*) FROM {_MODULE_KEYS}) * 0.15)) AS is_hub, fan_in = 0 AND fan_out = 0 AS is_orphan, fan_out = 0 AND fan_in > 0 AS is_leaf, fan_out >= 5 AND fan_in < fan_out AS is_orchestrator FROM (
  SELECT key, (SELECT count(*) FROM {_CROSSING} WHERE t = key AND s <> key) AS fan_in, (SELECT count(*) FROM {_CROSSING} WHERE s = key AND t <> key) AS fan_out FROM {_MODULE_KEYS} WHERE key IN (SELECT s FROM {_CROSSING} UNION SELECT t FROM {_CROSSING})))"""
_ROLE = "CASE WHEN is_orphan THEN 'isolated' WHEN is_hub AND fan_in >= 15 THEN 'critical shared' WHEN is_hub THEN 'shared' WHEN is_orchestrator THEN 'orchestrator' WHEN is_leaf THEN 'leaf' WHEN fan_in > 0 AND fan_out > 0 THEN 'connector' END"


def code_modules(spark, sf_dir):
    return code(spark, sf_dir).select(F.regexp_replace("path", r"/f[0-9]+\.js$", "").alias("key")).groupBy("key").agg(F.count("*").alias("file_count"))


def roles(spark, sf_dir):
    return facts.module_roles(code_modules(spark, sf_dir), parsing.import_edges(code(spark, sf_dir)))


@query(f"SELECT *, {_ROLE} AS role FROM {_ROLES}")
def module_roles(spark, sf_dir):
    return roles(spark, sf_dir)


DESCRIBED = f"""(SELECT k.key, concat_ws('; ', {sql_first_match('k.key', rules.DESCRIPTIONS, 'other code')}, CASE WHEN role = 'connector' THEN 'connector, ' || fan_in || ' in, ' || fan_out || ' out' WHEN role = 'orchestrator' THEN 'orchestrator of ' || fan_out
  WHEN role = 'isolated' THEN 'isolated' WHEN role IS NOT NULL THEN role || ', ' || fan_in || ' importers' END) AS description FROM {_MODULE_KEYS} k LEFT JOIN (SELECT *, {_ROLE} AS role FROM {_ROLES}) r ON k.key = r.key)"""


@query(f"SELECT key, description FROM {DESCRIBED}")
def described_modules(spark, sf_dir):
    return facts.described_modules(code_modules(spark, sf_dir).select("key"), roles(spark, sf_dir))


_ROUTES = "(SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS route FROM pages)"


def routes(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("route")).distinct()


@query(f"SELECT route, {sql_first_match('route', tuple((label, words) for words, label in facts.ROUTE_WORDS), 'a page')} AS purpose FROM {_ROUTES}")
def route_purposes(spark, sf_dir):
    return routes(spark, sf_dir).select("route", facts.route_purpose(F.col("route")).alias("purpose"))


@query(golden([("Market Data Flow", True, "src/market"), ("Authentication Flow", True, "lib/AuthUtil,src/session"), ("Content Delivery Flow", False, ""), ("API Integration Flow", False, "2 endpoints")], "name, critical, modules"))
def inferred_flows(spark, sf_dir):
    keys = values(spark, [("src/market",), ("src/session",), ("lib/AuthUtil",), ("x/blog",)], "key string")
    return facts.inferred_flows(keys, values(spark, [("/login",), ("/home",)], "route string"), values(spark, [("/api/price",), ("/api/x",)], "route string"))


_FOLDERS = f"(SELECT regexp_extract(path, '^([^/]+/src/[^/]+)', 1) AS key, min(ord) AS ord FROM {FILES} GROUP BY 1)"


@query(f"SELECT key FROM {_FOLDERS} WHERE contains(lower(key), 'lib') OR contains(lower(key), 'util') ORDER BY ord, key LIMIT 5")
def shared_libraries(spark, sf_dir):
    keys = files(spark, sf_dir).groupBy(F.regexp_extract("path", "^([^/]+/src/[^/]+)", 1).alias("key")).agg(F.min("ord").alias("ord"))
    return facts.shared_libraries(keys).select("key")


_BIG = '{"project":"p","domains":[' + ",".join(f'"d{i}"' for i in range(12)) + '],"topModules":[' + ",".join(f'"m{i}"' for i in range(14)) + '],"routes":{"pages":[' + ",".join(f'"p{i}"' for i in range(20)) + '],"apis":["a"]}}'
_CUT = '{"project":"p","domains":[' + ",".join(f'"d{i}"' for i in range(8)) + '],"topModules":[' + ",".join(f'"m{i}"' for i in range(10)) + '],"routes":{"pages":[' + ",".join(f'"p{i}"' for i in range(15)) + '],"apis":["a"]}}'


@query(golden([(1, _BIG), (2, _CUT), (3, _CUT[:100] + "\n... (truncated)")], "id, context").replace("\n", "' || chr(10) || '"))
def trimmed_contexts(spark, sf_dir):
    rows = values(spark, [(1, _BIG, 500), (2, _BIG, 300), (3, _BIG, 100)], "id int, context string, most int")
    return rows.select("id", F.when(F.col("id") == 1, facts.trimmed_context(F.col("context"), 500)).when(F.col("id") == 2, facts.trimmed_context(F.col("context"), 300)).otherwise(facts.trimmed_context(F.col("context"), 100)).alias("context"))


@query(golden([(1, None), (2, "steps"), (3, "name")], "id, missing"))
def missing_fields(spark, sf_dir):
    rows = values(spark, [(1, '{"name": 1, "steps": []}'), (2, '{"name": 1}'), (3, "no")], "id int, raw string")
    return rows.select("id", facts.missing_fields(F.col("raw"), ["name", "steps"]).alias("missing"))


@query(f"SELECT doc_id, regexp_replace(text, {quoted(parsing.SECRETS)}, '[REDACTED]', 'g') AS text FROM documents")
def documents_without_secrets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", facts.without_secrets(F.col("text")).alias("text"))


@query(golden([("sk-abcdefghijklmnopqrstuv", True), ("aaaaaaaaaaaaaaaaaaaaaaaa", False), ("q8Zr2LmX0vTb7YpK4wNs9HdJ", True), ("a plain sentence of many words", False), (None, False)], "word, secret"))
def likely_secrets(spark, sf_dir):
    rows = values(spark, [("sk-abcdefghijklmnopqrstuv",), ("aaaaaaaaaaaaaaaaaaaaaaaa",), ("q8Zr2LmX0vTb7YpK4wNs9HdJ",), ("a plain sentence of many words",), (None,)], "word string")
    return rows.select("word", facts.looks_secret(F.col("word")).alias("secret"))


@query(golden([('{"workspaceId":"abcd***6789","page":"p"}', '{"model":"m"}')], "notion, ai"))
def loggable_settings(spark, sf_dir):
    rows = values(spark, [(("abcd123456789", "p", "t"), ("m", "k"))], "notion struct<workspaceId:string,page:string,token:string>, ai struct<model:string,apiKey:string>")
    return facts.loggable_settings(rows).select(F.to_json("notion").alias("notion"), F.to_json("ai").alias("ai"))


@query(golden([("main", "Map"), ("feature/X y", "Map [feature-xy]")], "branch, title"))
def branch_titles(spark, sf_dir):
    from quillspar.operators.changes import branch_slug

    b = F.col("branch")
    return values(spark, [("main",), ("feature/X y",)], "branch string").select("branch", facts.branch_title(F.lit("Map"), b, branch_slug(b)).alias("title"))


_PLAN = sql_values(rules.DOCUMENTS, "key, audience, generated")


@query(f"SELECT key FROM {_PLAN} WHERE audience IN ('technical', 'mixed') AND generated IN ('yes', 'hybrid')")
def documents_for_audience(spark, sf_dir):
    return facts.documents_for(values(spark, rules.DOCUMENTS, "key string, audience string, generated string"), "technical", True).select("key")


_OLD = "steps:\n      - name: Checkout repository\n        uses: actions/checkout@v4\n      - name: Go\n        run: |\n          cd tools/tool\n          npm ci\n          npx tool publish\n"
_NEW = "steps:\n      - name: Checkout repository\n        uses: actions/checkout@v4\n\n      - name: Setup Node.js\n        uses: actions/setup-node@v4\n        with:\n          node-version: 20\n      - name: Go\n        run: |\n          npx @scope/tool@latest publish\n"


@query(golden([(1, _NEW), (2, "actions/setup-node@v4 npx @scope/tool@latest x")], "id, content"))
def migrated_workflows(spark, sf_dir):
    rows = values(spark, [(1, _OLD), (2, "actions/setup-node@v4 npx tool x")], "id int, content string")
    return rows.select("id", workflows.migrated_workflow(F.col("content"), workflows.Tool("tool", "@scope/tool")).alias("content"))


_TOOL = workflows.Tool("tool", "@scope/tool", ("PAGE_TOKEN", "PAGE_PARENT"), (("MODEL_KEY", "${{ secrets.MODEL_KEY }}"), ("MODEL_NAME", "small")))
_CHECKOUT = "    steps:\n      - name: Checkout repository\n        uses: actions/checkout@v4\n"
_SETUP = "      - name: Setup Node.js\n        uses: actions/setup-node@v4\n        with:\n          node-version: 20\n"
_SECRETS = "        env:\n          PAGE_TOKEN: ${{ secrets.PAGE_TOKEN }}\n          PAGE_PARENT: ${{ secrets.PAGE_PARENT }}\n"
_SETTINGS = "          MODEL_KEY: ${{ secrets.MODEL_KEY }}\n          MODEL_NAME: small\n"


def _workflow(pick, text, join, old: bool):
    """A document's workflow before and after: whether it sets up the runtime, has variables, enters the folder, by its id."""
    step = "      - name: Publish documentation\n"
    script = "        run: |\n          " + ("cd tools/tool\n          npm ci\n          npx tool publish\n" if old else "npx @scope/tool@latest publish\n")
    one = "        run: npx " + ("tool" if old else "@scope/tool@latest") + " publish\n"
    return join(
        _CHECKOUT, pick(2, _SETUP, "" if old else "\n" + _SETUP), step,
        pick(3, _SECRETS if old else _SECRETS + _SETTINGS, "" if old else _SECRETS + _SETTINGS), pick(5, one, script), "      # ", text, "\n",
    )


def _sql_text(x: str) -> str:
    return "replace(" + quoted(x.replace("\n", "^")) + ", '^', chr(10))"


_CLEAN = "replace(replace(coalesce(text, ''), chr(10), ' '), 'env:', 'env ')"
_SQL_WORKFLOW = _workflow(lambda k, a, b: f"CASE doc_id % {k} WHEN 0 THEN {_sql_text(a)} ELSE {_sql_text(b)} END", _CLEAN, lambda *xs: " || ".join(x if x.startswith(("CASE", "replace(")) else _sql_text(x) for x in xs), False)


def _workflow_files(spark, sf_dir):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("env:"), F.lit("env "))
    pick = lambda k, a, b: F.when(F.col("doc_id") % k == 0, a).otherwise(b)
    return read(spark, sf_dir, "documents").select("doc_id", _workflow(pick, text, lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs]), True).alias("content"))


@query(f"SELECT doc_id, {_SQL_WORKFLOW} AS content FROM documents")
def workflows_of_documents(spark, sf_dir):
    """Workflows of all kinds, each with a document's text as a comment, brought up to date."""
    return _workflow_files(spark, sf_dir).select("doc_id", workflows.migrated_workflow(F.col("content"), _TOOL).alias("content"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 > 0 THEN 'tools folder' END, CASE WHEN doc_id % 5 > 0 THEN 'install without latest' END, 'run without latest', CASE WHEN doc_id % 2 > 0 THEN 'no node setup' END, CASE WHEN doc_id % 3 > 0 THEN 'no environment' END) AS found FROM documents""")
def workflow_patterns(spark, sf_dir):
    return _workflow_files(spark, sf_dir).select("doc_id", F.array_join(context.legacy_patterns(F.col("content"), "tool"), ",").alias("found"))


@query(golden([(1, "- a\n- b")], "id, text"))
def bullet_lists(spark, sf_dir):
    return values(spark, [(1, ["a", None, " ", "b"])], "id int, v array<string>").select("id", facts.bullet_list(F.col("v")).alias("text"))


def code_snapshot(spark, sf_dir, least: int, most: int):
    """A snapshot of the files whose ids lie in a range: two such ranges are two states of a repository."""
    files = code(spark, sf_dir).filter(F.col("ord").between(least, most))
    sizes = files.select(F.regexp_replace("path", r"/f[0-9]+\.js$", "").alias("key")).groupBy("key").agg(F.count("*").alias("file_count"))
    sets = {"dependencies": parsing.external_packages(files), "api": files.filter("ord % 50 = 0").select("path"), "frameworks": files.filter("ord % 60 = 0").select((F.col("ord") % 7).cast("string")), "graphql": files.filter("ord % 90 = 0").select((F.col("ord") % 11).cast("string"))}
    return baselines.snapshot(sizes, files.agg(F.count("*")).scalar(), sets, {"cycles": files.agg(F.count_if(F.col("ord") % 70 == 0).alias("n"))})


def _sql_state(least: int, most: int) -> str:
    own = f"(SELECT * FROM {CODE} WHERE d BETWEEN {least} AND {most})"
    return f"""(SELECT 'modules' AS dimension, regexp_replace(key, '/f[0-9]+$', '') AS item, count(*) AS n FROM {own} GROUP BY 2 UNION ALL SELECT 'files', NULL, count(*) FROM {own}
  UNION ALL SELECT DISTINCT 'dependencies', 'pkg' || (d % 7), NULL FROM {own} WHERE d % 2 = 0 UNION ALL SELECT 'api', key || '.js', NULL FROM {own} WHERE d % 50 = 0
  UNION ALL SELECT DISTINCT 'frameworks', CAST(d % 7 AS VARCHAR), NULL FROM {own} WHERE d % 60 = 0 UNION ALL SELECT DISTINCT 'graphql', CAST(d % 11 AS VARCHAR), NULL FROM {own} WHERE d % 90 = 0 UNION ALL SELECT 'cycles', NULL, count(*) FROM {own} WHERE d % 70 = 0)"""


_STATES = ((0, 99), (20, 179))
_DRIFT = f"""(WITH a AS {_sql_state(*_STATES[0])}, b AS {_sql_state(*_STATES[1])},
gone AS (SELECT dimension, 'removed' AS change, item FROM a WHERE item IS NOT NULL AND (dimension, item) NOT IN (SELECT (dimension, item) FROM b WHERE item IS NOT NULL) UNION ALL SELECT dimension, 'added', item FROM b WHERE item IS NOT NULL AND (dimension, item) NOT IN (SELECT (dimension, item) FROM a WHERE item IS NOT NULL)),
sets AS (SELECT dimension, change, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM gone GROUP BY 1, 2),
n AS (SELECT dimension, a.item, a.n AS was, b.n AS now FROM a JOIN b USING (dimension) WHERE a.n IS NOT NULL AND b.n IS NOT NULL AND a.item IS NOT DISTINCT FROM b.item)
SELECT dimension AS category, change AS type, CASE WHEN change = 'added' THEN 'info' WHEN dimension = 'frameworks' THEN 'critical' ELSE 'warning' END AS severity, items FROM sets WHERE dimension <> 'graphql'
UNION ALL SELECT 'modules', 'size-change', CASE WHEN abs(now - was) / was > 1 THEN 'warning' ELSE 'info' END, item || ': ' || was || ' to ' || now || ' files (+' || CAST(floor(abs(now - was) / was * 100 + 0.5) AS BIGINT) || '%)' FROM n WHERE dimension = 'modules' AND was > 0 AND now > 0 AND abs(now - was) / was > 0.5
UNION ALL SELECT 'cycles', CASE WHEN now > was THEN 'increased' ELSE 'decreased' END, CASE WHEN now > was THEN 'warning' ELSE 'info' END, was || ' to ' || now FROM n WHERE dimension = 'cycles' AND now <> was
UNION ALL SELECT 'graphql', 'schema-changed', CASE WHEN r IS NULL THEN 'info' ELSE 'warning' END, concat_ws('; ', g, r) FROM (SELECT max('+' || n || ' types: ' || items) FILTER (WHERE change = 'added') AS g, max('-' || n || ' types: ' || items) FILTER (WHERE change = 'removed') AS r FROM sets WHERE dimension = 'graphql') WHERE g IS NOT NULL OR r IS NOT NULL
UNION ALL SELECT 'scale', 'file-count-change', CASE WHEN abs(now - was) / was > 0.5 THEN 'warning' ELSE 'info' END, was || ' to ' || now || ' files (' || CASE WHEN now > was THEN '+' ELSE '' END || CAST(floor(abs(now - was) / was * 100 + 0.5) AS BIGINT) || '%)' FROM n WHERE dimension = 'files' AND was > 0 AND now > 0 AND abs(now - was) / was > 0.2)"""


def saved_drift(spark, sf_dir):
    """Two runs of a repository, saved and compared as a pipeline would: the second finds the first as its baseline."""
    import uuid

    from quillspar.session import scratch_root

    root = f"{scratch_root(spark).rstrip('/')}/quillspar/baselines-{uuid.uuid4().hex}"
    baselines.run_over_run(spark, code_snapshot(spark, sf_dir, *_STATES[0]), root, 1)
    return baselines.run_over_run(spark, code_snapshot(spark, sf_dir, *_STATES[1]), root, 2)


@query(f"SELECT * FROM {_DRIFT}")
def baseline_drift(spark, sf_dir):
    return saved_drift(spark, sf_dir)


@query(f"SELECT *, drifts || ' drifts: ' || critical || ' critical, ' || warning || ' warnings, ' || info || ' informational' AS summary FROM (SELECT count(*) AS drifts, {', '.join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ('critical', 'warning', 'info'))} FROM {_DRIFT})")
def drift_summary(spark, sf_dir):
    return baselines.drift_summary(saved_drift(spark, sf_dir))


@query(f"SELECT key, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT src AS key, n AS w FROM {EDGES}) GROUP BY key ORDER BY weight DESC, key LIMIT 5")
def heaviest_sources(spark, sf_dir):
    return edges(spark, sf_dir).groupBy(F.col("src").alias("key")).agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), "key").limit(5)


@query("""SELECT url, coalesce(nullif(regexp_extract(url, '([0-9a-f]{32})(?:[?#]|$)', 1), ''), nullif(replace(regexp_extract(url, '([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})', 1), '-', ''), '')) AS page,
  nullif(regexp_extract(url, '/spaces/([^/]+)', 1), '') AS space, nullif(regexp_extract(url, '/pages/(\\d+)', 1), '') AS wiki_page FROM pages""")
def ids_of_pages(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("url", repository.page_id(u).alias("page"), repository.wiki_space(u).alias("space"), repository.wiki_page(u).alias("wiki_page"))


@query(f"SELECT s AS src, t AS dst, count(*) AS weight, 'imports' AS type FROM {_CROSSING} WHERE s <> t GROUP BY 1, 2")
def code_module_rollup(spark, sf_dir):
    keys = code_modules(spark, sf_dir).select("key", F.lit(0).alias("first_ord"))
    inside = parsing.import_edges(code(spark, sf_dir))
    placed = modules.longest_prefix(inside, keys, "src").withColumnRenamed("module", "src_module")
    return graph.rolled_up(modules.longest_prefix(placed, keys, "dst").withColumnRenamed("module", "dst_module"))


@query("SELECT 'd' || doc_id AS key, 't' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'create' WHEN doc_id % 3 = 1 THEN 'keep' ELSE 'update' END AS action, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN doc_id ELSE doc_id + 1 END AS version FROM documents")
def page_versions(spark, sf_dir):
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(d, F.concat(F.lit("d"), d.cast("string")).alias("key"), F.concat(F.lit("t"), d.cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    held = rows.filter(d % 3 != 0).select("title", d.alias("version"), F.when(d % 3 == 1, F.col("content")).otherwise(F.concat("content", F.lit("!"))).alias("content"))
    return documents.page_versions(rows.drop("doc_id"), held)


@query(golden([("A",), ("B",), ("hub",)], "name"))
def flows_with_hubs(spark, sf_dir):
    flows = values(spark, [("A", False), ("B", False), ("test run", False)], "name string, critical boolean")
    return context.with_hub_flows(flows, values(spark, [("hub", True), ("a", True)], "name string, critical boolean")).select("name").filter("name <> 'test run'")


@query(golden([("schema.graphql", "type", "User", "id", "ID!"), ("schema.graphql", "type", "User", "name", "String"), ("schema.graphql", "query", "Query", "user", "User"), ("schema.graphql", "input", "In", "a", "Int }")], "path, kind, name, field, type").replace("'Int }'", "'Int'"))
def schema_fields(spark, sf_dir):
    from quillspar.plans.sources_and_text import corpus

    return parsing.schema_fields(corpus(spark).filter("path = 'schema.graphql'"))
