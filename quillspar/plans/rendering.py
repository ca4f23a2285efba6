"""Queries that render documents, and their SQL: sections described twice, once in DataFrames and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.operators import changes, context, facts, parsing, rendering
from quillspar.plans import changes as change_plans
from quillspar.plans import facts as f
from quillspar.plans.base import ORACLES, query, sql_first_match
from quillspar.plans.contexts import _SHOWN
from quillspar.plans.sources_and_text import corpus
from quillspar.plans.structure import DOMAINED, counted, with_domain
from quillspar.session import write_table
from quillspar.sources.adapters import CODE, CODE_EDGES, CODE_FINDINGS, CODE_HEAD, code, quoted, read, sql_values, values


def sql_section(number: int, title: str, facts_sql: str, order: str, line: str, most: int | None = None, head: tuple[str, ...] = ()) -> str:
    heads = " UNION ALL ".join(f"SELECT {i} AS a, {quoted(h)} AS text" for i, h in enumerate(head, 1)) or "SELECT 1 AS a, NULL AS text WHERE false"
    note = f" UNION ALL SELECT 2, 0, '> The first {most} of ' || count(*) || '.' FROM {facts_sql} HAVING count(*) > {most}" if most else ""
    return f"""SELECT {number} AS section, row_number() OVER (ORDER BY a, b) AS place, text FROM (
  SELECT 0 AS a, 0 AS b, '## {title} (' || count(*) || ')' AS text FROM {facts_sql} HAVING count(*) > 0
  UNION ALL SELECT 0, h.a, h.text FROM ({heads}) h WHERE EXISTS (SELECT 1 FROM {facts_sql})
  UNION ALL SELECT 1, r, text FROM (SELECT row_number() OVER (ORDER BY {order}) AS r, {line} AS text FROM {facts_sql}) {f'WHERE r <= {most}' if most else ''}{note})"""


def sql_document(key: str, title: str, sections: list[str]) -> str:
    return f"SELECT {quoted(key)} AS doc_key, * FROM (SELECT 0 AS section, 1 AS place, '# {title}' AS text UNION ALL {' UNION ALL '.join(sections)})"


def placed(document: DataFrame) -> DataFrame:
    """A document's lines with their place in their section."""
    at = F.row_number().over(Window.partitionBy("doc_key", "section").orderBy("line_no"))
    return document.select("doc_key", "section", at.alias("place"), "text")


def sql_cells(*columns: str) -> str:
    return "'| ' || concat_ws(' | ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + ") || ' |'"


def tick(c: str) -> str:
    return f"('`' || {c} || '`')"


_TOTALS = f"(SELECT 1 AS ord, 'files' AS metric, count(*) AS n FROM {CODE} UNION ALL SELECT 2, 'modules', count(*) FROM {f._MODULE_KEYS} UNION ALL SELECT 3, 'imports', count(*) FROM {CODE_EDGES} UNION ALL SELECT 4, 'pages', 0)"
_SIZED = f"(SELECT m.key, m.file_count, d.description FROM (SELECT 'src/m' || (d % 20) AS key, count(*) AS file_count FROM {CODE} GROUP BY 1) m JOIN {f.DESCRIBED} d ON m.key = d.key)"
_TECHNOLOGY = [("framework", "Next.js"), ("framework", "Express"), ("language", "JavaScript")]
_PACKAGES = [(f"pkg{i:02}", f"packages/pkg{i:02}", "1.0.0") for i in range(23)]


def totals(spark, sf_dir, known=None):
    """Counts of the files; imports come from their parsed facts if these are given. Written, as a section reads its facts twice."""
    one = lambda i, name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(i).alias("ord"), F.lit(name).alias("metric"), "n")
    files = code(spark, sf_dir)
    rows = one(1, "files", files).union(one(2, "modules", f.code_modules(spark, sf_dir))).union(one(3, "imports", parsing.import_edges(files) if known is None else parsing.fact_edges(known)))
    return write_table(rows.union(spark.range(1).select(F.lit(4), F.lit("pages"), F.lit(0).cast("long"))), "totals")


def sized(spark, sf_dir):
    keys = f.code_modules(spark, sf_dir)
    return keys.join(facts.described_modules(keys.select("key"), f.roles(spark, sf_dir)), "key")


@query(sql_document("system_overview", "System overview", [
    sql_section(1, "At a glance", f"(SELECT * FROM {_TOTALS} WHERE n > 0)", "ord", sql_cells("metric", "n"), None, rendering.header("Metric", "Value")),
    sql_section(2, "Technology", f"(SELECT kind, string_agg(name, ', ' ORDER BY name) AS names FROM {sql_values(_TECHNOLOGY, 'kind, name')} GROUP BY kind)", "kind", sql_cells("kind", "names"), None, rendering.header("Kind", "Names")),
    sql_section(3, "Architecture", f"(SELECT count(*) AS n, CAST(sum(file_count) AS BIGINT) AS c FROM {_SIZED})", "n", "'A ' || CASE WHEN n > 50 THEN 'large' WHEN n > 20 THEN 'medium-sized' ELSE 'compact' END || ' repository of ' || n || ' modules and ' || c || ' files.'"),
    sql_section(4, "Largest modules", _SIZED, "file_count DESC, key", sql_cells(tick("key"), "file_count", "description"), 10, rendering.header("Module", "Files", "Description")),
    sql_section(5, "Workspaces", sql_values(_PACKAGES, "name, path, version"), "path", sql_cells("name", tick("path"), "version"), 20, rendering.header("Package", "Path", "Version")),
]))
def system_overview(spark, sf_dir):
    return placed(rendering.system_overview(sized(spark, sf_dir), values(spark, _TECHNOLOGY, "kind string, name string"), totals(spark, sf_dir), values(spark, _PACKAGES, "name string, path string, version string")))


_URL = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"
_ENDPOINTS = f"(SELECT {_URL} AS route, 'p' || page_id AS path, CASE WHEN page_id % 3 = 0 THEN 'GET,POST' ELSE 'GET' END AS methods FROM pages)"
_EXPORTS = f"(SELECT key || '.js' AS path, 'f' || i AS name, i, CASE WHEN i = 0 AND d % 2 = 1 THEN 'Does it.' END AS description, CASE WHEN i = 0 AND d % 10 = 1 THEN 'use another' END AS deprecated FROM {CODE}, (VALUES (0), (1), (2)) AS v(i) WHERE i < nf)"
_SERVICES = [("Payments", "Stripe", "src/pay.js"), ("Chat", "Slack", "src/chat.js")]


def endpoints(spark, sf_dir):
    p = F.col("page_id")
    return read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("route"), F.concat(F.lit("p"), p.cast("string")).alias("path"), F.when(p % 3 == 0, "GET,POST").otherwise("GET").alias("methods"))


@query(sql_document("api_surface", "API surface", [
    sql_section(1, "Endpoints", _ENDPOINTS, "route, methods, path", sql_cells("methods", tick("route"), tick("path")), None, rendering.header("Methods", "Route", "File")),
    sql_section(2, "External services", sql_values(_SERVICES, "category, name, detected_in"), "category, name", sql_cells("category", "name", tick("detected_in")), None, rendering.header("Kind", "Service", "First seen in")),
    sql_section(3, "Deprecated exports", f"(SELECT * FROM {_EXPORTS} WHERE deprecated IS NOT NULL)", "path, i", "'- `' || name || '` in `' || path || '`: ' || deprecated"),
    sql_section(4, "Documented exports", f"(SELECT * FROM {_EXPORTS} WHERE description IS NOT NULL)", "path, i", "'- `' || name || '` in `' || path || '`: ' || description", 30),
    sql_section(5, "Documentation", f"(SELECT count(*) AS n, count(description) AS c FROM {_EXPORTS})", "n", "n || ' exports, ' || c || ' documented (' || CAST(floor(c * 100.0 / n + 0.5) AS BIGINT) || '%).'"),
]))
def api_surface(spark, sf_dir):
    return placed(rendering.api_surface(endpoints(spark, sf_dir), values(spark, _SERVICES, "category string, name string, detected_in string"), parsing.exports(code(spark, sf_dir))))


@query(sql_document("route_map", "Route map", [
    sql_section(1, "Pages", f"(SELECT * FROM {_ENDPOINTS} WHERE methods = 'GET')", "route, path", sql_cells(tick("route"), tick("path")), 200, rendering.header("Route", "File")),
    sql_section(2, "Endpoints", f"(SELECT * FROM {_ENDPOINTS} WHERE methods <> 'GET')", "route, path", sql_cells("methods", tick("route"), tick("path")), 200, rendering.header("Methods", "Route", "File")),
]))
def route_map(spark, sf_dir):
    every = endpoints(spark, sf_dir)
    return placed(rendering.route_map(every.filter("methods = 'GET'"), every.filter("methods <> 'GET'")))


_CATEGORY = sql_first_match("key", rules.MAP_CATEGORIES, "other")
_RELATIONS = f"(SELECT s AS src, t AS dst, count(*) AS weight FROM {f._CROSSING} WHERE s <> t GROUP BY 1, 2)"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM {_RELATIONS})"
_DRAWN = f"""(SELECT m.key, file_count, {_CATEGORY.replace('key', 'm.key')} AS category, coalesce(' -> ' || deps || CASE WHEN every > 3 THEN ' and ' || (every - 3) || ' more' ELSE '' END, '') AS "to"
  FROM {_SIZED} m LEFT JOIN (SELECT src AS key, count(*) AS every, string_agg(dst, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS deps FROM {_RANKED} GROUP BY 1) d ON m.key = d.key)"""


def relations(spark, sf_dir):
    module = lambda c: F.regexp_replace(c, r"/f[0-9]+$", "")
    crossing = parsing.import_edges(code(spark, sf_dir)).select(module("src").alias("src"), module("dst").alias("dst")).filter("src <> dst")
    return crossing.groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query(sql_document("system_map", "System map", [
    sql_section(1, "Modules", _DRAWN, "category, key", "'- ' || category || ': ' || key || ' (' || file_count || ')' || \"to\""),
    sql_section(2, "Most depended on", f"(SELECT dst AS key, CAST(sum(weight) AS BIGINT) AS n FROM {_RELATIONS} GROUP BY 1)", "n DESC, key", sql_cells(tick("key"), "n"), 5, rendering.header("Module", "Imported by")),
    sql_section(3, "Most dependent", f"(SELECT src AS key, CAST(sum(weight) AS BIGINT) AS n FROM {_RELATIONS} GROUP BY 1)", "n DESC, key", sql_cells(tick("key"), "n"), 5, rendering.header("Module", "Depends on")),
]))
def system_map(spark, sf_dir):
    keys = f.code_modules(spark, sf_dir).withColumn("category", text.first_match(F.col("key"), rules.MAP_CATEGORIES, "other"))
    return placed(rendering.system_map(keys, relations(spark, sf_dir)))


_ENRICHED = f"(SELECT status, file, CASE WHEN {change_plans._ISROUTE} AND status <> 'modified' THEN {change_plans._ROUTE} END AS route, regexp_matches(file, {change_plans._NOISE}) AS noise, 'src/' || split_part(file, '/', 3) AS module FROM {change_plans._CHANGES})"
_KEPT = f"(SELECT * FROM {_ENRICHED} WHERE NOT noise)"
_IMPACTED = f"(SELECT DISTINCT module FROM {_KEPT})"


def enriched(spark, sf_dir):
    return changes.enriched(change_plans.change_list(spark, sf_dir))


def _routes(status: str) -> str:
    return f"(SELECT * FROM {_ENRICHED} WHERE status = {quoted(status)} AND route IS NOT NULL)"


def _files(status: str) -> str:
    return f"(SELECT * FROM {_KEPT} WHERE status = {quoted(status)})"


@query(sql_document("arch_diff", "Architecture diff", [
    *[sql_section(i, f"{n} routes", _routes(n.lower()), "route, file", "'- ' || " + tick("route"), 25) for i, n in ((1, "Added"), (2, "Removed"))],
    sql_section(3, "Impacted modules", _IMPACTED, "module", "'- ' || " + tick("module"), 40),
    *[sql_section(i, f"{n} files", _files(n.lower()), "file", "'- ' || " + tick("file"), 25) for i, n in ((4, "Added"), (5, "Removed"), (6, "Modified"))],
]))
def architecture_diff(spark, sf_dir):
    return placed(rendering.architecture_diff(enriched(spark, sf_dir)))


@query(sql_document("comment", "Architecture summary", [
    sql_section(1, "Files", f"(SELECT status, count(*) AS n FROM {_KEPT} GROUP BY 1)", "status", "'**' || status || ':** ' || n"),
    *[sql_section(i, f"{n} routes", _routes(n.lower()), "route", "'- ' || " + tick("route"), 10) for i, n in ((2, "Added"), (3, "Removed"))],
    sql_section(4, "Impacted modules", _IMPACTED, "module", "'- ' || " + tick("module"), 12),
]))
def comment_body(spark, sf_dir):
    return placed(rendering.comment_body(enriched(spark, sf_dir)))


@query(sql_document("change_impact", "Change impact", [sql_section(1, "Modules", f"(SELECT module, count(*) AS n, count(DISTINCT status) AS kinds FROM {_KEPT} GROUP BY 1)", "n DESC, module", "'- `' || module || '`: ' || n || ' files, ' || kinds || ' kinds of change'", 40)]))
def change_impact_document(spark, sf_dir):
    return placed(rendering.change_impact(enriched(spark, sf_dir)))


_MEMBERS = [("schema.graphql", "query", "Query", "user"), ("schema.graphql", "type", "User", "id,name"), ("schema.graphql", "enum", "Role", "ADMIN,USER"), ("schema.graphql", "input", "In", "a"), ("schema.graphql", "union", "Any", "User,Role")]
_GRAPHQL = sql_values(_MEMBERS, "path, kind, name, members")


@query(sql_document("graphql_schema", "GraphQL schema", [
    sql_section(1, "Libraries", sql_values([("urql",)], "library"), "library", "'- ' || library"), sql_section(2, "Schema files", f"(SELECT DISTINCT path FROM {_GRAPHQL})", "path", "'- ' || " + tick("path")),
    *[sql_section(i, t, f"(SELECT * FROM {_GRAPHQL} WHERE kind = {quoted(k)})", "name", sql_cells(tick("name"), "members", tick("path")), None, rendering.header("Name", "Members", "File")) for i, k, t in ((3, "query", "Queries"), (6, "type", "Object types"), (7, "enum", "Enums"), (8, "input", "Inputs"), (10, "union", "Unions"))],
]))
def graphql_document(spark, sf_dir):
    kept = parsing.schema_members(corpus(spark).filter("path = 'schema.graphql'")).filter(F.col("kind").isin("query", "type", "enum", "input", "union"))
    return placed(rendering.graphql_schema(kept, values(spark, [("urql",), ("urql",)], "library string"), values(spark, [], "path string")))


_DECLARED = [("A", "interface", "extends B"), ("B", "interface", None), ("T", "alias", "references A, references B"), ("K", "class", "extends L, implements A"), ("L", "class", None), ("E", "enum", None)]
_TYPES = sql_values([(*d, "other/c/index.ts") for d in _DECLARED], 'name, kind, "to", path')
_TYPE_EDGES = sql_values([("A", "extends", "B"), ("K", "extends", "L"), ("K", "implements", "A"), ("T", "references", "A"), ("T", "references", "B")], "src, relation, dst")


@query(sql_document("type_graph", "Type graph", [
    *[sql_section(i, t, f"(SELECT * FROM {_TYPES} WHERE kind = {quoted(k)})", "name, path", sql_cells(tick("name"), '"to"', tick("path")), None, rendering.header("Name", "Relations", "File")) for i, (k, t) in enumerate((("interface", "Interfaces"), ("class", "Classes"), ("alias", "Aliases"), ("enum", "Enums")), 1)],
    sql_section(5, "Relations", _TYPE_EDGES, "src, relation, dst", "'- ' || src || ' ' || relation || ' ' || dst"),
]))
def type_graph(spark, sf_dir):
    return placed(rendering.type_graph(*parsing.type_edges(corpus(spark))))


_CYCLES = [(i, f"a{i:02} > b > a{i:02}") for i in range(22)]
_HUBS = f"(SELECT key, fan_in FROM {f._ROLES} WHERE is_hub)"
_PKGS = f"(SELECT DISTINCT 'pkg' || (d % 7) AS package FROM {CODE} WHERE d % 2 = 0)"


@query(sql_document("dependency_graph", "Dependency graph", [
    sql_section(1, "Overview", _TOTALS, "ord", sql_cells("metric", "n"), None, rendering.header("Metric", "Value")), sql_section(2, "Hubs", _HUBS, "fan_in DESC, key", sql_cells(tick("key"), "fan_in"), None, rendering.header("Module", "Imported by")),
    sql_section(3, "Cycles", sql_values(_CYCLES, "ord, cycle"), "ord", "'- ' || cycle", 20), sql_section(4, "External packages", _PKGS, "package", sql_cells(tick("package")), None, rendering.header("Package")),
]))
def dependency_document(spark, sf_dir):
    hubs = f.roles(spark, sf_dir).filter("is_hub")
    return placed(rendering.dependency_graph(totals(spark, sf_dir), hubs, values(spark, _CYCLES, "ord int, cycle string"), parsing.external_packages(code(spark, sf_dir))))


@query(sql_document("architecture_drift", "Architecture drift", [sql_section(i, t, f"(SELECT * FROM {f._DRIFT} WHERE severity = {quoted(s)})", "category, type, items", "'- ' || category || ', ' || type || ': ' || items") for i, (s, t) in enumerate((("critical", "Critical changes"), ("warning", "Warnings"), ("info", "Informational")), 1)]))
def drift_document(spark, sf_dir):
    return placed(rendering.architecture_drift(f.saved_drift(spark, sf_dir)))


_FUNCTIONS = f"(SELECT key || '.js' AS path, 'f' || i AS name, i, {CODE_HEAD} + 1 + i * (2 + d % 13) + i * (i - 1) // 2 AS line, 1 + d % 13 + i AS complexity FROM {CODE}, (VALUES (0), (1), (2)) AS v(i) WHERE i < nf)"
_HEALTH = f"(SELECT *, CASE WHEN exports > 0 THEN CAST(floor(coverage * 100 + 0.5) AS BIGINT) END AS doc_percent FROM {f.HEALTH})"


@query(sql_document("code_health", "Code health", [
    sql_section(1, "Grades", f"(SELECT grade, count(*) AS n FROM {_HEALTH} GROUP BY 1)", "grade", sql_cells("grade", "n"), None, rendering.header("Grade", "Files")),
    sql_section(2, "Hotspots", f"(SELECT * FROM {_HEALTH} WHERE score < 60)", "score, file", sql_cells(tick("file"), "score", "grade", "complexity", "(fan_in || ' in, ' || fan_out || ' out')", "doc_percent", "findings"), 20, rendering.header("File", "Score", "Grade", "Complexity", "Coupling", "Documented", "Findings")),
    sql_section(3, "Most complex functions", _FUNCTIONS, "complexity DESC, path, i", "'| `' || name || '` | `' || path || '` | ' || line || ' | ' || complexity || ' |'", 15, rendering.header("Function", "File", "Line", "Complexity")),
    sql_section(4, "Files by health", _HEALTH, "score, file", sql_cells(tick("file"), "score", "grade", "complexity", "fan_in", "fan_out"), 50, rendering.header("File", "Score", "Grade", "Complexity", "Importers", "Imports")),
]))
def health_document(spark, sf_dir):
    known = facts.parsed(code(spark, sf_dir), each_function=True)
    return placed(rendering.code_health(facts.health_of(known), known.select("path", F.explode("each").alias("f")).select("path", "f.*")))


_RISKS = tuple(dict.fromkeys(c for _, c, *_ in rules.SECURITY))
_FOUND = f"(SELECT *, replace(id, '-', ' ') AS name FROM {CODE_FINDINGS})"


@query(sql_document("security_hotspots", "Security hotspots", [
    sql_section(1, "Severities", f"(SELECT severity, count(*) AS n FROM {_FOUND} GROUP BY 1)", "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END", sql_cells("severity", "n"), None, rendering.header("Severity", "Findings")),
    *[sql_section(i, c, f"(SELECT * FROM {_FOUND} WHERE category = {quoted(c)})", "path, line, name", sql_cells(tick("path"), "line", "name", "severity", "cwe"), None, rendering.header("File", "Line", "Pattern", "Severity", "CWE")) for i, c in enumerate(_RISKS, 2)],
    sql_section(2 + len(_RISKS), "Affected files", f"(SELECT path, count(*) AS n FROM {_FOUND} GROUP BY 1)", "path", "'- `' || path || '`: ' || n"),
]))
def security_document(spark, sf_dir):
    return placed(rendering.security_hotspots(facts.findings_in_place(code(spark, sf_dir)), _RISKS))


_FLOWS = [("Auth Flow", True, "lib/auth"), ("Blog Flow", False, ""), ("API Flow", False, "3 endpoints")]


@query(sql_document("data_flows", "Data flows", [sql_section(1, "Flows", sql_values(_FLOWS, "name, critical, modules"), "critical DESC, name", "'- ' || name || CASE WHEN critical THEN ' (critical)' ELSE '' END || ': ' || CASE WHEN modules = '' THEN 'no module' ELSE modules END")]))
def flow_document(spark, sf_dir):
    return placed(rendering.flow_narrative(values(spark, _FLOWS, "name string, critical boolean, modules string")))


@query(sql_document("business_domains", "Business domains", [sql_section(1, "Domains", f"(SELECT domain, count(*) AS n, CAST(sum(file_count) AS BIGINT) AS c FROM {DOMAINED} GROUP BY 1)", "c DESC, domain", "'- ' || domain || ': ' || n || ' modules, ' || c || ' files'")]))
def domain_document(spark, sf_dir):
    return placed(rendering.domain_narrative(with_domain(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("modules"), F.sum("file_count").alias("files"))))


@query(sql_document("executive_summary", "Executive summary", [
    sql_section(1, "Scale", _TOTALS, "ord", sql_cells("metric", "n"), None, rendering.header("Metric", "Value")),
    sql_section(2, "Health", "(" + ORACLES["code_health_totals"] + ")", "summary", "'- ' || summary"), sql_section(3, "Security", "(" + ORACLES["security_totals"] + ")", "summary", "'- ' || summary"),
]))
def summary_document(spark, sf_dir):
    known = facts.parsed(code(spark, sf_dir))
    return placed(rendering.executive_summary(totals(spark, sf_dir, known), facts.health_totals(facts.health_of(known)), facts.security_totals_of(known)))


_ROLED = f"(SELECT key, {f._ROLE} AS role FROM {f._ROLES})"


@query(sql_document("architecture_overview", "Architecture overview", [
    sql_section(1, "Patterns", f"(SELECT pattern FROM ({_SHOWN}) WHERE there)", "pattern", "'- ' || pattern"),
    sql_section(2, "Roles", f"(SELECT role, array_to_string(list_sort(list(DISTINCT key))[1:15], ', ') AS keys FROM {_ROLED} WHERE role IS NOT NULL GROUP BY 1)", "role", "'- ' || role || ': ' || keys"),
]))
def overview_document(spark, sf_dir):
    return placed(rendering.architecture_overview(f.roles(spark, sf_dir), context.patterns(counted(spark, sf_dir)).select("pattern")))


@query(sql_document("developer_onboarding", "Developer onboarding", [
    sql_section(1, "Tools", sql_values(_TECHNOLOGY, "kind, name"), "kind, name", "'- ' || kind || ': ' || name"), sql_section(2, "Start here", f"(SELECT key FROM {_ROLED} WHERE role IS NOT NULL)", "key", "'- ' || " + tick("key"), 5),
    sql_section(3, "Modules", _SIZED, "file_count DESC, key", "'- `' || key || '` (' || file_count || '): ' || description", 15),
]))
def onboarding_document(spark, sf_dir):
    return placed(rendering.developer_onboarding(sized(spark, sf_dir), f.roles(spark, sf_dir).filter("role IS NOT NULL"), values(spark, _TECHNOLOGY, "kind string, name string")))


_PLAN = sql_values(rules.DOCUMENTS, "key, audience, generated")


@query(sql_document("sidebar", "Documents", [sql_section(i, g, f"(SELECT * FROM {_PLAN} WHERE audience = {quoted(g)})", "key", "'- [' || replace(key, '_', ' ') || '](' || key || '.md)'") for i, g in enumerate(("non-technical", "mixed", "technical"), 1)]))
def sidebar(spark, sf_dir):
    return placed(rendering.sidebar(values(spark, rules.DOCUMENTS, "key string, audience string, generated string")))
