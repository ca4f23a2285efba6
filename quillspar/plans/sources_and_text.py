"""Queries over source text, graphs, documents and manifests; inline corpora stand beside their hand-worked results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.operators import documents, graph, parsing
from quillspar.plans.base import query, sql_first_match, sql_in
from quillspar.plans.structure import FILES, MODULES, NODES, counted, files, measured
from quillspar.sources import repository
from quillspar.sources.adapters import CODE_EDGES, EDGES, code, edges, quoted, read, sql_values, values

CORPUS = [
    (0, "src/app.js", 'import { a } from "./lib/a";\nimport b from \'./lib/b.js\';\nconst c = require("../other/c");\nimport "node:fs";\nimport x from "@scope/pkg/deep";\nexport { y } from "lodash/fp";\napp.get("/users", h);\napp.post(\'/users\', h);\nrouter.route("/items").get(h).delete(h);\nfetch("https://api.github.com/x");\n'),
    (1, "src/lib/a.js", 'import { b } from "./b";\n/** Adds.\n * @param {number} a - first\n * @param [b] second\n * @returns {number} sum\n */\nexport function one(a, b) {\n  if (a && b) { return 1; } else if (a) { return 2; }\n  return a ? 1 : 2;\n}\nconst two = (x) => x || "a && b"; // if (c)\n'),
    (2, "src/lib/b.js", 'import a from "./a";\nel.innerHTML = y;\n/* eval( */ eval("x");\nconst password = "hunter2hunter2";\nexport default function () { return a; }\n'),
    (3, "other/c/index.ts", "export interface A extends B { x: string }\nexport interface B {}\ntype T = A | Map<string, B>;\nexport class K extends L implements A {}\nabstract class L {}\nenum E { X }\n"),
    (4, "src/routes.tsx", 'import { Route } from "react-router-dom";\n<Route path="/home" />\n// path: "/skip"\nconst r = [{ path: "/about" }, { path: "/later" }];\n  path: \'/home\'\n'),
    (5, "src/router.js", 'import { createRouter } from "vue-router";\nconst routes = [\n  { path: "/v" },\n  { path: "/v" },\n  { path: "*" },\n];\n'),
    (6, "web/pages/api/u.ts", "export async function GET() {}\nexport async function DELETE() {}\n"),
    (7, "schema.graphql", "type Query {\n  user(id: ID!): User\n  # note\n}\ntype User implements Node & Thing {\n  id: ID!\n  name: String # shown\n}\nenum Role {\n  ADMIN\n  USER\n}\nunion Any = User | Role\nscalar Date\ndirective @auth on FIELD\ninput In { a: Int }\ntype User { other: Int }\n"),
    (8, "web/app/page.tsx", "export default function Page() {}\n"),
]


def corpus(spark: SparkSession) -> DataFrame:
    return values(spark, CORPUS, "ord long, path string, content string")


def golden(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM {sql_values(rows, names)}"


@query(golden([("src/app", "src/lib/a"), ("src/app", "src/lib/b"), ("src/app", "other/c"), ("src/lib/a", "src/lib/b"), ("src/lib/b", "src/lib/a")], "src, dst"))
def import_edges(spark, sf_dir):
    return parsing.import_edges(corpus(spark))


@query(golden([("@scope/pkg",), ("lodash",), ("react-router-dom",), ("vue-router",)], "package"))
def external_packages(spark, sf_dir):
    return parsing.external_packages(corpus(spark))


@query(golden([("src/app.js", "/users", "GET,POST"), ("src/app.js", "/items", "GET,DELETE")], "path, route, methods"))
def express_routes(spark, sf_dir):
    return parsing.express_routes(corpus(spark))


@query(golden([("src/routes.tsx", "/home", "React Router"), ("src/routes.tsx", "/about", "React Router"), ("src/router.js", "/v", "Vue Router"), ("web/app/page.tsx", "/page.tsx", "Next.js")], "path, route, framework"))
def page_routes(spark, sf_dir):
    return parsing.page_sources(corpus(spark))


@query(golden([("web/pages/api/u.ts", "/api/u", "GET,DELETE")], "path, route, methods"))
def api_methods(spark, sf_dir):
    found = corpus(spark).filter(text.is_api_route(F.col("path")))
    return found.select("path", text.route_path(F.col("path")).alias("route"), parsing.next_methods(F.col("content")).alias("methods"))


@query(golden([("GitHub API", "Version Control", "src/app.js")], "name, category, detected_in"))
def external_services(spark, sf_dir):
    return parsing.external_services(corpus(spark))


@query(golden([("src/lib/b.js", "innerhtml-assignment", "high", "CWE-79", 2), ("src/lib/b.js", "eval-usage", "high", "CWE-95", 3), ("src/lib/b.js", "hardcoded-password", "high", "CWE-798", 4)], "path, id, severity, cwe, line"))
def security_findings(spark, sf_dir):
    return parsing.findings(corpus(spark))


@query(golden([("high", 3), ("medium", 0), ("low", 0)], "severity, n"))
def findings_by_severity(spark, sf_dir):
    every = values(spark, [(s,) for s in rules.SEVERITIES], "severity string")
    found = parsing.findings(corpus(spark)).groupBy("severity").agg(F.count("*").alias("n"))
    return every.join(found, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@query(golden([("src/lib/a.js", "one", 7, 5), ("src/lib/a.js", "two", 11, 2)], "path, name, line, complexity"))
def function_complexity(spark, sf_dir):
    return parsing.functions(corpus(spark).filter("ord = 1"))


@query(golden([("src/lib/a.js", 6, 12, 2, 5)], "path, complexity, lines, functions, max_function"))
def file_complexity(spark, sf_dir):
    return parsing.measured(corpus(spark).filter("ord = 1"))


@query(golden([("src/lib/a.js", "one", "function", 7, "Adds.", "a:number,b?:any", "number", None), ("src/lib/b.js", "default", "default", 5, None, None, None, None)], "path, name, kind, line, description, params, returns, deprecated"))
def documented_exports(spark, sf_dir):
    return parsing.exports(corpus(spark).filter("ord IN (1, 2)"))


@query(golden([("src/lib/a.js", 1, 1, 1.0), ("src/lib/b.js", 1, 0, 0.0)], "path, exports, documented, share"))
def export_coverage(spark, sf_dir):
    return parsing.coverage(parsing.exports(corpus(spark).filter("ord IN (1, 2)")))


@query(golden([("schema.graphql", "query", "Query", "user"), ("schema.graphql", "type", "User", "id,name"), ("schema.graphql", "enum", "Role", "ADMIN,USER"), ("schema.graphql", "union", "Any", "User,Role"), ("schema.graphql", "scalar", "Date", ""), ("schema.graphql", "directive", "auth", ""), ("schema.graphql", "input", "In", "a")], "path, kind, name, members"))
def schema_members(spark, sf_dir):
    return parsing.schema_members(corpus(spark).filter("ord = 7"))


@query(golden([("A", "B", "extends"), ("T", "A", "references"), ("T", "B", "references"), ("K", "L", "extends"), ("K", "A", "implements")], "src, dst, relation"))
def type_relations(spark, sf_dir):
    return parsing.type_edges(corpus(spark))[1]


@query(golden([("A", "interface"), ("B", "interface"), ("T", "alias"), ("K", "class"), ("L", "class"), ("E", "enum")], "name, kind"))
def type_declarations(spark, sf_dir):
    return parsing.type_edges(corpus(spark))[0].select("name", "kind")


_PASSWORD = dict((i, p) for i, _, _, _, p in rules.SECURITY)["hardcoded-password"]


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, {quoted(_PASSWORD)})) AS BIGINT) AS found FROM documents WHERE regexp_matches(text, {quoted(_PASSWORD)})")
def credentials_in_documents(spark, sf_dir):
    found = F.size(F.regexp_extract_all("text", F.lit(_PASSWORD), F.lit(0))).cast("long")
    return read(spark, sf_dir, "documents").filter(F.col("text").rlike(_PASSWORD)).select("doc_id", found.alias("found"))


@query(f"SELECT doc_id, regexp_matches(text, {quoted(parsing.SECRETS)}) AS secret FROM documents")
def secrets_in_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(parsing.SECRETS).alias("secret"))


_CHARS = [("aaaa",), ("abab",), ("abcd",), ("sk1Zq9Xv",)]


@query("SELECT * FROM (VALUES ('aaaa', 0.0), ('abab', 1.0), ('abcd', 2.0), ('sk1Zq9Xv', 3.0)) AS v(word, bits)")
def character_entropy(spark, sf_dir):
    return values(spark, _CHARS, "word string").select("word", F.round(parsing.entropy(F.col("word")), 9).alias("bits"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cleaned FROM conversations")
def chatty_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    noisy = F.concat(F.lit("If you want, ask me.\nShould I go on?\nLet me know.\n"), F.col("text"), F.lit("\nHere is a summary of it:\n"))
    return rows.select("conv_id", "turn", parsing.sanitized(noisy).alias("cleaned"))


_JSON = [(1, '{"a": 1}'), (2, 'x ```json\n{"b": 2}\n``` y'), (3, "no"), (4, None)]


@query(golden([(1, '{"a": 1}'), (2, '{"b": 2}\n'), (3, None), (4, None)], "id, found"))
def rescued_json(spark, sf_dir):
    return values(spark, _JSON, "id int, raw string").select("id", parsing.rescued_json(F.col("raw")).alias("found"))


_SEGMENTS = [(1, "a **b** `c` *d* e"), (2, "x **y"), (3, "2 * 3 `q")]


@query(golden([(1, 0, "text", "a "), (1, 1, "bold", "b"), (1, 2, "text", " "), (1, 3, "code", "c"), (1, 4, "text", " "), (1, 5, "italic", "d"), (1, 6, "text", " e"), (2, 0, "text", "x "), (2, 1, "text", "**y"), (3, 0, "text", "2 "), (3, 1, "text", "*"), (3, 2, "text", " 3 "), (3, 3, "text", "`q")], "key, n, kind, content"))
def inline_segments(spark, sf_dir):
    return documents.segments_of(values(spark, _SEGMENTS, "key int, text string"))


_MARKDOWN = [(1, "# T\n\nSee [x](./y.md) **b**\n- i\n1. n\n> q\n---\n```js\nlet a;\n```\n| a | b |\n|---|---|\n| 1 |\n")]


@query(golden([(1, 0, "heading_1", "T"), (1, 1, "paragraph", "See x **b**"), (1, 2, "bulleted", "i"), (1, 3, "numbered", "n"), (1, 4, "quote", "q"), (1, 5, "divider", ""), (1, 6, "code:js", "let a;"), (1, 7, "table", "a|b\n1|")], "key, n, kind, content"))
def markdown_blocks(spark, sf_dir):
    return documents.blocks_of(values(spark, _MARKDOWN, "key int, text string"))


@query(golden([(1, '<h1>a &lt; b</h1><p>x <strong>y</strong></p><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">js</ac:parameter><ac:plain-text-body><![CDATA[c]]]]><![CDATA[>d]]></ac:plain-text-body></ac:structured-macro>'), (2, "<p><em>No content available.</em></p>")], "key, markup"))
def storage_markup(spark, sf_dir):
    return documents.stored(values(spark, [(1, "# a < b\nx **y**\n```js\nc]]>d\n```"), (2, " ")], "key int, text string"))


@query("SELECT page_id, regexp_replace(html, '\\[([^\\]]+)\\]\\(\\.{1,2}/[^)]+\\)', '\\1', 'g') = html AS same FROM pages")
def relative_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", (documents.without_relative_links(F.col("html")) == F.col("html")).alias("same"))


@query(f"""WITH RECURSIVE r(src, dst, hop) AS (SELECT src, dst, 1 FROM {EDGES} UNION SELECT r.src, e.dst, hop + 1 FROM r JOIN {EDGES} e ON r.dst = e.src WHERE hop < 8) SELECT DISTINCT src, dst FROM r""")
def reachable_nodes(spark, sf_dir):
    return graph.reachable(edges(spark, sf_dir), 8)


@query(f"WITH RECURSIVE r(src, dst, hop) AS (SELECT src, dst, 1 FROM {EDGES} UNION SELECT r.src, e.dst, hop + 1 FROM r JOIN {EDGES} e ON r.dst = e.src WHERE hop < 8) SELECT DISTINCT src AS key FROM r WHERE src = dst")
def nodes_on_cycles(spark, sf_dir):
    return graph.strong_components(edges(spark, sf_dir)).select(F.col("node").alias("key"))


@query("""SELECT doc_id AS key, doc_id // 5 * 5 AS root, 5::BIGINT AS size FROM documents WHERE (doc_id // 5) % 2 = 0 AND doc_id // 5 * 5 + 4 <= (SELECT max(doc_id) FROM documents)
UNION ALL SELECT doc_id, doc_id, 1 FROM documents WHERE (doc_id // 5) % 2 = 1 AND doc_id % 35 = 6""")
def document_components(spark, sf_dir):
    """Rows of five documents, every second closed to a ring, each row with an edge into a later one; some documents name themselves."""
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id")
    row = F.floor(d / 5)
    to = F.array(F.when(d % 5 < 4, d + 1), F.when((d % 5 == 4) & (row % 2 == 0), d - 4), F.when(d % 5 == 2, (row * 2 + 1) * 5), F.when((d % 35 == 6) & (row % 2 == 1), d))
    links = docs.select(d.alias("src"), F.explode(F.array_compact(to)).alias("dst")).join(docs.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    return graph.strong_components(links).withColumnRenamed("node", "key")


@query(f"""WITH RECURSIVE e AS (
  SELECT src, dst FROM {CODE_EDGES} UNION SELECT 'src/m' || (a % 20) || '/f' || a, 'src/m' || (b % 20) || '/f' || b FROM (SELECT doc_id AS a, doc_id + 1 - 2 * (doc_id % 6) AS b FROM documents WHERE doc_id % 6 IN (0, 1)) WHERE b <= (SELECT max(doc_id) FROM documents)),
r(src, dst, hop) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, hop + 1 FROM r JOIN e ON r.dst = e.src WHERE hop < 12) SELECT DISTINCT src AS key FROM r WHERE src = dst""")
def files_on_cycles(spark, sf_dir):
    """Files that import themselves by way of others: imports of `code`, and pairs of neighbours by id that name each other."""
    known = parsing.import_edges(code(spark, sf_dir))
    name = lambda x: F.concat(F.lit("src/m"), (x % 20).cast("string"), F.lit("/f"), x.cast("string"))
    d, last = F.col("doc_id"), read(spark, sf_dir, "documents").agg(F.max("doc_id")).scalar()
    pair = read(spark, sf_dir, "documents").filter((d % 6).isin(0, 1)).withColumn("other", d + 1 - 2 * (d % 6)).filter(F.col("other") <= last)
    added = pair.select(name(d).alias("src"), name(F.col("other")).alias("dst"))
    return graph.strong_components(known.union(added)).select(F.col("node").alias("key"))


@query(golden([("a", 0, "x > y > x"), ("a", 1, "x > y > z > x"), ("b", 0, "p > p")], "repo, n, cycle"))
def import_cycles(spark, sf_dir):
    rows = [("a", "x", "y", 0), ("a", "y", "x", 1), ("a", "y", "z", 2), ("a", "z", "x", 3), ("b", "p", "p", 0), ("b", "p", "q", 1)]
    return graph.cycles(values(spark, rows, "repo string, src string, dst string, ord int"))


@query(golden([("a", "a > c > d > b"), ("d", "d > b")], "start, chain"))
def greedy_walks(spark, sf_dir):
    rows = [("a", "b", 0), ("a", "c", 1), ("c", "d", 2), ("d", "b", 3), ("e", "c", 4), ("f", "c", 5), ("c", "a", 6)]
    walks = graph.greedy_walks(values(spark, [("a",), ("d",)], "key string"), values(spark, rows, "src string, dst string, ord int"))
    return walks.select("start", F.array_join("chain", " > ").alias("chain"))


@query(f"SELECT key, fan_out, CASE WHEN fan_in >= 5 THEN 'shared' WHEN fan_out = 0 THEN 'leaf' ELSE 'step' END AS kind FROM (SELECT key, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM {NODES} LEFT JOIN (SELECT dst AS key, count(*) AS i FROM {EDGES} GROUP BY 1) USING (key) LEFT JOIN (SELECT src AS key, count(*) AS o FROM {EDGES} GROUP BY 1) USING (key)) WHERE fan_in = 0 AND fan_out >= 2 ORDER BY fan_out DESC, key LIMIT 5")
def entry_points(spark, sf_dir):
    return graph.entry_points(measured(spark, sf_dir)).select("key", "fan_out", graph.step_kind(F.lit(1), F.col("fan_in"), F.col("fan_out")).alias("kind"))


@query(f"""SELECT a.r AS src, b.r AS dst, count(*) AS weight, 'imports' AS type FROM {EDGES} e JOIN (SELECT 'n' || n_nationkey AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey) a ON src = a.k JOIN (SELECT 'n' || n_nationkey AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey) b ON dst = b.k WHERE a.r <> b.r GROUP BY 1, 2""")
def module_rollup(spark, sf_dir):
    names = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("k"), "r_name")
    joined = edges(spark, sf_dir).join(names.select(F.col("k").alias("src"), F.col("r_name").alias("src_module")), "src").join(names.select(F.col("k").alias("dst"), F.col("r_name").alias("dst_module")), "dst")
    return graph.rolled_up(joined)


@query("SELECT 'Authentication Flow' AS name, true AS critical, string_agg(key, ',' ORDER BY key) AS modules FROM " + MODULES + " WHERE contains(lower(key), 'auth') OR contains(lower(key), 'login') OR contains(lower(key), 'session') HAVING count(*) > 0")
def keyword_flows(spark, sf_dir):
    return graph.keyword_flows(counted(spark, sf_dir))


_MANIFEST = json.dumps({"dependencies": {"next": "1", "react": "1"}, "devDependencies": {"vitest": "1", "typescript": "5"}, "optionalDependencies": {"chalk": "1"}, "workspaces": ["packages/*"], "type": "module"})
_REPO = [
    ("package.json", _MANIFEST), ("packages/a/package.json", json.dumps({"name": "a", "version": "1.0.0", "dependencies": {"x": "1"}})), ("packages/b/package.json", json.dumps({"name": "b"})), ("packages/c/readme.md", ""),
    ("requirements.txt", "Django==4\npytest\n"), ("go.mod", "require github.com/gin-gonic/gin v1"), ("pnpm-workspace.yaml", "packages:\n  - 'apps/*'\nother:\n  - no\n"),
    (".github/CODEOWNERS", "# c\n* @all\n\ndocs/ nobody\n*.ts @web x@y.z\n"),
]


def repo(spark: SparkSession) -> DataFrame:
    return values(spark, _REPO, "path string, content string")


@query(golden([("framework", "Next.js"), ("framework", "React"), ("framework", "Django"), ("framework", "Gin"), ("test", "Vitest"), ("test", "pytest"), ("language", "TypeScript"), ("language", "Node.js"), ("language", "Python"), ("language", "Go")], "kind, name"))
def technologies(spark, sf_dir):
    return repository.technologies(repo(spark))


@query(golden([("a", "packages/a", "1.0.0", "x"), ("b", "packages/b", "0.0.0", "")], "name, path, version, dependencies"))
def workspaces(spark, sf_dir):
    return repository.workspaces(repo(spark))


@query(golden([(1, "*", "@all"), (2, "*.ts", "@web,x@y.z")], "ord, pattern, owners"))
def owner_rules(spark, sf_dir):
    return repository.owner_rules(repo(spark))


@query(golden([("apps/*",)], "pattern"))
def pnpm_packages(spark, sf_dir):
    return repository.pnpm_packages(repo(spark))


_URLS = [("https://n.so/My-Page-0123456789abcdef0123456789abcdef?v=1",), ("https://n.so/01234567-89ab-cdef-0123-456789abcdef",), ("https://x.atlassian.net/wiki/spaces/ENG/pages/12345/Title",), ("none",)]


@query(golden([(_URLS[0][0], "0123456789abcdef0123456789abcdef", None, None), (_URLS[1][0], "0123456789abcdef0123456789abcdef", None, None), (_URLS[2][0], None, "ENG", "12345"), ("none", None, None, None)], "url, page, space, wiki_page"))
def page_ids(spark, sf_dir):
    u = F.col("url")
    return values(spark, _URLS, "url string").select("url", repository.page_id(u).alias("page"), repository.wiki_space(u).alias("space"), repository.wiki_page(u).alias("wiki_page"))


@query(golden([("added", "src/a.js"), ("removed", "b.js"), ("modified", "old.js")], "status, file"))
def captured_diff(spark, sf_dir):
    return repository.diff(values(spark, [("A\tsrc/a.js",), ("D\tb.js",), ("R100\told.js\tnew.js",), ("",)], "value string"))


@query(f"SELECT doc_key, line_no, text FROM (SELECT 'module_catalog' AS doc_key, 0 AS line_no, '# Modules' AS text UNION ALL SELECT 'module_catalog', CAST(row_number() OVER (ORDER BY key) AS INTEGER), '- ' || key || ': ' || file_count FROM (SELECT * FROM {MODULES} ORDER BY key LIMIT 100))")
def module_catalog(spark, sf_dir):
    return documents.lines(counted(spark, sf_dir), "module_catalog", "key", "Modules", F.concat(F.lit("- "), "key", F.lit(": "), F.col("file_count").cast("string")))


@query("SELECT '{\"title\":\"p\",\"colour\":\"yellow\",\"change\":-7.5}' AS embed")
def chat_notification(spark, sf_dir):
    return documents.notification(values(spark, [("p", -7.5)], "project string, change double"))
