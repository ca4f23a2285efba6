"""Queries over files, modules, domains, roles and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.operators import modules as m
from quillspar.plans.base import query, sql_first_match, sql_in
from quillspar.sources.adapters import EDGES, FILES, edges, files, quoted, read, sql_values, values

ROOTS = [f"src{k}/src" for k in range(0, 20, 2)] + ["src0/src/pages"]
_ROOTS = ", ".join(f"({quoted(r)})" for r in ROOTS)
#: The longest root above a path, then the next segment.
KEYED = f"""(SELECT f.*, CASE WHEN root IS NULL THEN split_part(path, '/', 1) WHEN path = root THEN root ELSE root || '/' || split_part(substr(path, length(root) + 2), '/', 1) END AS key
  FROM (SELECT f.*, (SELECT arg_max(r, length(r)) FROM (VALUES {_ROOTS}) AS t(r) WHERE path = r OR starts_with(path, r || '/')) AS root FROM {FILES} f) f)"""
MODULES = f"(SELECT key, count(*) AS file_count, min(ord) AS first_ord FROM {KEYED} GROUP BY key)"
HINTS = [("Shops", ["shop", "cart"])]
_PAIRS = [(i, d, k) for i, (d, k) in enumerate([(d, k) for d, ks in [*HINTS, *rules.DOMAINS] for k in ks])]
DOMAIN_DIM = sql_values(_PAIRS, "prio, domain, keyword")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.module_key(files(spark, sf_dir), ROOTS)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.count_modules(keyed(spark, sf_dir))


def with_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).withColumn("d", m.domain_of(F.col("key"), HINTS)).select("key", "file_count", "first_ord", "d.domain", "d.keyword")


DOMAINED = f"(SELECT m.*, coalesce((SELECT arg_min(domain, prio) FROM {DOMAIN_DIM} WHERE contains(lower(key), keyword)), 'Other') AS domain, (SELECT arg_min(keyword, prio) FROM {DOMAIN_DIM} WHERE contains(lower(key), keyword)) AS keyword FROM {MODULES} m)"


@query(f"SELECT domain, count(*) AS modules, CAST(sum(file_count) AS BIGINT) AS files FROM {DOMAINED} GROUP BY domain")
def domain_rollup(spark, sf_dir):
    return with_domain(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("modules"), F.sum("file_count").alias("files")).orderBy(F.desc("files"), "domain")


@query(f"SELECT key, file_count, first_ord FROM {MODULES}")
def module_counts(spark, sf_dir):
    return counted(spark, sf_dir).orderBy(F.desc("file_count"), "first_ord")


@query(f"SELECT key, domain, keyword, CASE WHEN domain = 'Other' THEN 'none' ELSE 'pattern_match' END AS confidence FROM {DOMAINED}")
def module_domains(spark, sf_dir):
    return with_domain(spark, sf_dir).select("key", "domain", "keyword", F.when(F.col("domain") == "Other", "none").otherwise("pattern_match").alias("confidence"))


@query(f"SELECT key, {sql_first_match('key', rules.MODULE_TYPES, 'other')} AS type, {sql_first_match('key', rules.MAP_CATEGORIES, 'other')} AS category, {sql_first_match('key', rules.DESCRIPTIONS, 'module')} AS described FROM {MODULES}")
def module_kinds(spark, sf_dir):
    k = F.col("key")
    return counted(spark, sf_dir).select("key", text.first_match(k, rules.MODULE_TYPES, "other").alias("type"), text.first_match(k, rules.MAP_CATEGORIES, "other").alias("category"), text.first_match(k, rules.DESCRIPTIONS, "module").alias("described"))


_LANG = sql_values(rules.LANGUAGES, "ext, language")


@query(f"SELECT language, count(*) AS files FROM {FILES} f JOIN {_LANG} l ON lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) = ext GROUP BY language")
def languages(spark, sf_dir):
    dim = F.broadcast(values(spark, rules.LANGUAGES, "ext string, language string"))  # a constant of 29 rows
    return files(spark, sf_dir).withColumn("ext", text.extension(F.col("path"))).join(dim, "ext").groupBy("language").agg(F.count("*").alias("files"))


@query(f"SELECT ord, path FROM {FILES} WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN {sql_in(rules.CODE_EXTENSIONS)} AND NOT regexp_matches(path, {quoted(rules.SKIPPED)})")
def analysable_files(spark, sf_dir):
    return files(spark, sf_dir).filter(text.extension(F.col("path")).isin(*rules.CODE_EXTENSIONS) & ~F.col("path").rlike(rules.SKIPPED))


ROUTED = """CASE
  WHEN contains(path, '/app/') THEN '/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(path, instr(path, '/app/') + 5), '/page\\.(ts|tsx|js|jsx)$', ''), '/route\\.(ts|tsx|js|jsx)$', ''), '\\[(.*?)\\]', ':\\1', 'g'), '/$', '')
  WHEN contains(path, '/pages/api/') THEN '/api/' || regexp_replace(substr(path, instr(path, '/pages/api/') + 11), '\\.(ts|tsx|js|jsx)$', '')
  WHEN contains(path, '/pages/') THEN '/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(path, instr(path, '/pages/') + 7), '\\.(ts|tsx|js|jsx)$', ''), '/index$', ''), '\\[(.*?)\\]', ':\\1', 'g'), '/$', '')
  ELSE path END"""
IS_API = "(contains(path, '/pages/api/') OR (contains(path, '/app/') AND (ends_with(path, '/route.ts') OR ends_with(path, '/route.js'))))"
IS_PAGE = "(CASE WHEN contains(path, '/app/') THEN regexp_matches(path, '/page\\.(tsx|jsx|ts|js)$') ELSE contains(path, '/pages/') AND NOT contains(path, '/pages/api/') AND regexp_matches(path, '\\.(tsx|jsx|ts|js)$') END)"


@query(f"SELECT ord, path, {ROUTED} AS route, {IS_API} AS is_api, {IS_PAGE} AS is_page FROM {FILES} WHERE {IS_API} OR {IS_PAGE}")
def file_routes(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).filter(text.is_api_route(p) | text.is_page(p)).select("ord", "path", text.route_path(p).alias("route"), text.is_api_route(p).alias("is_api"), text.is_page(p).alias("is_page"))


_PATHS = [("src/app/page.tsx",), ("web/app/blog/[slug]/page.tsx",), ("x/pages/api/[id].ts",), ("x/pages/[a]/index.jsx",), ("x/app/api/u/route.ts",), ("a\\b\\app\\c.ts",), ("pages/api/x.ts",), ("x/pages/index.js",)]


@query(f"SELECT path, {ROUTED} AS route FROM {sql_values(_PATHS, 'path')}")
def route_projection(spark, sf_dir):
    return values(spark, _PATHS, "path string").select("path", text.route_path(F.col("path")).alias("route"))


_URL = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"


@query(f"SELECT page_id, {_URL} AS route, ({_URL} NOT IN ('', '...', '*') AND length({_URL}) <= 200 AND regexp_matches({_URL}, '^[/a-zA-Z0-9]')) AS valid FROM pages")
def url_routes(spark, sf_dir):
    route = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", route.alias("route"), text.valid_route(route).alias("valid"))


_LABELS = [("src/core",), ("app/(shop)/cart",), ("a//b/(x)/c",), ("src/a-b.c",)]


@query(f"SELECT key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(key, '^src/', ''), '^app/\\((.*?)\\)', 'app/\\1'), '/\\((.*?)\\)', '/\\1', 'g'), '/+', '/', 'g') AS label, regexp_replace(key, '[^a-zA-Z0-9_]', '_', 'g') AS id FROM {sql_values(_LABELS, 'key')}")
def labels_and_ids(spark, sf_dir):
    return values(spark, _LABELS, "key string").select("key", text.label(F.col("key")).alias("label"), text.node_id(F.col("key")).alias("id"))


OWNER_RULES = [(1, "*", ["@all"]), (2, "*.ts", ["@web", "@types"]), (3, "src1/", ["@one"]), (4, "/src2/src/**/page.js", ["@pages"]), (5, "auth", ["@sec"])]
_OWNER_SQL = [(o, r, n) for o, r, n in ((1, "(^|/)[^/]*($|/)", ["@all"]), (2, "(^|/)[^/]*\\.ts($|/)", ["@web", "@types"]), (3, "(^|/)src1/", ["@one"]), (4, "(^|/)src2/src/.*/page\\.js$", ["@pages"]), (5, "(^|/)auth($|/)", ["@sec"]))]
OWNED = f"(SELECT f.*, (SELECT arg_max(owners, prio) FROM {sql_values(_OWNER_SQL, 'prio, pattern, owners')} WHERE regexp_matches(path, pattern)) AS owners FROM {FILES} f)"


@query(f"SELECT ord, path, array_to_string(owners, ',') AS owners FROM {OWNED}")
def file_owners(spark, sf_dir):
    return m.owners(files(spark, sf_dir), OWNER_RULES).withColumn("owners", F.array_join("owners", ","))


@query(f"SELECT split_part(path, '/', 1) AS key, unnest AS owner, count(*) AS files FROM {OWNED}, unnest(owners) GROUP BY 1, 2")
def owner_counts(spark, sf_dir):
    spread = m.owners(files(spark, sf_dir), OWNER_RULES).select(F.split("path", "/")[0].alias("key"), F.explode("owners").alias("owner"))
    return spread.groupBy("key", "owner").agg(F.count("*").alias("files")).orderBy("key", F.desc("files"), "owner")


_MODS = [("src0", 0), ("src0/src", 1), ("src0/src/auth", 2), ("src1/src/api/g0/route.ts", 3), ("src2", 4), ("src4/src/core", 5)]


@query(f"""WITH mods AS {sql_values(_MODS, 'key, first_ord')}, hits AS (
  SELECT ord, path, key, first_ord, path = key OR path = regexp_replace(key, '\\.[^/.]+$', '') AS exact FROM {FILES} JOIN mods
  ON path = key OR path = regexp_replace(key, '\\.[^/.]+$', '') OR starts_with(path, key || '/') OR starts_with(path, regexp_replace(key, '\\.[^/.]+$', '') || '/')),
best AS (SELECT ord, arg_max(key, (CASE WHEN exact THEN 1e9 ELSE length(key) END) - first_ord * 1e-6) AS module FROM hits GROUP BY ord)
SELECT f.ord, f.path, module FROM {FILES} f LEFT JOIN best USING (ord)""")
def nearest_module(spark, sf_dir):
    return m.longest_prefix(files(spark, sf_dir), values(spark, _MODS, "key string, first_ord long"), "path")


NODES = f"(SELECT DISTINCT key FROM (SELECT src AS key FROM {EDGES} UNION ALL SELECT dst FROM {EDGES} UNION ALL SELECT 'n' || n_nationkey FROM nation))"
DEGREES = f"(SELECT key, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM {NODES} LEFT JOIN (SELECT dst AS key, count(*) AS i FROM {EDGES} GROUP BY 1) USING (key) LEFT JOIN (SELECT src AS key, count(*) AS o FROM {EDGES} GROUP BY 1) USING (key))"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.degrees(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"SELECT count(*) AS nodes, CAST(sum(fan_out) AS BIGINT) AS edges, count(*) FILTER (WHERE fan_in = 0 AND fan_out = 0) AS orphans FROM {DEGREES}")
def graph_counts(spark, sf_dir):
    return measured(spark, sf_dir).agg(F.count("*").alias("nodes"), F.sum("fan_out").alias("edges"), F.count_if((F.col("fan_in") == 0) & (F.col("fan_out") == 0)).alias("orphans"))


@query(f"SELECT key, fan_in FROM {DEGREES} WHERE fan_in >= greatest(5, floor(0.1 * (SELECT count(*) FROM {NODES}))) ORDER BY fan_in DESC, key LIMIT 10")
def graph_hubs(spark, sf_dir):
    total = nodes(spark, sf_dir).agg(F.count("*")).scalar()
    return measured(spark, sf_dir).filter(F.col("fan_in") >= F.greatest(F.lit(5), F.floor(total * 0.1))).orderBy(F.desc("fan_in"), "key").limit(10).select("key", "fan_in")


_ROLE = "CASE WHEN is_orphan THEN 'isolated' WHEN is_hub AND fan_in >= 15 THEN 'critical shared' WHEN is_hub THEN 'shared' WHEN is_orchestrator THEN 'orchestrator' WHEN is_leaf THEN 'leaf' WHEN fan_in > 0 AND fan_out > 0 THEN 'connector' END"


@query(f"SELECT *, {_ROLE} AS role FROM (SELECT key, fan_in, fan_out, fan_in >= greatest(3, floor(0.05 * (SELECT count(*) FROM {NODES}))) AS is_hub, fan_in = 0 AND fan_out = 0 AS is_orphan, fan_out = 0 AND fan_in > 0 AS is_leaf, fan_out >= 5 AND fan_in < fan_out AS is_orchestrator FROM {DEGREES})")
def node_roles(spark, sf_dir):
    return m.with_roles(measured(spark, sf_dir))


_HEALTH_SQL = """(SELECT doc_id AS file, CAST(n_chars % 60 AS BIGINT) AS complexity, CAST(n_chars % 17 AS BIGINT) AS max_function, CAST(doc_id % 11 AS BIGINT) AS fan_in, CAST(doc_id % 7 AS BIGINT) AS fan_out,
  CAST(doc_id % 4 AS BIGINT) AS exports, CAST(coalesce(quality, 1) AS DOUBLE) * 0.6 AS coverage, CAST(coalesce(toxic, 0) AS BIGINT) AS high, CAST(doc_id % 3 AS BIGINT) AS medium FROM documents LEFT JOIN labels USING (doc_id))"""


def health_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    mod = lambda c, n: (F.col(c) % n).cast("long")
    return joined.select(F.col("doc_id").alias("file"), mod("n_chars", 60).alias("complexity"), mod("n_chars", 17).alias("max_function"), mod("doc_id", 11).alias("fan_in"), mod("doc_id", 7).alias("fan_out"), mod("doc_id", 4).alias("exports"), (F.coalesce("quality", F.lit(1)).cast("double") * 0.6).alias("coverage"), F.coalesce("toxic", F.lit(0)).cast("long").alias("high"), mod("doc_id", 3).alias("medium"))


_SCORE = """greatest(0, least(100, 100 - CASE WHEN complexity > 10 THEN least(25, complexity - 10) ELSE 0 END - CASE WHEN complexity > 30 THEN least(15, (complexity - 30) * 2) ELSE 0 END
  - CASE WHEN max_function > 8 THEN least(15, (max_function - 8) * 2) ELSE 0 END - CASE WHEN fan_in * fan_out > 20 THEN least(15, (fan_in * fan_out - 20) // 5) ELSE 0 END
  - CASE WHEN exports > 0 THEN CASE WHEN coverage < 0.5 THEN 10 WHEN coverage < 0.8 THEN 5 ELSE 0 END ELSE 0 END - high * 10 - medium * 5))"""
_GRADE = "CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'F' END"
SCORED = f"(SELECT file, complexity, CAST({_SCORE} AS BIGINT) AS score FROM {_HEALTH_SQL})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_inputs(spark, sf_dir).select("file", "complexity", m.file_health().alias("score"))


@query(f"SELECT file, score, {_GRADE} AS grade FROM {SCORED}")
def file_health(spark, sf_dir):
    return scored(spark, sf_dir).select("file", "score", m.grade(F.col("score")).alias("grade"))


@query(f"SELECT coalesce(avg(score), 100) AS avg_score, coalesce(avg(complexity), 0) AS avg_complexity, {', '.join(f'count(*) FILTER (WHERE grade = {quoted(g)}) AS grade_{g.lower()}' for g in 'ABCDF')} FROM (SELECT *, {_GRADE} AS grade FROM {SCORED})")
def health_summary(spark, sf_dir):
    graded = scored(spark, sf_dir).withColumn("grade", m.grade(F.col("score")))
    return graded.agg(F.coalesce(F.avg("score"), F.lit(100.0)).alias("avg_score"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("avg_complexity"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"])


@query(f"SELECT file, score FROM {SCORED} WHERE score < 60 ORDER BY score, file LIMIT 20")
def health_hotspots(spark, sf_dir):
    return scored(spark, sf_dir).filter("score < 60").orderBy("score", "file").limit(20).select("file", "score")


_REPOS = [(0, 0, 10, 5, 12, True), (1, 3, 10, 60, 12, False), (5, 1, 0, 120, 0, False), (0, 2, 15, 0, 3, True), (0, 0, 3, 0, 0, False)]


@query(f"""SELECT id, CAST(greatest(0, least(100, CASE WHEN cycles = 0 AND edges > 0 THEN least(100, s + 5) ELSE s END)) AS BIGINT) AS score FROM (SELECT *, 100 - least(30, cycles * 10) - CASE WHEN orphans / greatest(files, 1) > 0.2 THEN 20 WHEN orphans / greatest(files, 1) > 0.1 THEN 10 ELSE 0 END
  - CASE WHEN externals > 100 THEN 15 WHEN externals > 50 THEN 5 ELSE 0 END - CASE WHEN has_tests THEN 0 ELSE 10 END AS s FROM {sql_values([(i, *r) for i, r in enumerate(_REPOS)], 'id, cycles, orphans, files, externals, edges, has_tests')})""")
def repository_health(spark, sf_dir):
    rows = values(spark, [(i, *r) for i, r in enumerate(_REPOS)], "id int, cycles int, orphans int, files int, externals int, edges int, has_tests boolean")
    return rows.select("id", m.repository_health().alias("score"))


_DOCS_HEALTH = [(1, 80.0, 100.0, 90.0, 50.0), (2, 0.0, 0.0, 0.0, 0.0), (3, 100.0, 100.0, 100.0, 100.0), (4, 33.3, 12.5, 70.0, 6.25)]


@query(f"SELECT id, CAST(floor(least(100, greatest(0, CAST(a AS DOUBLE) * 0.35::DOUBLE + CAST(b AS DOUBLE) * 0.25::DOUBLE + CAST(c AS DOUBLE) * 0.25::DOUBLE + CAST(d AS DOUBLE) * 0.15::DOUBLE)) + 0.5::DOUBLE) AS BIGINT) AS score FROM {sql_values(_DOCS_HEALTH, 'id, a, b, c, d')}")
def documentation_health(spark, sf_dir):
    return values(spark, _DOCS_HEALTH, "id int, coverage double, freshness double, quality double, completeness double").select("id", m.documentation_health().alias("score"))


@query(f"SELECT domain, key, rank FROM (SELECT domain, key, row_number() OVER (PARTITION BY domain ORDER BY file_count DESC, first_ord) AS rank FROM {DOMAINED}) WHERE rank <= 5")
def top_modules_by_domain(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("file_count"), "first_ord"))
    return with_domain(spark, sf_dir).withColumn("rank", rank).filter("rank <= 5").select("domain", "key", "rank")


@query(f"SELECT avg(files) AS avg_files, CAST(max(files) AS DOUBLE) / nullif(sum(files), 0) AS largest_share FROM (SELECT CAST(sum(file_count) AS BIGINT) AS files FROM {DOMAINED} GROUP BY domain)")
def domain_concentration(spark, sf_dir):
    each = with_domain(spark, sf_dir).groupBy("domain").agg(F.sum("file_count").alias("files"))
    return each.agg(F.avg("files").alias("avg_files"), F.try_divide(F.max("files").cast("double"), F.sum("files")).alias("largest_share"))


_SCALE = "CASE WHEN n < 20 THEN 'small' WHEN n < 100 THEN 'medium' WHEN n < 500 THEN 'large' ELSE 'enterprise' END"


@query(f"SELECT key, file_count AS n, {_SCALE.replace('n <', 'file_count <')} AS scale, CASE WHEN file_count > 100 THEN 3 WHEN file_count > 50 THEN 2 WHEN file_count > 20 THEN 1 ELSE 0 END AS size FROM {MODULES}")
def module_scale(spark, sf_dir):
    n = F.col("file_count")
    scale = F.when(n < 20, "small").when(n < 100, "medium").when(n < 500, "large").otherwise("enterprise")
    return counted(spark, sf_dir).select("key", n.alias("n"), scale.alias("scale"), F.when(n > 100, 3).when(n > 50, 2).when(n > 20, 1).otherwise(0).alias("size"))


_STEPS = [(i, s) for i, s in enumerate(["Load the user", "validate input", "mapRows", "persist it", "Notify peers", "showAll", "check login", "memoise", "trackEvent", "nothing", "login form", None])]


@query(f"SELECT id, {sql_first_match(chr(99) + 'oalesce(step, ' + chr(39) * 2 + ')', rules.STEP_PURPOSES, 'Processing step')} AS purpose FROM {sql_values(_STEPS, 'id, step')}")
def step_purposes(spark, sf_dir):
    return values(spark, _STEPS, "id int, step string").select("id", text.first_match(F.coalesce("step", F.lit("")), rules.STEP_PURPOSES, "Processing step").alias("purpose"))


@query(f"SELECT route, coalesce((SELECT arg_min(domain, prio) FROM {DOMAIN_DIM} WHERE contains(lower(route), keyword)), 'Other') AS domain FROM (SELECT DISTINCT {_URL} AS route FROM pages)")
def route_domains(spark, sf_dir):
    routes = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("route")).distinct()
    return routes.select("route", m.domain_of(F.col("route"), HINTS)["domain"].alias("domain"))
