"""Facts of source files put side by side: health of each file, findings with their place, documentation, quality issues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.operators import context, modules, parsing
from quillspar.session import write_table

MOST_SNIPPET, SAMPLES = 200, 5


def code_health(files: DataFrame) -> DataFrame:
    """Per analysed file (path, content): its measures, coupling, documentation, findings, score and grade."""
    return health_of(parsed(files))


def parsed(files: DataFrame, each_function: bool = False) -> DataFrame:
    """The facts of files (path, content), parsed once into a narrow table. No file is read or shuffled again for what follows from it."""
    return write_table(parsing.file_facts(files, each_function), "facts")


def health_of(known: DataFrame) -> DataFrame:
    """Health from `parsed`; degrees come from its imports."""
    edges = parsing.fact_edges(known)
    end = lambda at, i, o: edges.select(F.col(at).alias("key"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    degrees = end("dst", 1, 0).unionByName(end("src", 0, 1)).groupBy("key").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    share = F.try_divide(F.col("documented").cast("double"), F.col("exports"))
    joined = known.filter("analysed").withColumns({"key": text.file_key(F.col("path")), "coverage": share}).join(degrees, "key", "left")
    whole = joined.fillna(0, ["fan_in", "fan_out"]).fillna(1.0, ["coverage"])
    scored = whole.withColumn("score", modules.file_health())
    return scored.select(
        F.col("path").alias("file"), "score", modules.grade(F.col("score")).alias("grade"), "lines", "complexity", "max_function", "fan_in", "fan_out",
        F.when(F.col("exports") > 0, text.half_up(F.col("coverage") * 100).cast("long")).alias("doc_percent"), "findings", "high",
    )


def health_totals(health: DataFrame) -> DataFrame:
    """One row: files, rounded averages, files by grade, and the same in words."""
    half = lambda c, empty: F.coalesce(text.half_up(F.avg(c)), F.lit(empty)).cast("long")
    totals = health.agg(F.count("*").alias("files"), half("score", 100).alias("avg_score"), half("complexity", 0).alias("avg_complexity"), F.count_if(F.col("score") < 60).alias("hotspots"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"])
    grades = F.concat_ws(", ", *[F.concat(F.col(f"grade_{g.lower()}").cast("string"), F.lit(f" {g}")) for g in "ABCDF"])
    words = F.concat_ws(" · ", F.concat(F.col("files").cast("string"), F.lit(" files")), F.concat(F.lit("average "), F.col("avg_score").cast("string")), grades)
    return totals.withColumn("summary", F.when(F.col("files") > 0, words).otherwise("no source files"))


def hottest_functions(functions: DataFrame, most: int = 15) -> DataFrame:
    return functions.orderBy(F.desc("complexity"), "path", "line", "name").limit(most)


def findings_in_place(files: DataFrame) -> DataFrame:
    """Findings with category, a name, and up to three lines around them, cut at MOST_SNIPPET characters."""
    compiled = [(i, c, s, w, re.compile(p, re.A | re.M)) for i, c, s, w, p in rules.SECURITY]

    def one(source: str) -> list[tuple]:
        plain = parsing.strip_comments(source, parsing.WIDE)
        rows, held, place = [], None, parsing.line_of(plain)
        for i, category, severity, cwe, pattern in compiled:
            for m in pattern.finditer(plain):
                held = parsing.strip_comments(source).split("\n") if held is None else held
                line = place(m.start())
                snippet = "\n".join(held[max(0, line - 2) : line + 1]).strip()
                rows.append((i, category, i.replace("-", " "), severity, cwe, line, snippet[:MOST_SNIPPET] + "..." * (len(snippet) > MOST_SNIPPET)))
        return rows

    kept = files.filter(~F.col("path").rlike(rules.SKIPPED + "|" + rules.CONFIG_FILE))
    return parsing._per_row(kept, one, "id string, category string, name string, severity string, cwe string, line long, snippet string")


def security_totals(findings: DataFrame) -> DataFrame:
    """One row: findings, files that have some, and findings by severity, none left out; and the same in words."""
    totals = findings.agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"), *[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES])
    return _security_words(totals)


def security_totals_of(known: DataFrame) -> DataFrame:
    """The same from `parsed`."""
    low = F.col("findings") - F.col("high") - F.col("medium")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = {"high": F.col("high"), "medium": F.col("medium"), "low": low}
    totals = known.agg(total("findings").alias("findings"), F.count_distinct(F.when(F.col("findings") > 0, F.col("path"))).alias("files"), *[total(counts[s]).alias(s) for s in rules.SEVERITIES])
    return _security_words(totals)


def _security_words(totals: DataFrame) -> DataFrame:
    part = lambda c, words: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words)))
    words = F.concat_ws(" · ", part("findings", " findings"), *[part(s, f" {s}") for s in rules.SEVERITIES], F.concat(F.lit("in "), F.col("files").cast("string"), F.lit(" files")))
    return totals.withColumn("summary", F.when(F.col("findings") > 0, words).otherwise("no findings"))


def findings_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"))


def documentation_totals(exports: DataFrame) -> DataFrame:
    """One row: exports, documented ones, their rounded percentage (0 without exports), deprecated ones and files."""
    totals = exports.agg(F.count("*").alias("exports"), F.count("description").alias("documented"), F.count("deprecated").alias("deprecated"), F.count_distinct("path").alias("files"))
    percent = F.coalesce(text.half_up(F.try_divide(F.col("documented") * 100.0, F.col("exports"))), F.lit(0)).cast("long")
    return totals.withColumn("percent", percent)


def deprecated_exports(exports: DataFrame) -> DataFrame:
    return exports.filter("deprecated IS NOT NULL").select("path", "name", "deprecated")


#: Parts of a documentation comment, each with how it is written down.
_PARTS = "params array<struct<name:string,type:string,optional:boolean,description:string>>, returns struct<type:string,description:string>, throws array<string>, examples array<string>, see array<string>, since string"


def documentation(files: DataFrame) -> DataFrame:
    """Per documented export: path, name, line, description, deprecated and all parts of its comment."""

    def one(source: str) -> list[tuple]:
        rows = []
        for name, _, line, doc in parsing.documented(source):
            params = [{k: p[k] for k in ("name", "type", "optional", "description")} for p in doc["params"]]
            rows.append((name, line, doc["description"], doc["deprecated"], params, doc["returns"], doc["throws"], doc["examples"], doc["see"], doc["since"]))
        return rows

    return parsing._per_row(files, one, "name string, line long, description string, deprecated string, " + _PARTS, ["name", "line", "description", "deprecated", "params", "returns", "throws", "examples", "see", "since"])


def documentation_text() -> Column:
    """The Markdown of one row of `documentation`: a table of what its comment states, then the description and examples.

    Line breaks in a cell become blanks, and bars are escaped.
    """
    cell = lambda x: F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    row = lambda what, kind, note: F.concat(F.lit("| "), what, F.lit(" | "), cell(kind), F.lit(" | "), cell(note), F.lit(" |"))
    nothing = F.lit("")
    param = lambda p: row(F.concat(F.when(p["optional"], "optional input ").otherwise("input "), F.lit("`"), p["name"], F.lit("`")), p["type"], p["description"])
    stated = F.concat(
        F.array_compact(F.array(
            F.when(F.col("deprecated").isNotNull(), row(F.lit("deprecated"), nothing, F.col("deprecated"))),
            F.when(F.col("since") != "", row(F.lit("since"), nothing, F.col("since"))),
        )),
        F.transform("params", param),
        F.array_compact(F.array(F.when(F.col("returns").isNotNull(), row(F.lit("result"), F.col("returns.type"), F.col("returns.description"))))),
        F.transform("throws", lambda x: row(F.lit("error"), nothing, x)),
    )
    table = F.when(F.size(stated) > 0, F.concat(F.lit("| Part | Type | Note |\n|---|---|---|\n"), F.array_join(stated, "\n")))
    examples = F.transform("examples", lambda x: F.concat(F.lit("    "), F.replace(x, F.lit("\n"), F.lit("\n    "))))
    return F.concat_ws("\n\n", table, F.nullif("description", nothing), examples)


def export_doc(documented: DataFrame, name: str) -> DataFrame:
    """The first export of that name, by path and line."""
    return documented.filter(F.col("name") == name).orderBy("path", "line").limit(1)


def file_docs(documented: DataFrame, path: str) -> DataFrame:
    return documented.filter(F.col("path") == path)


def quality_issues(entries: DataFrame) -> DataFrame:
    """Issues among entries (kind module, api or page; ord, label, described, files): type, severity, n, first samples."""
    kind, bare = F.col("kind"), ~F.col("described")
    tests = (
        ("undocumented_modules", "medium", (kind == "module") & bare & (F.col("files") > 0)), ("undocumented_apis", "high", (kind == "api") & bare),
        ("undocumented_pages", "low", (kind == "page") & bare), ("empty_modules", "low", (kind == "module") & (F.col("files") == 0)),
    )
    hit = F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("type"), F.lit(s).alias("severity"))) for n, s, t in tests])))
    each = entries.select("ord", "label", hit.alias("i")).select("i.type", "i.severity", "ord", "label")
    rank = F.row_number().over(Window.partitionBy("type").orderBy("ord", "label"))
    counted = each.groupBy("type", "severity").agg(F.count("*").alias("n"))
    first = each.withColumn("rank", rank).filter(F.col("rank") <= SAMPLES).groupBy("type").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("s"))
    return counted.join(first, "type").select("type", "severity", "n", F.array_join(F.transform("s", lambda x: x["label"]), ",").alias("samples"))


def module_roles(keys: DataFrame, edges: DataFrame, least: int = 5, share: float = 0.15) -> DataFrame:
    """(key, fan_in, fan_out, flags, role) of modules (key) by the edges (src, dst) between files that leave or enter them."""
    n = keys.agg(F.count("*")).scalar()
    counted = context.module_edges(keys, edges)
    i, o = F.col("fan_in"), F.col("fan_out")
    flagged = counted.withColumns({"is_hub": i >= F.greatest(F.lit(least), F.floor(n * share)), "is_orphan": (i == 0) & (o == 0), "is_leaf": (o == 0) & (i > 0), "is_orchestrator": (o >= 5) & (i < o)})
    return flagged.withColumn("role", modules.role_of())


def described_modules(keys: DataFrame, roles: DataFrame) -> DataFrame:
    """(key, description): what a module's name tells, and its role with the counts behind it, if it has one."""
    base = text.first_match(F.col("key"), rules.DESCRIPTIONS, "other code")
    counts = F.when(F.col("role") == "connector", F.format_string("connector, %d in, %d out", "fan_in", "fan_out")).when(F.col("role") == "orchestrator", F.format_string("orchestrator of %d", "fan_out"))
    counts = counts.when(F.col("role") == "isolated", "isolated").when(F.col("role").isNotNull(), F.format_string("%s, %d importers", "role", "fan_in"))
    return keys.join(roles.select("key", "role", "fan_in", "fan_out"), "key", "left").select("key", F.concat_ws("; ", base, counts).alias("description"))


#: Keywords of routes, and what such a route is for, in our words; the first that is there counts.
ROUTE_WORDS = (
    (("auth", "login", "session"), "signing in"), (("admin",), "administration"), (("user", "account", "profile"), "accounts"), (("search",), "search"), (("pay", "checkout", "billing"), "payments"),
    (("webhook",), "incoming events"), (("upload", "file"), "files"), (("health", "status"), "monitoring"), (("api",), "programmatic access"),
)


def route_purpose(route: Column) -> Column:
    return text.first_match(route, tuple((label, words) for words, label in ROUTE_WORDS), "a page")


#: Name, keywords in modules, in pages, in routes of an API, keywords of the listed modules, whether it is critical.
FLOWS = (
    ("Market Data Flow", ("stock", "market", "chart"), ("stock", "market"), ("price", "stock", "market"), ("stock", "market", "chart"), True),
    ("Authentication Flow", ("auth", "login", "session"), ("login", "signup", "auth"), ("auth", "login", "session"), ("auth", "login", "session"), True),
    ("Content Delivery Flow", ("article", "content", "newsletter", "blog"), ("article", "news", "blog"), (), ("article", "content", "newsletter"), False),
)


def inferred_flows(keys: DataFrame, pages: DataFrame, apis: DataFrame) -> DataFrame:
    """(name, critical, modules) of the flows that modules (key), pages (route) or an API's routes (route) speak of."""
    holds = lambda c, words: text.any_of([c.contains(w) for w in words]) if words else F.lit(False)
    k, hits = F.lower("key"), []
    for name, in_modules, in_pages, in_apis, listed, critical in FLOWS:
        head = [F.lit(name).alias("name"), F.lit(critical).alias("critical")]
        hits.append(keys.filter(holds(k, in_modules)).select(*head, F.when(holds(k, listed), F.col("key")).alias("module")))
        hits.append(pages.filter(holds(F.col("route"), in_pages)).select(*head, F.lit(None).cast("string")))
        # a route speaks for a flow even if no module does: its modules are listed all the same
        hits.append(apis.filter(holds(F.col("route"), in_apis)).select(*head, F.lit(None).cast("string")))
    every = hits[0]
    for x in hits[1:]:
        every = every.union(x)
    named = every.groupBy("name", "critical").agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"))
    served = apis.agg(F.count("*").alias("n")).filter("n > 0")
    return named.union(served.select(F.lit("API Integration Flow"), F.lit(False), F.format_string("%d endpoints", "n")))


def shared_libraries(keys: DataFrame, most: int = 5) -> DataFrame:
    """The first modules (ord, key) that by name are libraries or utilities."""
    k = F.lower("key")
    return keys.filter(k.contains("lib") | k.contains("util")).orderBy("ord", "key").limit(most)


def trimmed_context(context_json: Column, most: int = 12_000) -> Column:
    """JSON of a context that fits: beyond `most` characters its lists are cut (pages and APIs 15, domains 8, modules 10), then its end."""
    schema = "struct<project:string,domains:array<string>,topModules:array<string>,routes:struct<pages:array<string>,apis:array<string>>>"
    parsed = F.from_json(context_json, schema)
    part = lambda c, n: F.slice(c, 1, n)
    routes = F.struct(part(parsed["routes"]["pages"], 15).alias("pages"), part(parsed["routes"]["apis"], 15).alias("apis"))
    cut = F.to_json(F.struct(parsed["project"].alias("project"), part(parsed["domains"], 8).alias("domains"), part(parsed["topModules"], 10).alias("topModules"), routes.alias("routes")))
    return F.when(F.length(context_json) <= most, context_json).when(F.length(cut) <= most, cut).otherwise(F.concat(F.substring(cut, 1, most), F.lit("\n... (truncated)")))


def missing_fields(parsed: Column, required: list[str]) -> Column:
    """The first required field that a JSON object doesn't have, or null."""
    keys = F.coalesce(F.json_object_keys(parsed), F.array().cast("array<string>"))
    return F.get(F.filter(F.array(*map(F.lit, required)), lambda f: ~F.array_contains(keys, f)), F.lit(0))


def looks_secret(column: Column, bits: float = 4.5) -> Column:
    """Whether a text matches a known secret's shape, or is one word of 20 characters or more of high entropy."""
    word = column.rlike(r"^\S{20,}$")
    return F.coalesce(column.rlike(parsing.SECRETS) | (word & (parsing.entropy(column) > bits)), F.lit(False))


def without_secrets(column: Column) -> Column:
    return F.regexp_replace(column, parsing.SECRETS, "[REDACTED]")


def loggable_settings(settings: DataFrame) -> DataFrame:
    """Settings (STRUCT columns notion and ai) without tokens and keys, the workspace's id masked."""
    masked = F.when(F.col("notion.workspaceId").isNotNull(), F.concat(F.substring("notion.workspaceId", 1, 4), F.lit("***"), F.expr("right(notion.workspaceId, 4)")))
    return settings.withColumns({"notion": F.col("notion").dropFields("token").withField("workspaceId", masked), "ai": F.col("ai").dropFields("apiKey")})


def branch_title(title: Column, branch: Column, slug: Column) -> Column:
    return F.when(branch.isin("main", "master"), title).otherwise(F.concat(title, F.lit(" ["), slug, F.lit("]")))


def documents_for(plan: DataFrame, audience: str | None = None, generated: bool | None = None) -> DataFrame:
    """Documents of a plan for an audience (mixed ones are for all) and, if asked, those that may hold generated text."""
    if audience is not None:
        plan = plan.filter(F.col("audience").isin(audience, "mixed"))
    if generated is not None:
        may = F.col("generated").isin("yes", "hybrid")
        plan = plan.filter(may if generated else ~may)
    return plan


def bullet_list(values: Column) -> Column:
    """Values as bullets; nulls and blanks are left out, structs and lists stand as JSON."""
    return F.array_join(F.transform(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.concat(F.lit("- "), x)), "\n")
