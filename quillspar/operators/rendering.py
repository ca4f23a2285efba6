"""Documents rendered from facts: sections of lines, each a table or list of the first facts in order, as rows of a DataFrame.

A document is (doc_key, section, line_no, text); `documents.collapsed` joins its lines. A section is left out where it has
no facts, and says how many facts there are where it shows only the first. Nothing is collected: a section's rows come from
a top-k of its facts, and its counts from scalar aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspar.session import write_table

#: Limits of the documents: fixed values.
ROUTES, EXPORTS, HEALTH_ROWS, CYCLES, MAP_MODULES, DIFF_ROUTES, DIFF_MODULES, PACKAGES, LARGEST, HUB_ROWS = 200, 30, 50, 20, 30, 25, 40, 20, 10, 5
TABLE = "table"


@dataclass
class Section:
    """Facts shown under a heading: `line` of the first `most` rows by `order`; `head` are the lines of a table's header."""

    title: str
    facts: DataFrame
    order: Sequence[Column | str]
    line: Column
    most: int | None = None
    head: Sequence[str] = ()

    def rows(self, key: str, number: int) -> DataFrame:
        n = self.facts.agg(F.count("*").alias("n"))
        ordered = self.facts.orderBy(*self.order)
        # ids grow along a sorted frame: lines are in order, though not numbered without gaps
        body = (ordered.limit(self.most) if self.most else ordered).select((F.monotonically_increasing_id() + 1).alias("line_no"), self.line.alias("text"))
        heads = n.filter("n > 0").select(F.posexplode(F.array(F.format_string(f"## {self.title} (%d)", "n"), *map(F.lit, self.head))).alias("i", "text"))
        heads = heads.select((F.col("i") - len(self.head) - 1).cast("long").alias("line_no"), "text")
        out = heads.union(body)
        if self.most:
            out = out.union(n.filter(F.col("n") > self.most).select(F.lit(1 << 62), F.format_string(f"> The first {self.most} of %d.", "n")))
        return out.select(F.lit(key).alias("doc_key"), F.lit(number).alias("section"), "line_no", "text")


def document(key: str, title: str, sections: Sequence[Section]) -> DataFrame:
    """All rows of a document: its title is section 0."""
    spark = sections[0].facts.sparkSession
    out = spark.range(1).select(F.lit(key).alias("doc_key"), F.lit(0).alias("section"), F.lit(0).cast("long").alias("line_no"), F.lit(f"# {title}").alias("text"))
    for number, section in enumerate(sections, 1):
        out = out.union(section.rows(key, number))
    return out


def cells(*columns: Column | str) -> Column:
    """A table's row."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))


def header(*names: str) -> tuple[str, str]:
    return f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"


def marked(column: str) -> Column:
    return F.concat(F.lit("`"), F.col(column), F.lit("`"))


def bullet(column: str) -> Column:
    return F.concat(F.lit("- "), marked(column))


def system_overview(modules: DataFrame, technologies: DataFrame, totals: DataFrame, packages: DataFrame) -> DataFrame:
    """From modules (key, file_count, description), technologies (kind, name), totals (ord, metric, n), packages (name, path, version)."""
    stack = technologies.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    count = modules.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("f")).filter("n > 0")
    size = F.when(F.col("n") > 50, "large").when(F.col("n") > 20, "medium-sized").otherwise("compact")
    return document("system_overview", "System overview", [
        Section("At a glance", totals.filter("n > 0"), ["ord"], cells("metric", "n"), None, header("Metric", "Value")),
        Section("Technology", stack, ["kind"], cells("kind", "names"), None, header("Kind", "Names")),
        Section("Architecture", count, ["n"], F.format_string("A %s repository of %d modules and %d files.", size, "n", "f")),
        Section("Largest modules", modules, [F.desc("file_count"), "key"], cells(marked("key"), "file_count", "description"), LARGEST, header("Module", "Files", "Description")),
        Section("Workspaces", packages, ["path"], cells("name", marked("path"), "version"), PACKAGES, header("Package", "Path", "Version")),
    ])


def api_surface(endpoints: DataFrame, services: DataFrame, exports: DataFrame) -> DataFrame:
    """From endpoints (methods, route, path), services (category, name, detected_in), exports (path, name, line, description, deprecated)."""
    documented = exports.filter("description IS NOT NULL")
    totals = exports.agg(F.count("*").alias("n"), F.count("description").alias("d")).filter("n > 0")
    percent = F.floor(F.col("d") * 100.0 / F.col("n") + 0.5)
    return document("api_surface", "API surface", [
        Section("Endpoints", endpoints, ["route", "methods", "path"], cells("methods", marked("route"), marked("path")), None, header("Methods", "Route", "File")),
        Section("External services", services, ["category", "name"], cells("category", "name", marked("detected_in")), None, header("Kind", "Service", "First seen in")),
        Section("Deprecated exports", exports.filter("deprecated IS NOT NULL"), ["path", "line", "name"], F.format_string("- `%s` in `%s`: %s", "name", "path", "deprecated")),
        Section("Documented exports", documented, ["path", "line", "name"], F.format_string("- `%s` in `%s`: %s", "name", "path", "description"), EXPORTS),
        Section("Documentation", totals, ["n"], F.format_string("%d exports, %d documented (%d%%).", "n", "d", percent)),
    ])


def route_map(pages: DataFrame, endpoints: DataFrame) -> DataFrame:
    """From pages (route, path) and endpoints (methods, route, path)."""
    return document("route_map", "Route map", [
        Section("Pages", pages, ["route", "path"], cells(marked("route"), marked("path")), ROUTES, header("Route", "File")),
        Section("Endpoints", endpoints, ["route", "path"], cells("methods", marked("route"), marked("path")), ROUTES, header("Methods", "Route", "File")),
    ])


def system_map(modules: DataFrame, relations: DataFrame) -> DataFrame:
    """From modules (key, file_count, category) and relations (src, dst, weight): the largest modules and what they depend on."""
    shown = modules.orderBy(F.desc("file_count"), "key").limit(MAP_MODULES)
    inside = relations.join(shown.select(F.col("key").alias("src")), "src", "left_semi").join(shown.select(F.col("key").alias("dst")), "dst", "left_semi")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    first = inside.withColumn("rank", rank).groupBy(F.col("src").alias("key")).agg(F.count("*").alias("all"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "dst")))).alias("deps"))
    names = F.array_join(F.transform("deps", lambda d: d["dst"]), ", ")
    tail = F.when(F.col("all") > 3, F.format_string(" and %d more", F.col("all") - 3)).otherwise("")
    drawn = shown.join(first, "key", "left").withColumn("to", F.coalesce(F.concat(F.lit(" -> "), names, tail), F.lit("")))
    heavy = lambda side: inside.groupBy(F.col(side).alias("key")).agg(F.sum("weight").alias("n"))
    return document("system_map", "System map", [
        Section("Modules", drawn, ["category", "key"], F.format_string("- %s: %s (%d)%s", "category", "key", "file_count", "to")),
        Section("Most depended on", heavy("dst"), [F.desc("n"), "key"], cells(marked("key"), "n"), HUB_ROWS, header("Module", "Imported by")),
        Section("Most dependent", heavy("src"), [F.desc("n"), "key"], cells(marked("key"), "n"), HUB_ROWS, header("Module", "Depends on")),
    ])


def architecture_diff(enriched: DataFrame) -> DataFrame:
    """From changes (status, file, route, noise, module) as `changes.enriched` gives them."""
    files = enriched.filter("NOT noise")
    by = lambda status: files.filter(F.col("status") == status).select("file")
    routes = lambda status: enriched.filter((F.col("status") == status) & F.col("route").isNotNull()).select("route", "file")
    impacted = files.select("module").filter("module IS NOT NULL").distinct()
    sections = [Section(f"{name} routes", routes(name.lower()), ["route", "file"], bullet("route"), DIFF_ROUTES) for name in ("Added", "Removed")]
    sections.append(Section("Impacted modules", impacted, ["module"], bullet("module"), DIFF_MODULES))
    sections += [Section(f"{name} files", by(name.lower()), ["file"], bullet("file"), DIFF_ROUTES) for name in ("Added", "Removed", "Modified")]
    return document("arch_diff", "Architecture diff", sections)


def graphql_schema(members: DataFrame, libraries: DataFrame, resolvers: DataFrame) -> DataFrame:
    """From members (path, kind, name, members), libraries (library) and resolvers (path)."""
    kinds = (("query", "Queries"), ("mutation", "Mutations"), ("subscription", "Subscriptions"), ("type", "Object types"), ("enum", "Enums"), ("input", "Inputs"), ("interface", "Interfaces"), ("union", "Unions"))
    sections = [Section("Libraries", libraries.distinct(), ["library"], F.concat(F.lit("- "), "library"))]
    sections.append(Section("Schema files", members.select("path").distinct(), ["path"], bullet("path")))
    sections += [Section(title, members.filter(F.col("kind") == kind), ["name"], cells(marked("name"), "members", marked("path")), None, header("Name", "Members", "File")) for kind, title in kinds]
    sections.append(Section("Resolver files", resolvers.distinct(), ["path"], bullet("path")))
    return document("graphql_schema", "GraphQL schema", sections)


def type_graph(declared: DataFrame, relations: DataFrame) -> DataFrame:
    """From declared (name, kind, path) and relations (src, dst, relation)."""
    to = relations.groupBy(F.col("src").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "relation", "dst"))), ", ").alias("to"))
    joined = declared.join(to, "name", "left")
    kinds = (("interface", "Interfaces"), ("class", "Classes"), ("alias", "Aliases"), ("enum", "Enums"))
    sections = [Section(title, joined.filter(F.col("kind") == kind), ["name", "path"], cells(marked("name"), "to", marked("path")), None, header("Name", "Relations", "File")) for kind, title in kinds]
    sections.append(Section("Relations", relations, ["src", "relation", "dst"], F.format_string("- %s %s %s", "src", "relation", "dst")))
    return document("type_graph", "Type graph", sections)


def dependency_graph(totals: DataFrame, hubs: DataFrame, cycles: DataFrame, packages: DataFrame) -> DataFrame:
    """From totals (ord, metric, n), hubs (key, fan_in), cycles (ord, cycle) and packages (package)."""
    return document("dependency_graph", "Dependency graph", [
        Section("Overview", totals, ["ord"], cells("metric", "n"), None, header("Metric", "Value")),
        Section("Hubs", hubs, [F.desc("fan_in"), "key"], cells(marked("key"), "fan_in"), None, header("Module", "Imported by")),
        Section("Cycles", cycles, ["ord"], F.concat(F.lit("- "), "cycle"), CYCLES),
        Section("External packages", packages, ["package"], cells(marked("package")), None, header("Package")),
    ])


def architecture_drift(drifts: DataFrame) -> DataFrame:
    """From drifts (category, type, severity, items)."""
    kinds = (("critical", "Critical changes"), ("warning", "Warnings"), ("info", "Informational"))
    return document("architecture_drift", "Architecture drift", [Section(title, drifts.filter(F.col("severity") == s), ["category", "type", "items"], F.format_string("- %s, %s: %s", "category", "type", "items")) for s, title in kinds])


def code_health(health: DataFrame, functions: DataFrame) -> DataFrame:
    """From health as `facts.code_health` gives it, and functions (path, name, line, complexity)."""
    health, functions, worst = write_table(health, "health"), write_table(functions, "functions"), ["score", "file"]  # sections read them again
    grades = health.groupBy("grade").agg(F.count("*").alias("n"))
    return document("code_health", "Code health", [
        Section("Grades", grades, ["grade"], cells("grade", "n"), None, header("Grade", "Files")),
        Section("Hotspots", health.filter("score < 60"), worst, cells(marked("file"), "score", "grade", "complexity", F.format_string("%d in, %d out", "fan_in", "fan_out"), "doc_percent", "findings"), 20, header("File", "Score", "Grade", "Complexity", "Coupling", "Documented", "Findings")),
        Section("Most complex functions", functions, [F.desc("complexity"), "path", "line", "name"], cells(marked("name"), marked("path"), "line", "complexity"), 15, header("Function", "File", "Line", "Complexity")),
        Section("Files by health", health, worst, cells(marked("file"), "score", "grade", "complexity", "fan_in", "fan_out"), HEALTH_ROWS, header("File", "Score", "Grade", "Complexity", "Importers", "Imports")),
    ])


def security_hotspots(findings: DataFrame, categories: Sequence[str]) -> DataFrame:
    """From findings (path, category, name, severity, cwe, line), a section for each category."""
    findings = write_table(findings, "findings")  # each section reads them again
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    counted = findings.groupBy("severity").agg(F.count("*").alias("n"))
    sections = [Section("Severities", counted, [rank], cells("severity", "n"), None, header("Severity", "Findings"))]
    sections += [Section(c, findings.filter(F.col("category") == c), ["path", "line", "name"], cells(marked("path"), "line", "name", "severity", "cwe"), None, header("File", "Line", "Pattern", "Severity", "CWE")) for c in categories]
    sections.append(Section("Affected files", findings.groupBy("path").agg(F.count("*").alias("n")), ["path"], F.format_string("- `%s`: %d", "path", "n")))
    return document("security_hotspots", "Security hotspots", sections)


def comment_body(enriched: DataFrame) -> DataFrame:
    """The comment on a change: counts, then the first ten routes of each kind and twelve modules."""
    files = enriched.filter("NOT noise")
    routes = lambda status: enriched.filter((F.col("status") == status) & F.col("route").isNotNull()).select("route")
    counted = files.groupBy("status").agg(F.count("*").alias("n"))
    impacted = files.select("module").filter("module IS NOT NULL").distinct()
    return document("comment", "Architecture summary", [
        Section("Files", counted, ["status"], F.format_string("**%s:** %d", "status", "n")),
        *[Section(f"{name} routes", routes(name.lower()), ["route"], bullet("route"), 10) for name in ("Added", "Removed")],
        Section("Impacted modules", impacted, ["module"], bullet("module"), 12),
    ])


def flow_narrative(flows: DataFrame) -> DataFrame:
    """From flows (name, critical, modules): critical ones first."""
    line = F.concat(F.lit("- "), "name", F.when(F.col("critical"), " (critical)").otherwise(""), F.lit(": "), F.coalesce(F.nullif("modules", F.lit("")), F.lit("no module")))
    return document("data_flows", "Data flows", [Section("Flows", flows, [F.desc("critical"), "name"], line)])


def domain_narrative(domains: DataFrame) -> DataFrame:
    """From domains (domain, modules, files): the largest first."""
    return document("business_domains", "Business domains", [Section("Domains", domains, [F.desc("files"), "domain"], F.format_string("- %s: %d modules, %d files", "domain", "modules", "files"))])


def executive_summary(totals: DataFrame, health: DataFrame, findings: DataFrame) -> DataFrame:
    """From totals (ord, metric, n) and the one-row summaries (summary) of health and findings."""
    health, findings = write_table(health.select("summary"), "health"), write_table(findings.select("summary"), "findings")  # a section reads its facts twice
    line = F.concat(F.lit("- "), "summary")
    return document("executive_summary", "Executive summary", [
        Section("Scale", totals, ["ord"], cells("metric", "n"), None, header("Metric", "Value")),
        Section("Health", health, ["summary"], line), Section("Security", findings, ["summary"], line),
    ])


def architecture_overview(modules: DataFrame, patterns: DataFrame) -> DataFrame:
    """From modules (key, role) and patterns (pattern)."""
    roles = modules.filter("role IS NOT NULL").groupBy("role").agg(F.array_join(F.slice(F.array_sort(F.collect_set("key")), 1, 15), ", ").alias("keys"))
    return document("architecture_overview", "Architecture overview", [
        Section("Patterns", patterns, ["pattern"], F.concat(F.lit("- "), "pattern")),
        Section("Roles", roles, ["role"], F.concat(F.lit("- "), "role", F.lit(": "), "keys")),
    ])


def developer_onboarding(modules: DataFrame, entries: DataFrame, technologies: DataFrame) -> DataFrame:
    """From modules (key, file_count, description), entries (key) and technologies (kind, name): where to begin."""
    return document("developer_onboarding", "Developer onboarding", [
        Section("Tools", technologies, ["kind", "name"], F.format_string("- %s: %s", "kind", "name")),
        Section("Start here", entries, ["key"], bullet("key"), 5),
        Section("Modules", modules, [F.desc("file_count"), "key"], F.format_string("- `%s` (%d): %s", "key", "file_count", "description"), 15),
    ])


def change_impact(enriched: DataFrame) -> DataFrame:
    """From changes (status, file, noise, module): modules by how many of their files changed."""
    counted = enriched.filter("NOT noise AND module IS NOT NULL").groupBy("module").agg(F.count("*").alias("n"), F.count_distinct("status").alias("kinds"))
    return document("change_impact", "Change impact", [Section("Modules", counted, [F.desc("n"), "module"], F.format_string("- `%s`: %d files, %d kinds of change", "module", "n", "kinds"), DIFF_MODULES)])


def sidebar(plan: DataFrame) -> DataFrame:
    """An index page: documents (key, audience) under their audiences."""
    groups = ("non-technical", "mixed", "technical")
    return document("sidebar", "Documents", [Section(g, plan.filter(F.col("audience") == g), ["key"], F.format_string("- [%s](%s.md)", F.replace("key", F.lit("_"), F.lit(" ")), "key")) for g in groups])
