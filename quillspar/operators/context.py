"""Facts put together: module-level edges, patterns, flows, verdicts, plans, look-ups in order of priority."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import rules, text
from quillspar.operators import graph


def module_edges(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, fan_in, fan_out) of modules with a node: edges (src, dst) that cross the module's boundary.

    A node lies in each module whose key is one of its own prefixes, so the prefix join is an equi-join.
    """
    folders = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), 1, i), "/"))
    keys = modules.select("key").distinct()
    sides = edges.select(folders("src").alias("s"), folders("dst").alias("d"))
    out = sides.select(F.explode(F.array_except("s", "d")).alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    ins = sides.select(F.explode(F.array_except("d", "s")).alias("key"), F.lit(1), F.lit(0))
    own = sides.select(F.explode(F.array_union("s", "d")).alias("key"), F.lit(0), F.lit(0))
    each = out.union(ins).union(own).join(keys, "key", "left_semi")
    return each.groupBy("key").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def patterns(modules: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """(pattern, verified): patterns that modules' keys show; verified is null where nothing is to be verified or measured.

    One pass of boolean aggregates over the modules and one over their measures, whatever the number of rules.
    """
    k = F.lower("key")
    words = sorted({w for _, alts in rules.PATTERNS for alt in alts for w in alt})
    found = modules.agg(*[F.coalesce(F.bool_or(k.contains(w)), F.lit(False)).alias(f"has {w}") for w in words])
    shown = lambda alts: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(f"`has {w}`") for w in alt]) for alt in alts])
    verified = {name: F.lit(None).cast("boolean") for name, _ in rules.PATTERNS}
    if measured is not None:
        checks = sorted({c for cs in rules.VERIFIED.values() for c in cs})
        seen = measured.agg(*[F.coalesce(F.bool_or(k.contains(w) & (F.col(f"fan_{d}") >= rules.LEAST_VERIFIED)), F.lit(False)).alias(f"{d} {w}") for d, w in checks])
        found = found.join(seen)  # one row each
        verified |= {name: reduce(lambda a, b: a | b, [F.col(f"`{d} {w}`") for d, w in cs]) for name, cs in rules.VERIFIED.items()}
    rows = F.array_compact(F.array(*[F.when(shown(alts), F.struct(F.lit(name).alias("pattern"), verified[name].alias("verified"))) for name, alts in rules.PATTERNS]))
    return found.select(F.explode(rows).alias("r")).select("r.pattern", "r.verified")


#: Fixed value: edges beyond which a graph without cycles counts as layered.
LEAST_EDGES = 10


def structural_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, n): `layered` with the number of distinct edges (src, dst) where none lies on a cycle, or `cyclic` with the number
    of strongly connected components that hold a cycle; no row for a small graph without cycles.
    """
    total = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    knots = graph.strong_components(edges).agg(F.count_distinct("root").alias("knots"))
    one = F.when(F.col("knots") > 0, F.struct(F.lit("cyclic").alias("pattern"), F.col("knots").alias("n"))).when(F.col("edges") > LEAST_EDGES, F.struct(F.lit("layered").alias("pattern"), F.col("edges").alias("n")))
    return total.join(knots).select(one.alias("one")).filter("one IS NOT NULL").select("one.*")  # one row each


def graph_verdicts() -> dict[str, Column]:
    """Verdicts over columns files, externals, cycles, orphans, top_hub (importers of the largest hub)."""
    return {
        "externals_verdict": F.when(F.col("externals") < 50, "manageable").when(F.col("externals") < 100, "audit").otherwise("high"),
        "cycles_verdict": F.when(F.col("cycles") == 0, "clean").otherwise("coupled"),
        "hub_verdict": F.when(F.col("top_hub") > F.col("files") * 0.3, "hotspot").otherwise("healthy"),
        "orphans_verdict": F.when(F.col("orphans") > F.col("files") * 0.1, "dead code").otherwise("connected"),
    }


def maturity(has_tests: Column, has_build: Column, clean: Column) -> Column:
    n = has_tests.cast("int") + has_build.cast("int") + clean.cast("int")
    return F.when(n >= 3, "production").when(n >= 2, "structured").otherwise("early")


def flow_size(steps: Column) -> Column:
    return F.when(steps > 5, "High").when(steps > 2, "Medium").otherwise("Low")


def graph_summary() -> Column:
    """The counts in words, absent parts skipped."""
    s = lambda c, t: F.concat(F.col(c).cast("string"), F.lit(t))
    return F.concat_ws(" · ", s("files", " files"), s("edges", " imports"), s("externals", " external packages"), F.when(F.col("cycles") > 0, s("cycles", " cycles")).otherwise("no cycles"), F.when(F.col("orphans") > 0, s("orphans", " orphans")))


def name_relations(nodes: DataFrame) -> DataFrame:
    """(src, dst, type) guessed from names (id, label) where no edges are known: each rule joins the few labels it names."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("label").alias("sl")), nodes.select(F.col("id").alias("dst"), F.col("label").alias("dl"))
    test = lambda c: F.col(c).startswith("tests/") | F.col(c).startswith("test/")
    pairs = a.join(F.broadcast(b.orderBy("dst").limit(30)), F.col("src") != F.col("dst"))  # the map shows 30 modules
    found = F.array_compact(F.array(
        F.when(((F.col("sl") == "bin") | F.col("sl").startswith("bin/")) & F.col("dl").startswith("src/"), "uses"),
        F.when(F.col("dl").startswith("src/core") & text.any_of([F.col("sl").startswith(f"src/{x}") for x in ("publishers", "renderers", "delivery")]), "depends-on"),
        F.when(F.col("dl").startswith("src/utils") & F.col("sl").startswith("src/") & (F.col("sl") != F.col("dl")), "uses"),
        F.when(test("sl") & ~test("dl"), "tests"),
    ))
    return pairs.select("src", "dst", F.explode(found).alias("type"))


def routes_of_modules(routes: DataFrame, modules: DataFrame) -> DataFrame:
    """Routes (route) with a segment-free mention of a module's last name; a handful of modules per domain."""
    tails = modules.select(F.lower(F.element_at(F.split("key", "/"), -1)).alias("tail")).distinct().orderBy("tail").limit(5)
    return routes.join(F.broadcast(tails), F.lower("route").contains(F.col("tail")), "left_semi")


def by_priority(wanted: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """wanted (key) with the value of the first source that has one, and which it was (0: none)."""
    out = wanted
    for i, source in enumerate(sources):
        out = out.join(source.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    found = F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))])
    which = reduce(lambda rest, i: F.when(F.col(f"_v{i}").isNotNull(), i + 1).otherwise(rest), range(len(sources) - 1, -1, -1), F.lit(0))
    return out.select(key, found.alias(value), which.alias("source"))


def hub_flows(measured: DataFrame, edges: DataFrame, hubs: int = 3, importers: int = 5, below: int = 3) -> DataFrame:
    """(name, importers, downstream, critical) of the nodes imported most; edges (src, dst)."""
    least = F.greatest(F.lit(3), F.floor(measured.agg(F.count("*")).scalar() * 0.05))
    top = measured.withColumn("least", least).filter("fan_in >= least").orderBy(F.desc("fan_in"), "key").limit(hubs)
    first = lambda c, n: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, n), ",")
    ins = edges.groupBy(F.col("dst").alias("key")).agg(first("src", importers).alias("importers"))
    outs = edges.groupBy(F.col("src").alias("key")).agg(first("dst", below).alias("downstream"))
    joined = F.broadcast(top).join(ins, "key", "left").join(outs, "key", "left")
    return joined.select(F.col("key").alias("name"), "importers", F.coalesce("downstream", F.lit("")).alias("downstream"), (F.col("fan_in") >= F.col("least") * 2).alias("critical"))


def new_flows(known: DataFrame, more: DataFrame) -> DataFrame:
    """known, and those of more (name) whose name is new in lower case."""
    names = known.select(F.lower("name").alias("_n")).distinct()
    return known.unionByName(more.withColumn("_n", F.lower("name")).join(names, "_n", "left_anti").drop("_n"))


def with_hub_flows(flows: DataFrame, hubs: DataFrame, least: int = 3) -> DataFrame:
    """flows (name, critical), and new ones of hubs where fewer than `least` flows are not about tests."""
    few = flows.filter(~F.lower("name").contains("test")).agg(F.count("*").alias("n")).filter(F.col("n") < least)
    return new_flows(flows, hubs.crossJoin(F.broadcast(few)).drop("n"))  # one row or none


def flow_dependencies(flows: DataFrame) -> DataFrame:
    """(name, external) a flow's name tells."""
    n = F.col("name")
    hits = F.array_compact(F.array(F.when(n.contains("Market") | n.contains("Stock"), "market data"), F.when(n.contains("Auth"), "authentication"), F.when(n.contains("Content"), "content management")))
    return flows.select("name", F.explode(hits).alias("external"))


def active_documents(plan: DataFrame, sections: list[str] | None = None, features: dict[str, bool] | None = None) -> DataFrame:
    if sections is not None:
        return plan.filter(F.col("key").isin(*sections))
    if features is not None:
        off = [k for k, on in features.items() if on is False and k not in rules.CORE_DOCUMENTS]
        return plan.filter(~F.col("key").isin(*off)) if off else plan
    return plan


def leaves(rows: DataFrame, key: str, column: str, depth: int = 20) -> DataFrame:
    """(key, path, value) of the string leaves of JSON, down to `depth` levels; what isn't JSON has none."""

    def walk(node: object, path: str, level: int) -> Iterator[tuple[str, str]]:
        if level > depth:
            return
        if isinstance(node, str):
            yield path, node
        elif isinstance(node, list):
            for i, x in enumerate(node):
                yield from walk(x, f"{path}[{i}]", level + 1)
        elif isinstance(node, dict):
            for k, x in node.items():
                yield from walk(x, f"{path}.{k}", level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    node = json.loads(raw or "null")
                except ValueError:
                    continue
                found += [(k, *x) for x in walk(node, "root", 0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.schema.field(0).type), *[pa.array([f[i] for f in found], pa.string()) for i in (1, 2)]], names=[key, "path", "value"])

    return rows.select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, path string, value string")


def truncated(column: Column, most: int = 12_000) -> Column:
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("\n... (truncated)"))).otherwise(column)


def age(ms: Column) -> Column:
    part = lambda unit, name: F.concat(text.half_up(ms / unit).cast("string"), F.lit(name))
    return F.when(ms < 60_000, part(1000, "s ago")).when(ms < 3_600_000, part(60_000, "m ago")).when(ms < 86_400_000, part(3_600_000, "h ago")).otherwise(part(86_400_000, "d ago"))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000))


def timings(rows: DataFrame) -> DataFrame:
    """(operation, ms) summed by operation, and the total of all rows."""
    each = rows.groupBy("operation").agg(F.sum("ms").alias("ms"))
    return each.union(rows.agg(F.sum("ms").alias("ms")).select(F.lit("total"), "ms"))


def legacy_patterns(content: Column, tool: str) -> Column:
    """What is outdated in a workflow file that runs `tool`, in a fixed order."""
    checks = (
        ("tools folder", content.rlike(rf"(?i)cd\s+tools/{tool}")),
        ("install without latest", content.rlike(rf"(?m)npm\s+(?:ci|install)(?:\s|$)(?!.*{tool}@)")),
        ("run without latest", content.rlike(rf"(?m)npx\s+{tool}\s+(?!@latest)")),
        ("no node setup", ~content.contains("actions/setup-node@")),
        ("no environment", ~content.contains("NOTION_TOKEN") & ~content.contains("env:")),
    )
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks]))


#: Section, kind of value it must hold, and whether it must be there.
SETTINGS = (("configVersion", "number", False), ("project", "object", True), ("scan", "object", True), ("publishers", "array", True), ("plugins", "array", False), ("domains", "object", False), ("module_roots", "array", False))


def settings_errors(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, error) of settings given as JSON: not JSON, a section missing, or of another kind."""
    kinds = {"number": "^(BIGINT|DOUBLE|DECIMAL)", "object": "^OBJECT", "array": "^ARRAY"}
    parsed = rows.select(key, F.try_parse_json(column).alias("v"))
    errors = [F.when(F.col("v").isNull(), "not JSON")]
    for name, kind, needed in SETTINGS:
        held = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        errors.append(F.when(F.col("v").isNotNull() & held.isNull() & F.lit(needed), f"{name} is missing").when(held.isNotNull() & ~held.rlike(kinds[kind]), f"{name} must be of kind {kind}"))
    return parsed.select(key, F.explode(F.array_compact(F.array(*errors))).alias("error"))
