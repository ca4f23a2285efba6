"""Boundaries and small cases of the operators."""

import pytest
from pyspark.sql import functions as F

from quillspar.functions import text
from quillspar.operators import baselines, changes, documents, facts, graph, modules, parsing, rendering
from quillspar.plans.plugins import Plugin, Registry
from quillspar.sources import repository
from quillspar.streaming import feeds


@pytest.mark.parametrize(
    ("field", "value", "score"),
    [("complexity", 10, 100), ("complexity", 11, 99), ("complexity", 30, 80), ("complexity", 31, 77), ("complexity", 99, 60), ("max_function", 8, 100), ("max_function", 9, 98), ("fan_in", 20, 100), ("fan_in", 25, 99), ("coverage", 0.49, 90), ("coverage", 0.5, 95), ("coverage", 0.8, 100), ("high", 11, 0), ("medium", 1, 95)],
)
def test_file_health_thresholds(spark, field, value, score):
    base = {"complexity": 1, "max_function": 1, "fan_in": 0, "fan_out": 1, "exports": 1, "coverage": 1.0, "high": 0, "medium": 0} | {field: value}
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in base.items()])
    assert row.select(modules.file_health()).first()[0] == score


@pytest.mark.parametrize(("score", "grade"), [(80, "A"), (79, "B"), (60, "B"), (59, "C"), (40, "C"), (39, "D"), (20, "D"), (19, "F")])
def test_grades(spark, score, grade):
    assert spark.range(1).select(modules.grade(F.lit(score))).first()[0] == grade


@pytest.mark.parametrize(
    ("importer", "specifier", "key"),
    [("src/a.js", "./b.js", "src/b"), ("src/a/b.js", "../c/index.ts", "src/c"), ("a.js", "../../x", "../../x"), ("a.js", "./b/./c", "b/c")],
)
def test_resolve(spark, importer, specifier, key):
    assert spark.range(1).select(text.resolve(F.lit(importer), F.lit(specifier))).first()[0] == key


@pytest.mark.parametrize(("code", "n"), [("x", 1), ("if (a) {} else if (b) {}", 3), ("a ?? b", 2), ("a?.b", 1), ('"if (a)"', 1), ("// if (a)\n", 1), ("/* for ( */ while (1) {}", 2), ("http://x && y", 2), ("'" + "x" * 100_000 + "' && y", 2)])
def test_complexity(code, n):
    assert parsing.complexity(code) == n


def test_matches_give_lines(spark):
    rows = spark.createDataFrame([("a\nx1\n\nx2 x3",)], "content string")
    assert [(r.n, r.hit, r.line) for r in parsing.matches(rows, "content", r"(x\d)").collect()] == [(0, "x1", 2), (1, "x2", 4), (2, "x3", 4)]


def test_many_matches_take_one_pass(spark):
    import time

    source = "x1 y\n" * 100_000
    rows = spark.createDataFrame([(7, source), (8, None)], "key int, content string")
    began = time.perf_counter()
    last = parsing.matches(rows, "content", r"(x\d)").agg(F.count("*").alias("n"), F.max("line").alias("line"), F.max("n").alias("at")).first()
    assert tuple(last) == (100_000, 100_000, 99_999) and time.perf_counter() - began < 30


def test_globs():
    import re

    ok = lambda g, p: bool(re.match(repository.glob_to_regex(g), p))
    assert ok("src/**/*.ts", "src/a.ts") and ok("src/**/*.ts", "src/a/b.ts") and not ok("src/*.ts", "src/a/b.ts") and ok("**/*.{js,ts}", "x/y.js")


def test_scan(spark, tmp_path):
    for name, body in {"src/a.js": "1", "src/b/c.ts": "2", "node_modules/x.js": "3"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = repository.scan(spark, str(tmp_path), ["**/*.js", "**/*.ts"], ["node_modules/**"])
    assert [(r.ord, r.path, r.content) for r in found.orderBy("ord").collect()] == [(1, "src/a.js", "1"), (2, "src/b/c.ts", "2")]
    free = repository.scan(spark, str(tmp_path), ["**/*.js", "**/*.ts"], ["node_modules/**"], most=None)
    assert [(r.ord, r.path) for r in free.orderBy("ord").collect()] == [(1, "src/a.js"), (2, "src/b/c.ts")]
    with pytest.raises(ValueError):
        repository.scan(spark, str(tmp_path), ["**/*.js", "**/*.ts"], [], most=1)


def test_bucket_refills_only_by_whole_windows():
    b = changes.Bucket(2, 1000)
    assert [b.take(t) for t in (0, 0, 0, 999, 1000, 1001, 1500, 2000)] == [True, True, False, False, True, True, False, True]


def test_publish_all_if_nothing_changed(spark):
    rows = spark.createDataFrame([(1, False), (2, False)], "key int, changed boolean")
    assert changes.publishable(rows).count() == 0 and changes.publishable(rows, all_if_none=True).count() == 2


def test_cycles_are_capped():
    nodes = [f"n{i}" for i in range(80)]
    assert len(graph.back_edges(nodes, {n: [n] for n in nodes})) == graph.MOST_CYCLES
    ring = {nodes[i]: [nodes[(i + 1) % 30]] for i in range(30)}
    assert graph.back_edges(nodes[:30], ring) == []


def test_table_is_split_with_its_header():
    table = "| h |\n|---|\n" + "\n".join(f"| {i} |" for i in range(150))
    found = documents.blocks(table)
    assert [c.split("\n")[0] for _, c in found] == ["h", "h"] and sum(len(c.split("\n")) - 1 for _, c in found) == 150
    assert len(documents.blocks("\n".join(["x"] * 200))) == documents.MOST_BLOCKS


def test_plugins():
    r = Registry()
    assert r.register(lambda: Plugin("a", renderers={"k": lambda d: 1}, hooks={"afterScan": lambda v: v + 1}))
    assert r.register(lambda: Plugin("b", renderers={"k": lambda d: 2}, hooks={"afterScan": lambda v: None}))
    assert r.register(lambda: Plugin("c", hooks={"afterScan": lambda v: 1 / 0}))
    assert not r.register(lambda: Plugin("d", hooks={"nope": print})) and not r.register(lambda: 1 / 0)
    assert r.renderers()["k"](None) == 2 and r.run("afterScan", 1) == 2


def test_streaming_rate_limit_matches_batch(spark, tmp_path):
    rows = [(u, i, i * 400) for u in (1, 2) for i in range(12)]
    calls = spark.createDataFrame(rows, "user_id long, event_id long, at_ms long")
    calls.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = feeds.rate_limited(stream, "user_id", 2, 1000).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.user_id, r.event_id)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, changes.rate_limited(calls, "user_id", 2, 1000).collect()))


def test_rate_limits_forget_idle_keys(spark, tmp_path):
    """State is gone a window after a key's last call; decisions are those of the batch twin, before and after."""
    triggers = [[(1, i, i * 100) for i in range(5)] + [(2, 9, 450)], [(2, 10, 5000)], [(2, 11, 5100), (2, 12, 5200)], [(1, 13, 6000), (1, 14, 6001), (1, 15, 6002), (2, 16, 6003)]]
    ddl = "user_id long, event_id long, at_ms long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    q = feeds.rate_limited(stream, "user_id", 2, 1000, "1 millisecond").writeStream.format("memory").queryName("forgetful").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    held = []
    for rows in triggers:
        spark.createDataFrame(rows, ddl).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "bucket").load()
        held.append({r[0][0] for r in state.select("key").collect()})
    q.stop()
    assert held[0] == {1, 2} and held[2] == {2} and held[3] == {1, 2}
    every = spark.createDataFrame([r for rows in triggers for r in rows], ddl)
    assert sorted(map(tuple, spark.table("forgetful").collect())) == sorted(map(tuple, changes.rate_limited(every, "user_id", 2, 1000).collect()))


def test_streaming_debounce(spark, tmp_path):
    spark.sql("SELECT 'r' AS root, timestamp_millis(m) AS ts, p AS path FROM VALUES (0, 'a'), (300, 'b'), (700, 'node_modules/x'), (900, 'c'), (100000, 'd') AS v(m, p)").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("root string, ts timestamp, path string").parquet(str(tmp_path / "in"))
    q = feeds.debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("bursts").collect()) == [1, 2]


def test_documents_are_written(spark, tmp_path):
    facts = spark.createDataFrame([("b", 2), ("a", 1)], "key string, n int")
    doc = documents.lines(facts, "d", "key", "T", F.concat("key", F.lit(":"), "n"))
    documents.write_documents(doc, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out" / "doc_key=d")).collect()] == ["# T", "a:1", "b:2"]


def test_baselines_are_kept_run_by_run(spark, tmp_path):
    root = str(tmp_path / "baselines")
    state = lambda keys: baselines.snapshot(spark.createDataFrame([(k, n) for k, n in keys.items()], "key string, file_count long"), sum(keys.values()), {})
    assert baselines.load(spark, root) is None
    assert baselines.run_over_run(spark, state({"a": 2, "b": 1}), root, 1) is None
    found = {(r.category, r.type, r.severity, r["items"]) for r in baselines.run_over_run(spark, state({"a": 5, "c": 1}), root, 2).collect()}
    assert found == {("modules", "added", "info", "c"), ("modules", "removed", "warning", "b"), ("modules", "size-change", "warning", "a: 2 to 5 files (+150%)"), ("scale", "file-count-change", "warning", "3 to 6 files (+100%)")}
    assert baselines.load(spark, root, 1).count() == 3 and baselines.load(spark, root, 7) is None
    (tmp_path / "baselines" / "run=9").mkdir()  # a run that never ended is no baseline
    assert baselines.load(spark, root).filter("item = 'c'").count() == 1


def test_document_sets_are_read_back(spark, tmp_path):
    facts = spark.createDataFrame([("b", 2), ("a", 1)], "key string, n int")
    section = rendering.Section("Keys", facts, ["key"], rendering.cells(rendering.marked("key"), "n"), 1, rendering.header("Key", "N"))
    doc = rendering.document("route_map", "Routes", [section, rendering.Section("None", facts.filter("n > 5"), ["key"], rendering.bullet("key"))])
    (row,) = documents.collapsed(doc).collect()
    assert row.content.split("\n") == ["# Routes", "## Keys (2)", "| Key | N |", "|---|---|", "| `a` | 1 |", "> The first 1 of 2."]
    documents.write_set(doc, {"context": facts}, str(tmp_path / "set"))
    assert documents.read_artifact(spark, str(tmp_path / "set"), "context", "key string, n int").count() == 2
    assert documents.read_artifact(spark, str(tmp_path / "set"), "missing", "key string").count() == 0
    documents.publish_markdown(doc, str(tmp_path / "md"))
    assert [p.name for p in (tmp_path / "md").glob("file=*")] == ["file=route_map.md"]


def test_metric_history_keeps_the_last(spark, tmp_path):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    for day in range(4):
        now = spark.createDataFrame([(f"2024-01-0{day + 1}", 50.0 + day)], "ts string, coverage double")
        kept = documents.append_metrics(spark, now, str(tmp_path / "history"), keep=3)
    assert [r.ts for r in kept.collect()] == ["2024-01-04", "2024-01-03", "2024-01-02"]
    seen = Observation("counts")
    documents.counted(spark.range(7), seen, rows=F.count("*")).collect()
    assert seen.get == {"rows": 7}


def test_health_counts_tests_as_importers_but_not_as_files(spark):
    rows = [("src/a.js", "export function f(x) { return x && 1; }"), ("src/a.test.js", 'import { f } from "./a";'), ("src/b.js", 'import { f } from "./a"; eval("x"); eval("y");')]
    out = {r.file: r for r in facts.code_health(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert set(out) == {"src/a.js", "src/b.js"} and (out["src/a.js"].fan_in, out["src/a.js"].fan_out, out["src/a.js"].doc_percent) == (2, 0, 0)
    assert (out["src/b.js"].findings, out["src/b.js"].high, out["src/b.js"].score, out["src/b.js"].doc_percent) == (2, 2, 80, None)


def test_facts_come_from_one_parse(spark, tmp_path):
    rows = [("src/a.js", "/** Does. */\nexport function f(x) { return x && 1; }\nexport function g() {}"), ("src/a.test.js", 'import { f } from "./a"; eval("x");'), ("src/n.md", 'import "./a"'), ("src/null.js", None), ("src/app.config.js", 'eval("x");'), ("src/b.ts", 'import "./a"; import "./a"; require("pkg"); eval("y");')]
    spark.createDataFrame(rows, "path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    facts_of = parsing.file_facts(files)
    plan = facts_of._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1 and "Exchange" not in plan
    got = {r.path: r for r in facts_of.collect()}
    assert len(got) == len(rows) and (got["src/a.js"].exports, got["src/a.js"].documented, got["src/b.ts"].findings, got["src/app.config.js"].findings) == (2, 1, 1, 0)
    assert not got["src/a.test.js"].analysed and got["src/a.test.js"].findings is None and got["src/n.md"].specifiers == [] and got["src/b.ts"].specifiers == ["./a", "pkg"]
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(parsing.fact_edges(facts_of).select("src", "dst")) == pairs(parsing.import_edges(files).select("src", "dst"))
    plan = facts.code_health(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "content" not in plan
    assert facts.code_health(files.limit(0)).count() == 0


def test_documentation_comments():
    doc = parsing.parse_doc("/**\n * Adds a\n * and b.\n * @param {number} a - the first\n *   of two\n * @arg [b] x\n * @returns sum\n * @throws {E} if odd\n * @exception other\n * @example\n * add(1)\n * @deprecated\n * @see other @here\n * @since 1.2\n */")
    assert doc["description"] == "Adds a and b." and [p["description"] for p in doc["params"]] == ["the first of two", "x"] and doc["params"][1]["optional"]
    assert doc["returns"] == {"type": "void", "description": "sum"} and doc["throws"] == ["{E} if odd", "other"] and doc["examples"] == ["add(1)"]
    assert doc["deprecated"] == parsing.NO_REASON and doc["see"] == ["other @here"] and doc["since"] == "1.2"


def test_long_comments_are_not_searched_space_by_space():
    import random
    import re

    from quillspar.functions import rules

    rng, parts = random.Random(3), ["/*", "*/", "//", ":", "\n", " ", "\t", "function ", "async ", "export ", "f(", "const x = a =>", "if (", "? ", "&&", "'", '"', "`", "\\", "eval(", "x" * 20, 'token = "', "SELECT ", "+ a"]
    stripped = lambda s: re.sub(r"(?<!:)//.*$", "", re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), s, flags=re.S), flags=re.M)
    for _ in range(2000):
        source = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        whole, short = parsing.strip_comments(source), parsing.strip_comments(source, parsing.WIDE)
        assert whole == stripped(source) and short.count("\n") == whole.count("\n")
        for _, _, _, _, pattern in rules.SECURITY:
            at = [[parsing.line_of(t)(m.start()) for m in re.finditer(pattern, t, re.A | re.M)] for t in (whole, short)]
            assert at[0] == at[1], source
        found = [(m.start(), m[1]) for m in re.finditer(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", source, re.A)]
        assert [(source.count("\n", 0, a) + 1, n) for a, n in found] == [(line, n) for n, line, _ in parsing.functions_of(source) if n != "x"]
    assert len(parsing.strip_comments("/*" + "a" * 1000 + "\n" + "b" * 1000 + "*/", parsing.WIDE)) == 2 * parsing.WIDE + 1


@pytest.mark.parametrize("name", ["summary_document", "health_document"])
def test_a_document_is_rendered_from_one_parse(spark, monkeypatch, name):
    from quillspar.operators import rendering
    from quillspar.plans import catalogue
    from quillspar.plans import rendering as plans

    seen = []
    for module in (facts, rendering, plans):
        write = module.write_table
        monkeypatch.setattr(module, "write_table", lambda df, tag, write=write: [seen.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, tag)][1])
    out = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    seen.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum("eval(x);" in p for p in seen) == 1  # plans that build the files' content
