"""Facts after any sequence of changes equal those of a full rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from quillspar.operators import parsing
from quillspar.streaming import rebuild

DDL = "path string, content string, deleted boolean, seq long"


def full(spark, files):
    """All tables from the files as they are."""
    df = spark.createDataFrame(sorted(files.items()), "path string, content string")
    out = rebuild.parse(df)
    edges = parsing.import_edges(df)
    ins, outs = edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("fan_in")), edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("fan_out"))
    return out | {"edges": edges.select("src", "dst"), "degrees": ins.join(outs, "key", "full").fillna(0)}


def same(live, spark, files):
    for name, want in full(spark, files).items():
        columns = want.columns
        assert sorted(map(tuple, live.table(name).select(columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name
    assert {r.path for r in live.table("files").collect()} == set(files)


PATHS = ["src/a.js", "src/b.ts", "src/b.js", "src/c/index.js", "src/c.js", "src/d.js", "docs/e.md", "src/f.test.js"]


def body(rng):
    lines = [f'import x from "{rng.choice(["./a", "./b", "./c", "./d.js", "../src/c/index", "react", "@s/p/q", "./missing", "./later"])}";' for _ in range(rng.randrange(4))]
    return "\n".join([*lines, *rng.choice([[], ["eval(x);"], ["/** Says. */", "export function f(a) { return a && 1; }"]])])


def test_any_sequence_of_changes_equals_a_full_rebuild(spark, tmp_path):
    rng = random.Random(1)
    live, files, seq = rebuild.LiveFacts(spark, str(tmp_path / "facts"), 4), {}, 0
    for batch in range(4):
        rows = []
        for _ in range(rng.randrange(1, 8)):
            path, seq = rng.choice([*PATHS, "src/later.ts"]), seq + 1
            gone = batch > 0 and rng.random() < 0.35
            rows.append((path, None if gone else body(rng), gone, seq))
            files.pop(path, None)
            if not gone:
                files[path] = rows[-1][1]
        rng.shuffle(rows)
        at = live.apply(spark.createDataFrame(rows, DDL), batch)
        assert at.meta["parsed"] <= len({r[0] for r in rows})
        again = live.apply(spark.createDataFrame([("src/a.js", "eval(1)", False, 0)], DDL), batch)
        assert again.version == at.version
    same(live, spark, files)


def test_a_file_that_comes_moves_the_edges_of_files_that_are_not_parsed(spark, tmp_path):
    live = rebuild.LiveFacts(spark, str(tmp_path / "facts"), 4)
    files = {f"src/u{i}.js": 'import x from "./hub";' for i in range(5)}
    live.apply(spark.createDataFrame([(p, c, False, 0) for p, c in files.items()], DDL), 0)
    assert live.table("edges").count() == 0
    at = live.apply(spark.createDataFrame([("src/hub.ts", "1", False, 1), ("src/u0.js", files["src/u0.js"], False, 2)], DDL), 1)
    assert at.meta["parsed"] == 1  # u0 came again with the content it has
    assert {(r.key, r.fan_in) for r in live.table("degrees").filter("fan_in > 0").collect()} == {("src/hub", 5)}
    same(live, spark, files | {"src/hub.ts": "1"})
    live.apply(spark.createDataFrame([("src/hub.ts", None, True, 3)], DDL), 2)
    same(live, spark, files)


def test_a_batch_that_fails_is_done_again(spark, tmp_path, monkeypatch):
    live = rebuild.LiveFacts(spark, str(tmp_path / "facts"), 4)
    live.apply(spark.createDataFrame([("src/a.js", "eval(1)", False, 0)], DDL), 0)
    later = spark.createDataFrame([("src/a.js", "2", False, 1)], DDL)
    with monkeypatch.context() as m:
        m.setattr(live.store, "_log", lambda s: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            live.apply(later, 1)
    same(live, spark, {"src/a.js": "eval(1)"})
    live.apply(later, 1)
    same(live, spark, {"src/a.js": "2"})


def test_a_stream_of_changes(spark, tmp_path):
    live = rebuild.LiveFacts(spark, str(tmp_path / "facts"), 4)
    put = lambda rows, n: spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = lambda: spark.readStream.schema(DDL).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    put([("src/a.js", 'import "./b";', False, 0), ("src/b.js", "", False, 1)], 1)
    live.follow(stream(), str(tmp_path / "check")).awaitTermination()
    put([("src/b.js", None, True, 2)], 2)
    live.follow(stream(), str(tmp_path / "check")).awaitTermination()
    same(live, spark, {"src/a.js": 'import "./b";'})
    version = live.store.snapshot().version
    live.follow(stream(), str(tmp_path / "check")).awaitTermination()  # nothing new
    assert live.store.snapshot().version == version == 2


def test_all_tables_of_a_batch_come_from_one_parse(spark):
    rows = [("src/a.js", 'import "./b"; eval("x");\n/** Says. */\nexport function f(a) { return a && 1; }'), ("src/b.test.js", 'import "./a"; eval("y"); export function g() {}'), ("src/app.config.js", "eval(1)"), ("docs/c.md", 'import "./a"'), ("src/n.js", None)]
    files, kept = spark.createDataFrame(rows, "path string, content string"), []
    out = rebuild.parse(files, lambda df, tag: kept.append(rebuild.write_table(df, tag)) or kept[-1])
    assert len(kept) == 1 and not any("MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString() for df in out.values())
    plain = {"imports": parsing.imports(files), "measures": parsing.measured(files.filter("path <> 'src/b.test.js'")), "findings": parsing.findings(files), "exports": parsing.exports(files)}
    for name, want in plain.items():
        assert out[name].columns == want.columns
        assert sorted(map(tuple, out[name].collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name
