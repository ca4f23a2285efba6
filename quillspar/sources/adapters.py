"""Views of the star-schema tables in the shapes that the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ("auth", "api", "components", "lib", "hooks", "store", "pages/api", "config", "core", "render", "publish", "tests", "app/shop", "plugin", "services", "misc")
NAMES = ("page", "route", "index", "doc", "view", "doc.test")
EXTENSIONS = (".js", ".ts", ".tsx", ".jsx", ".py", ".md", ".go")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: Sequence[str], by: str):
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(F.col("doc_id"), F.lit(len(values))).cast("int") + 1)


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """(ord, path[, content]): each document as a source file below its source, language and a folder."""
    path = F.concat_ws("/", "source", F.lit("src"), _pick(FOLDERS, "doc_id"), F.concat(F.lit("g"), F.pmod(F.floor(F.col("doc_id") / 16), F.lit(9)).cast("string")), F.concat(_pick(NAMES, "doc_id"), _pick(EXTENSIONS, "doc_id")))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), path.alias("path"), *[F.coalesce("text", F.lit("")).alias("content")] * content)


def _sql_pick(values: Sequence[str]) -> str:
    return f"([{', '.join(map(quoted, values))}])[doc_id % {len(values)} + 1]"


def quoted(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


FILES = f"(SELECT doc_id AS ord, source || '/src/' || {_sql_pick(FOLDERS)} || '/g' || CAST((doc_id // 16) % 9 AS VARCHAR) || '/' || {_sql_pick(NAMES)} || {_sql_pick(EXTENSIONS)} AS path, coalesce(text, '') AS content FROM documents)"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, path, content): each document as a source file whose facts follow from its id; its text is a comment at the end.

    File d imports the files d // 2, d // 3, ... of smaller ids, exports functions with counted decisions, and holds risky
    calls and documentation comments by turns.
    """
    d = F.col("doc_id")
    name = lambda x: F.concat(F.lit("m"), F.pmod(x, F.lit(20)).cast("string"), F.lit("/f"), x.cast("string"))
    imports = [F.when((F.pmod(d, F.lit(4)) > i) & (F.floor(d / (i + 2)) < d), F.concat(F.lit(f'import a{i} from "../'), name(F.floor(d / (i + 2))), F.lit('.js";'))) for i in range(3)]
    package = F.when(d % 2 == 0, F.concat(F.lit('import p from "pkg'), (d % 7).cast("string"), F.lit('/sub";')))
    doc = F.when(d % 10 == 1, "/**\n * Does it.\n * @param {number} a - the input\n * @deprecated use another\n */").when(d % 2 == 1, "/** Does it. */")
    ifs = lambda i: F.repeat(F.lit("  if (a > 1) { b(); }\n"), (d % 13 + i).cast("int"))
    functions = [F.when(d % 3 >= i, F.concat(F.lit(f"export function f{i}(a) {{\n"), ifs(i), F.lit("}"))) for i in range(3)]
    risky = [F.when(d % 5 == 0, "eval(x);"), F.when(d % 3 == 0, "run({ shell: true });"), F.when(d % 7 == 0, "const r = Math.random();")]
    text = F.concat(F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /")), F.lit(" */"))
    content = F.concat_ws("\n", *imports, package, doc, *functions, *risky, text)
    return read(spark, sf_dir, "documents").select(d.alias("ord"), F.concat(F.lit("src/"), name(d), F.lit(".js")).alias("path"), content.alias("content"))


#: What the files of `code` hold, told by their ids alone.
CODE = "(SELECT doc_id AS d, 'src/m' || (doc_id % 20) || '/f' || doc_id AS key, doc_id % 3 + 1 AS nf FROM documents)"
CODE_EDGES = f"(SELECT DISTINCT c.key AS src, t.key AS dst FROM {CODE} c, (VALUES (0), (1), (2)) AS v(i) JOIN {CODE} t ON t.d = c.d // (i + 2) WHERE c.d % 4 > i AND t.d < c.d)"
#: Lines before the functions of a file of `code`, and up to the end of its functions. A match of eval begins with the newline before it.
CODE_HEAD = "(d % 4 + CASE WHEN d % 2 = 0 THEN 1 WHEN d % 10 = 1 THEN 5 ELSE 1 END)"
CODE_BODY = f"({CODE_HEAD} + (d % 3 + 1) * (2 + d % 13) + (d % 3 + 1) * (d % 3) // 2)"
CODE_FINDINGS = f"""(SELECT d, key || '.js' AS path, id, category, severity, cwe, {CODE_BODY} + CASE WHEN k = 5 THEN 0 ELSE 1 END + CASE WHEN k <> 5 AND d % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k = 7 AND d % 3 = 0 THEN 1 ELSE 0 END AS line FROM {CODE}, (VALUES (5, 'eval-usage', 'Code Injection', 'high', 'CWE-95'), (3, 'shell-true', 'Command Injection', 'medium', 'CWE-78'),
  (7, 'math-random-security', 'Insecure Randomness', 'low', 'CWE-330')) AS v(k, id, category, severity, cwe) WHERE d % k = 0)"""

#: A finding's line with its neighbours: the file's last lines from the one before its last brace on, of which the finding's place is known.
CODE_SNIPPET = """trim(array_to_string(list_filter([CASE WHEN d % 13 + d % 3 > 0 THEN '  if (a > 1) { b(); }' ELSE 'export function f0(a) {' END, '}', CASE WHEN d % 5 = 0 THEN 'eval(x);' END, CASE WHEN d % 3 = 0 THEN 'run({ shell: true });' END,
  CASE WHEN d % 7 = 0 THEN 'const r = Math.random();' END], lambda x: x IS NOT NULL)[CASE id WHEN 'eval-usage' THEN 1 WHEN 'shell-true' THEN 2 + CAST(d % 5 = 0 AS INT) ELSE 2 + CAST(d % 5 = 0 AS INT) + CAST(d % 3 = 0 AS INT) END :
  CASE id WHEN 'eval-usage' THEN 3 WHEN 'shell-true' THEN 4 + CAST(d % 5 = 0 AS INT) ELSE 4 + CAST(d % 5 = 0 AS INT) + CAST(d % 3 = 0 AS INT) END], chr(10)))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each customer nation with the three supplier nations it orders most from, itself left out."""
    lines, orders = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers, suppliers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    flows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    counted = flows.filter("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return counted.withColumn("rank", rank).filter("rank <= 3").select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"), "n", "rank")


EDGES = """(SELECT 'n' || src AS src, 'n' || dst AS dst, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM (
    SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)) WHERE rank <= 3)"""


def values(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def sql_values(rows: Sequence[tuple], names: str) -> str:
    literal = lambda x: str(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else "[" + ", ".join(map(literal, x)) + "]" if isinstance(x, list) else quoted(x)
    listed = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {listed}) AS v({names}))"


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, path, content): documents as server routes, page routes, schemas and type declarations by turns, told by their ids.

    The document's text stands in a comment at the end.
    """
    d = F.col("doc_id")
    n = lambda x: x.cast("string")
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("* /")), F.lit("\n"), F.lit("\n// "))
    server = F.concat(F.lit('app.get("/r'), n(d % 7), F.lit("\", h);\napp.post('/r"), n(d % 7), F.lit("', h);\n\nrouter.route(\"/i"), n(d % 5), F.lit('").get(h).delete(h);\n'))
    pages = F.concat(F.lit('import { Route } from "react-router";\n<Route path="/h'), n(d % 9), F.lit('" />\n<Route exact path="*" />\n  path: "/o'), n(d % 4), F.lit('",\n'))
    schema = F.concat(F.lit("type T"), n(d), F.lit(" {\n  id: ID!\n  # note\n  f"), n(d % 3), F.lit("(a: Int): Int\n}\nenum E"), n(d), F.lit(" {\n  A\n  B\n}\nunion U"), n(d), F.lit(" = T"), n(d), F.lit(" | Other;\n"))
    types = F.concat(F.lit("export interface A"), n(d), F.lit(" extends B"), n(d), F.lit(" { x: string }\ninterface B"), n(d), F.lit(" {}\ntype C"), n(d), F.lit(" = A"), n(d), F.lit(" | Map<string, B"), n(d), F.lit(">;\nclass K"), n(d), F.lit(" implements A"), n(d), F.lit(" {}\n"))
    turn = d % 4
    ending = F.when(turn == 0, ".js").when(turn == 1, ".tsx").when(turn == 2, ".graphql").otherwise(".ts")
    content = F.concat(F.when(turn == 0, server).when(turn == 1, pages).when(turn == 2, schema).otherwise(types), F.lit("/* "), text, F.lit(" */"))
    return read(spark, sf_dir, "documents").select(d.alias("ord"), F.concat(F.lit("src/s"), n(d), ending).alias("path"), content.alias("content"))
