"""Facts read from source text: routes, imports, exports, functions, findings, schemas and types.

Patterns with alternations over characters are written with possessive quantifiers, so that long literals don't exhaust
the JVM's stack. Matches with their places come from one pass over a text, by Arrow batches.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspar.functions import rules, text
from quillspar.operators import lexing

QUOTED = r"['\"`]([^'\"`]+)['\"`]"
IMPORTS = (
    r"import\s+(?:[\w*{},\s]+\s+from\s+)?['\"]([^'\"]+)['\"]",
    r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"export\s+(?:[\w*{},\s]+\s+from\s+)?['\"]([^'\"]+)['\"]",
)


#: Matches of a batch on their way to the JVM.
MATCHES = 8192


def matches(df: DataFrame, content: str, pattern: str, group: int = 1) -> DataFrame:
    """A row for each match of `pattern` (leftmost, not overlapping): df's other columns, n from 0, hit, and its 1-based line.

    One pass over a text, whose newlines are counted from match to match; the text itself isn't carried along.
    """
    rest = [c for c in df.columns if c != content]
    schema = StructType([df.schema[c] for c in rest]).add("n", "integer").add("hit", "string").add("line", "integer")
    compiled = re.compile(pattern, re.A)

    def batch_of(batch: pa.RecordBatch, found: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
        row, n, hit, line = zip(*found, strict=True)
        columns = [batch.column(c).take(pa.array(row, pa.int64())) for c in rest]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(hit, pa.string()), pa.array(line, pa.int32())], names=[*rest, "n", "hit", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, str, int]] = []
            for row, source in enumerate(batch.column(content).to_pylist()):
                at, line = 0, 1
                for n, m in enumerate(compiled.finditer(source or "")):
                    line += source.count("\n", at, m.start())
                    at = m.start()
                    found.append((row, n, m[group] or "", line))
                    if len(found) == MATCHES:
                        yield batch_of(batch, found)
                        found = []
            if found:
                yield batch_of(batch, found)

    return df.select(*rest, content).mapInArrow(run, schema)


def line_of(source: str) -> Callable[[int], int]:
    """The 1-based line of a position, from one look at the text's newlines."""
    breaks = [m.start() for m in re.finditer("\n", source)]
    return lambda at: bisect.bisect_left(breaks, at) + 1


#: Spaces that a line of a comment leaves at most where only matches and their lines count: more than any rule asks for.
WIDE = 16


def strip_comments(source: str, most: int | None = None) -> str:
    """Block comments become spaces, newlines kept; line comments go unless a colon stands before them.

    With `most`, a line of a block comment leaves at most so many spaces.
    """
    parts, at = [], 0
    while (a := source.find("/*", at)) >= 0 and (b := source.find("*/", a + 2)) >= 0:
        lines = source[a : b + 2].split("\n")
        parts += [source[at:a], "\n".join([" " * (len(x) if most is None else min(len(x), most)) for x in lines])]
        at = b + 2
    plain = "".join([*parts, source[at:]]) if parts else source
    return re.sub(r"(?<!:)//.*$", "", plain, flags=re.M) if "//" in plain else plain


_BLANKS = ((r"`[^`]*`", '""'), (r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""'), (r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", "''"))
_DECISIONS = (r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bcase\s+", r"\bcatch\s*\(", r"(?<!\?)\?\s*(?![.?])", r"&&", r"\|\|", r"\?\?")


def complexity(source: str, exact: bool = False) -> int:
    """Cyclomatic complexity: 1 and one for each decision outside comments and literals; else-if counts once.

    Comments are told first and literals after them, so marks of comments in literals count as comments; with `exact`
    one automaton tells both.
    """
    plain = lexing.code_of(source) if exact else strip_comments(source, WIDE)
    for pattern, to in _BLANKS if not exact else ():
        plain = re.sub(pattern, to, plain)
    return 1 + sum(len(re.findall(p, plain, re.A)) for p in _DECISIONS)


_FUNCTION = re.compile(r"function\s+(\w+)\s*\(", re.A)
_ARROW = re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>", re.A)


def _before(source: str, at: int, word: str) -> int:
    """Where `word` begins if it and white space stand right before a place, else the place."""
    end = at
    while end and source[end - 1] in " \t\n\r\f\v":
        end -= 1
    return end - len(word) if end < at and source.endswith(word, 0, end) else at


def functions_of(source: str, exact: bool = False) -> list[tuple[str, int, int]]:
    """(name, line, complexity) of each function; a body runs to the next function or the end."""
    found = [(_before(source, _before(source, m.start(), "async"), "export"), 0, m[1]) for m in _FUNCTION.finditer(source)]
    found += [(m.start(), 1, m[1]) for m in (_ARROW.finditer(source) if "=>" in source else ())]
    found.sort(key=lambda x: x[:2])
    ends = [x[0] for x in found[1:]] + [len(source)] * bool(found)
    line = line_of(source)
    return [(name, line(a), complexity(source[a:b], exact)) for (a, _, name), b in zip(found, ends, strict=True)]


def _per_row(df: DataFrame, function, ddl: str, names: list[str] | None = None) -> DataFrame:
    """Rows (path, *function(content)), by Arrow batches; `names` are needed where types hold commas."""
    names = ["path", *(names or [c.split()[0] for c in ddl.split(",")])]
    schema = to_arrow_schema(StructType.fromDDL(f"path string, {ddl}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in function(c or "")]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return df.select("path", "content").mapInArrow(run, f"path string, {ddl}")


def measured(files: DataFrame, exact: bool = False) -> DataFrame:
    """(path, complexity, lines, functions, max_function) of each file."""

    def one(source: str) -> list[tuple]:
        each = functions_of(source, exact)
        return [(complexity(source, exact), source.count("\n") + 1, len(each), max((c for *_, c in each), default=0))]

    return _per_row(files, one, "complexity long, lines long, functions long, max_function long")


def functions(files: DataFrame) -> DataFrame:
    return _per_row(files, functions_of, "name string, line long, complexity long")


def findings(files: DataFrame) -> DataFrame:
    """(path, id, severity, cwe, line) of each match of a security rule, comments left out."""
    compiled = [(i, s, c, re.compile(p, re.A | re.M)) for i, _, s, c, p in rules.SECURITY]

    def one(source: str) -> list[tuple]:
        plain = strip_comments(source, WIDE)
        line = line_of(plain)
        return [(i, s, c, line(m.start())) for i, s, c, p in compiled for m in p.finditer(plain)]

    return _per_row(files.filter(~F.col("path").rlike(rules.SKIPPED + "|" + rules.CONFIG_FILE)), one, "id string, severity string, cwe string, line long")


def imports(files: DataFrame) -> DataFrame:
    """(path, specifier, target, package): distinct imports of code files; target for relative ones, package for others."""
    found = files.filter(text.extension(F.col("path")).isin(*rules.CODE_EXTENSIONS))
    every = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in IMPORTS]))
    return resolved(found.select("path", F.explode(every).alias("specifier")))


def resolved(each: DataFrame) -> DataFrame:
    """(path, specifier) with the target of relative specifiers and the package of others."""
    s = F.col("specifier")
    relative = s.startswith("./") | s.startswith("../")
    return each.withColumns({"target": F.when(relative, text.resolve(F.col("path"), s)), "package": F.when(~relative & ~s.startswith("node:"), text.package_name(s))})


#: What one parse tells of a file, counted.
FACTS = "path string, analysed boolean, complexity long, lines long, functions long, max_function long, exports long, documented long, findings long, high long, medium long, specifiers array<string>"


def file_facts(files: DataFrame, each_function: bool = False) -> DataFrame:
    """One row for each file (path, content), all from one parse: its measures, counts of exports and findings, and its imports.

    Skipped files (tests and the like) are not `analysed`: only their imports are read, the counts are null. Files of settings
    have no findings. Null content is empty. Rows that repeat a path stay as they are. With `each_function` a last column, `each`,
    lists the functions of every file, skipped ones included.
    """
    p = F.col("path")
    flagged = files.select(
        "path", "content", F.coalesce(~p.rlike(rules.SKIPPED), F.lit(False)).alias("analysed"), F.coalesce(~p.rlike(rules.CONFIG_FILE), F.lit(False)).alias("checked"),
        F.coalesce(text.extension(p).isin(*rules.CODE_EXTENSIONS), F.lit(False)).alias("code"),
    )
    severities = [(s, re.compile(pattern, re.A | re.M)) for _, _, s, _, pattern in rules.SECURITY]
    importing = [re.compile(x, re.A) for x in IMPORTS]
    ddl = FACTS + (", each array<struct<name:string,line:long,complexity:long>>" if each_function else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def one(path: str, source: str, analysed: bool, checked: bool, code: bool) -> tuple:
        specifiers = list(dict.fromkeys(m[1] for x in importing for m in x.finditer(source))) if code else []
        each = functions_of(source) if analysed or each_function else []
        listed = [each] if each_function else []
        if not analysed:
            return (path, False, *[None] * 9, specifiers, *listed)
        exported = [doc for *_, doc in _exported(source)]
        plain = strip_comments(source, WIDE) if checked else ""
        found = [s for s, pattern in severities for _ in pattern.finditer(plain)]
        return (
            path, True, complexity(source), source.count("\n") + 1, len(each), max((c for *_, c in each), default=0),
            len(exported), sum(d is not None for d in exported), len(found), found.count("high"), found.count("medium"), specifiers, *listed,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "content", "analysed", "checked", "code")]
            rows = [one(path, source or "", *flags) for path, source, *flags in zip(*columns, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return flagged.mapInArrow(run, ddl)


#: What one parse tells of a file, listed.
PARSED = (
    "path string, analysed boolean, specifiers array<string>, measures struct<complexity:long,lines:long,functions:long,max_function:long>, findings array<struct<id:string,severity:string,cwe:string,line:long>>, "
    "exports array<struct<name:string,kind:string,line:long,description:string,params:string,returns:string,deprecated:string>>"
)


def parsed(files: DataFrame) -> DataFrame:
    """One row for each file (path, content) with what `imports`, `measured`, `findings` and `exports` tell of it, all from one parse.

    Skipped files have no measures and no findings, files of settings no findings.
    """
    p = F.col("path")
    flagged = files.select(
        "path", "content", F.coalesce(~p.rlike(rules.SKIPPED), F.lit(False)).alias("analysed"), F.coalesce(~p.rlike(rules.CONFIG_FILE), F.lit(False)).alias("checked"),
        F.coalesce(text.extension(p).isin(*rules.CODE_EXTENSIONS), F.lit(False)).alias("code"),
    )
    compiled = [(i, s, c, re.compile(x, re.A | re.M)) for i, _, s, c, x in rules.SECURITY]
    importing = [re.compile(x, re.A) for x in IMPORTS]
    schema = to_arrow_schema(StructType.fromDDL(PARSED))
    measures, finding, export = schema.field("measures").type.names, schema.field("findings").type.value_type.names, schema.field("exports").type.value_type.names

    def one(path: str, source: str, analysed: bool, checked: bool, code: bool) -> tuple:
        specifiers = list(dict.fromkeys(m[1] for x in importing for m in x.finditer(source))) if code else []
        exported = [dict(zip(export, r, strict=True)) for r in exports_of(source)]
        if not analysed:
            return path, False, specifiers, None, [], exported
        each = functions_of(source)
        counted = (complexity(source), source.count("\n") + 1, len(each), max((c for *_, c in each), default=0))
        found = []
        if checked:
            plain = strip_comments(source, WIDE)
            line = line_of(plain)
            found = [dict(zip(finding, (i, s, c, line(m.start())), strict=True)) for i, s, c, x in compiled for m in x.finditer(plain)]
        return path, True, specifiers, dict(zip(measures, counted, strict=True)), found, exported

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "content", "analysed", "checked", "code")]
            rows = [one(path, source or "", *flags) for path, source, *flags in zip(*columns, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return flagged.mapInArrow(run, PARSED)


def fact_edges(known: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between the keys of code files, from `file_facts`."""
    p = F.col("path")
    keys = known.filter(text.extension(p).isin(*rules.CODE_EXTENSIONS)).select(text.file_key(p).alias("dst")).distinct()
    found = resolved(known.select("path", F.explode("specifiers").alias("specifier"))).filter("target IS NOT NULL")
    return found.select(text.file_key(p).alias("src"), F.col("target").alias("dst")).distinct().join(keys, "dst", "left_semi")


def import_edges(files: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between known files' keys."""
    keys = files.filter(text.extension(F.col("path")).isin(*rules.CODE_EXTENSIONS)).select(text.file_key(F.col("path")).alias("dst")).distinct()
    found = imports(files).filter("target IS NOT NULL").select(text.file_key(F.col("path")).alias("src"), F.col("target").alias("dst"))
    return found.distinct().join(keys, "dst", "left_semi")


def external_packages(files: DataFrame) -> DataFrame:
    return imports(files).select("package").filter("package IS NOT NULL").distinct()


def express_routes(files: DataFrame) -> DataFrame:
    """(path, route, methods): app and router calls by route, methods in the order first seen."""
    from_calls = matches(files, "content", rf"(?i:(?:app|router)\.((?:get|post|put|patch|delete|all)\s*\(\s*{QUOTED.replace('(', '(?:', 1)}))", 1)
    method, route = F.upper(F.regexp_extract("hit", r"^(\w+)", 1)), F.regexp_extract("hit", QUOTED, 1)
    calls = from_calls.select("path", route.alias("route"), method.alias("method"), F.col("n").cast("long").alias("at"))
    chains = matches(files, "content", r"(?i:(?:app|router)\.route\s*\((\s*['\"`][^'\"`]+['\"`]\s*\)[.\s\w()]*))", 1)
    verbs = F.filter(F.array(*map(F.lit, rules.HTTP_VERBS)), lambda v: F.col("hit").contains(F.concat(F.lit("."), F.lower(v), F.lit("("))))
    chained = chains.select("path", F.regexp_extract("hit", QUOTED, 1).alias("route"), F.posexplode(verbs).alias("k", "method"), F.col("n")).select("path", "route", "method", (F.lit(1 << 20) + F.col("n") * 8 + F.col("k")).alias("at"))
    each = calls.union(chained).groupBy("path", "route", "method").agg(F.min("at").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "method"))), lambda x: x["method"])
    return each.groupBy("path", "route").agg(F.array_join(ordered, ",").alias("methods"), F.min("at").alias("first")).drop("first")


def next_methods(content: Column) -> Column:
    found = F.filter(F.array(*map(F.lit, rules.HTTP_VERBS)), lambda v: content.contains(F.concat(F.lit("export async function "), v)))
    return F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("UNKNOWN")


def object_routes(files: DataFrame) -> DataFrame:
    """(path, route, line): the first path property of each line that isn't a comment, first of a route only."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    bare = F.trim(F.regexp_replace("line", r"\r$", ""))
    lines = lines.filter(~(bare.startswith("//") | bare.startswith("*") | bare.startswith("/*")))
    found = lines.withColumn("route", F.regexp_extract(bare, rf"(?i)path\s*:\s*{QUOTED}", 1)).filter(text.valid_route(F.col("route")))
    return found.groupBy("path", "route").agg((F.min("n") + 1).alias("line"))


def jsx_routes(files: DataFrame) -> DataFrame:
    """(path, route, n): path attributes of Route elements, repeats kept."""
    found = matches(files, "content", rf"(?i:<Route\s+[^>]*path\s*=\s*{QUOTED}[^>]*/?>)", 1)
    return found.filter(text.valid_route(F.col("hit"))).select("path", F.col("hit").alias("route"), F.col("n").cast("long").alias("n"))


def react_files(content: Column) -> Column:
    return content.rlike(r"import\s+.*?from\s+['\"]react-router") | content.rlike(r"require\s*\(\s*['\"]react-router") | content.rlike(r"<Route\s") | content.rlike(r"createBrowserRouter\s*\(") | content.rlike(r"createRoutesFromElements\s*\(")


def vue_files(content: Column) -> Column:
    imported = content.rlike(r"import\s+.*?from\s+['\"]vue-router") | content.rlike(r"require\s*\(\s*['\"]vue-router")
    return imported | content.rlike(r"new\s+VueRouter\s*\(") | (content.rlike(r"createRouter\s*\(") & imported)


def express_files(content: Column) -> Column:
    return content.rlike(rf"(?i)(?:app|router)\.(get|post|put|patch|delete|all)\s*\(\s*{QUOTED}") | content.rlike(rf"(?i)(?:app|router)\.route\s*\(\s*{QUOTED}")


def page_sources(files: DataFrame) -> DataFrame:
    """(path, route, framework): pages of all frameworks, one source after the other."""
    p, c = F.col("path"), F.col("content")
    own = files.filter(text.is_page(p)).select("path", text.route_path(p).alias("route"), F.lit("Next.js").alias("framework"))
    react = files.filter((p.endswith(".tsx") | p.endswith(".jsx")) & react_files(c))
    jsx = jsx_routes(react).select("path", "route")
    objects = object_routes(react).select("path", "route").join(jsx, ["path", "route"], "left_anti")
    vue = object_routes(files.filter((p.endswith(".ts") | p.endswith(".js") | p.endswith(".vue")) & vue_files(c))).select("path", "route")
    return own.union(jsx.union(objects).withColumn("framework", F.lit("React Router"))).union(vue.withColumn("framework", F.lit("Vue Router")))


def external_services(files: DataFrame) -> DataFrame:
    """(name, category, detected_in): for each service the first JavaScript or TypeScript file, in order, that shows it."""
    p = F.col("path")
    code = files.filter(text.any_of([p.endswith(f".{e}") for e in ("js", "ts", "jsx", "tsx")]))
    shown = F.array_compact(F.array(*[F.when(F.col("content").rlike("|".join(patterns)), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"))) for n, c, patterns in rules.SERVICES]))
    return code.select("ord", "path", F.explode(shown).alias("s")).groupBy("s.name", "s.category").agg(F.min_by("path", "ord").alias("detected_in"))


_FIELD = r"^(\w+)\s*(?:\([^)]*\))?\s*:\s*(.+)"


def schema_members(files: DataFrame) -> DataFrame:
    """(path, kind, name, member): declarations of a GraphQL schema and their fields, values or members; first of a name."""
    blocks = []
    for kind, pattern in (("type", r"\btype\s+(\w+(?:\s+implements\s+[\w&\s]+)?\s*\{[^}]*)\}"), ("input", r"\binput\s+(\w+\s*\{[^}]*)\}"), ("enum", r"\benum\s+(\w+\s*\{[^}]*)\}"), ("interface", r"\binterface\s+(\w+\s*\{[^}]*)\}")):
        found = matches(files, "content", pattern).select("ord", "path", "n", F.regexp_extract("hit", r"^(\w+)", 1).alias("name"), F.split(F.regexp_extract("hit", r"(?s)\{(.*)$", 1), "\n").alias("lines"))
        lines = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
        if kind != "enum":
            lines = F.transform(F.filter(lines, lambda x: x.rlike(_FIELD)), lambda x: F.regexp_extract(x, _FIELD, 1))
        root = F.col("name").isin("Query", "Mutation", "Subscription")
        blocks.append(found.select("ord", "path", "n", F.when(root & F.lit(kind == "type"), F.lower("name")).otherwise(kind).alias("kind"), "name", lines.alias("members")))
    union = matches(files, "content", r"\bunion\s+(\w+\s*=\s*[^;\n]+)").select("ord", "path", "n", F.lit("union").alias("kind"), F.regexp_extract("hit", r"^(\w+)", 1).alias("name"), F.transform(F.split(F.regexp_extract("hit", r"=\s*(.*)$", 1), r"\|"), lambda x: F.trim(x)).alias("members"))
    blocks.append(union)
    for kind, pattern in (("scalar", r"\bscalar\s+(\w+)"), ("directive", r"\bdirective\s+@(\w+)")):
        blocks.append(matches(files, "content", pattern).select("ord", "path", "n", F.lit(kind).alias("kind"), F.col("hit").alias("name"), F.array().cast("array<string>").alias("members")))
    every = blocks[0]
    for b in blocks[1:]:
        every = every.union(b)
    first = F.row_number().over(Window.partitionBy("kind", "name").orderBy("ord", "n"))
    return every.withColumn("first", first).filter("first = 1").select("path", "kind", "name", F.array_join("members", ",").alias("members"))


def schema_fields(files: DataFrame) -> DataFrame:
    """(path, kind, name, field, type) of a GraphQL schema's types, inputs and interfaces, arguments and comments left out."""
    fields = None
    for kind in ("type", "input", "interface"):
        found = matches(files, "content", rf"\b{kind}\s+(\w+[^{{]*\{{[^}}]*)\}}").select("ord", "path", "n", F.regexp_extract("hit", r"^(\w+)", 1).alias("name"), F.split(F.regexp_extract("hit", r"(?s)\{(.*)$", 1), "\n").alias("lines"))
        root = F.col("name").isin("Query", "Mutation", "Subscription") & F.lit(kind == "type")
        rows = found.select("ord", "path", "n", F.when(root, F.lower("name")).otherwise(kind).alias("kind"), "name", F.transform("lines", lambda x: F.trim(F.regexp_replace(x, r"#.*$", ""))).alias("lines"))
        fields = rows if fields is None else fields.union(rows)
    first = F.row_number().over(Window.partitionBy("kind", "name").orderBy("ord", "n"))
    lines = fields.withColumn("first", first).filter("first = 1").select("path", "kind", "name", F.explode("lines").alias("line")).filter(F.col("line").rlike(_FIELD))
    return lines.select("path", "kind", "name", F.regexp_extract("line", _FIELD, 1).alias("field"), F.trim(F.regexp_extract("line", _FIELD, 2)).alias("type"))


def type_references(definition: Column) -> Column:
    """Distinct capitalised names of a type expression, without built-in and primitive ones."""
    names = F.array_distinct(F.regexp_extract_all(definition, F.lit(r"(?<![A-Za-z0-9_])([A-Z]\w*)"), F.lit(1)))
    return F.filter(names, lambda x: ~x.isin(*rules.BUILT_IN_TYPES) & ~F.lower(x).isin(*rules.PRIMITIVES))


def type_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations (name, kind, path) and distinct relations (src, dst, relation) between declared types."""
    ts = files.filter(F.col("path").endswith(".ts") | F.col("path").endswith(".tsx"))
    inter = matches(ts, "content", r"(?:export\s+)?interface\s+(\w+(?:\s+extends\s+[\w,\s<>]+)?)\s*\{")
    alias = matches(ts, "content", r"(?:export\s+)?type\s+(\w+(?:<[^>]*>)?\s*=\s*[^;]+);")
    klass = matches(ts, "content", r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?)\s*\{")
    enums = matches(ts, "content", r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)\s*\{")
    bound = matches(ts, "content", r"<(\w+\s+extends\s+\w+)")
    name = F.regexp_extract("hit", r"^(\w+)", 1)
    declared = inter.select(name.alias("name"), F.lit("interface").alias("kind"), "path").union(alias.select(name, F.lit("alias"), "path")).union(klass.select(name, F.lit("class"), "path")).union(enums.select(name, F.lit("enum"), "path"))
    listed = lambda pattern: F.transform(F.split(F.regexp_extract("hit", pattern, 1), ","), lambda x: F.trim(F.regexp_replace(x, r"(?s)<.*", "")))
    edges = inter.select(name.alias("src"), F.explode(listed(r"(?s)\sextends\s+(.*)$")).alias("dst"), F.lit("extends").alias("relation"))
    edges = edges.union(alias.select(name, F.explode(type_references(F.regexp_extract("hit", r"(?s)=\s*(.*)$", 1))), F.lit("references")))
    edges = edges.union(klass.select(name, F.regexp_extract("hit", r"\sextends\s+(\w+)", 1), F.lit("extends")))
    edges = edges.union(klass.select(name, F.explode(listed(r"(?s)\simplements\s+(.*)$")), F.lit("implements")))
    edges = edges.union(bound.select(name, F.explode(type_references(F.regexp_extract("hit", r"extends\s+(\w+)$", 1))), F.lit("constrained-by")))
    known = declared.select("name").distinct()
    edges = edges.filter("src <> dst AND dst <> ''").join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return declared, edges.select("src", "dst", "relation").distinct()


_DOC_BLOCK = re.compile(r"/\*\*.*?\*/", re.S)
_EXPORTS = (
    ("function", re.compile(r"export\s+(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", re.A)),
    ("arrow", re.compile(r"export\s+const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", re.A)),
    ("default", re.compile(r"export\s+default\s+(?:async\s+)?function(?:\s+(\w+))?\s*\(([^)]*)\)", re.A)),
)


#: What stands for a missing type or reason.
ANY_TYPE, NO_TYPE, NO_REASON = "any", "void", "This function is deprecated."


def _param(doc: dict, value: str) -> None:
    if m := re.match(r"(?:\{([^}]+)\}\s*)?(\[?[\w.]+\]?)\s*(?:-\s*)?(.*)$", value):
        doc["params"].append({"type": m[1] or ANY_TYPE, "name": m[2].strip("[]"), "optional": m[2].startswith("["), "description": m[3]})


def _returns(doc: dict, value: str) -> None:
    m = re.match(r"(?:\{([^}]+)\}\s*)?(.*)$", value)
    doc["returns"] = {"type": m[1] or NO_TYPE, "description": m[2]}


#: What each tag adds to a comment.
TAGS = {
    **dict.fromkeys(("param", "arg", "argument"), _param), **dict.fromkeys(("returns", "return"), _returns),
    "deprecated": lambda doc, value: doc.update(deprecated=value or NO_REASON), "since": lambda doc, value: doc.update(since=value),
    "example": lambda doc, value: doc["examples"].append(value), "see": lambda doc, value: doc["see"].append(value),
    **dict.fromkeys(("throws", "exception"), lambda doc, value: doc["throws"].append(value)),
}


def parse_doc(block: str) -> dict:
    """Description and tags of a documentation comment."""
    doc = {"description": "", "params": [], "returns": None, "deprecated": None, "examples": [], "throws": [], "see": [], "since": None}
    lines = (re.sub(r"^\s*\*\s?", "", line).strip() for line in block.removeprefix("/**").removesuffix("*/").split("\n"))
    # a tag begins a line, and its text runs to the next tag; what stands before the first is the description
    head, *tagged = re.split(r"(?m)^(?=@\w)", "\n".join(x for x in lines if x))
    doc["description"] = " ".join(head.split("\n")).strip()
    for part in tagged:
        tag, value = re.match(r"@(\w+)\s*(.*)$", " ".join(part.split("\n"))).groups()
        if tag in TAGS:
            TAGS[tag](doc, value.strip())
    return doc


def _exported(source: str) -> Iterator[tuple[re.Match, str, dict | None]]:
    """Exports with their kind and the comment right before them."""
    blocks = [(m.end(), m[0]) for m in _DOC_BLOCK.finditer(source)]
    ends = [b[0] for b in blocks]
    for kind, pattern in _EXPORTS:
        for m in pattern.finditer(source):
            k = bisect.bisect_right(ends, m.start())
            yield m, kind, parse_doc(blocks[k - 1][1]) if k and not source[ends[k - 1] : m.start()].strip() else None


def exports_of(source: str) -> list[tuple]:
    """(name, kind, line, description, params, returns, deprecated): exports with the comment right before them."""
    found, line = [], line_of(source)
    for m, kind, doc in _exported(source):
        params = ",".join(f"{p['name']}{'?' if p['optional'] else ''}:{p['type']}" for p in doc["params"]) if doc else None
        found.append((m[1] or "default", kind, line(m.start()), doc and doc["description"], params, doc and doc["returns"] and doc["returns"]["type"], doc and doc["deprecated"]))
    return found


def documented(source: str) -> list[tuple[str, str, int, dict]]:
    """(name, kind, line, whole comment) of the exports that have one."""
    line = line_of(source)
    return [(m[1] or "default", kind, line(m.start()), doc) for m, kind, doc in _exported(source) if doc]


def exports(files: DataFrame) -> DataFrame:
    return _per_row(files, exports_of, "name string, kind string, line long, description string, params string, returns string, deprecated string")


def coverage(found: DataFrame) -> DataFrame:
    """(path, exports, documented, share): share is 1 without exports."""
    each = found.groupBy("path").agg(F.count("*").alias("exports"), F.count("description").alias("documented"))
    return each.withColumn("share", F.coalesce(F.try_divide(F.col("documented").cast("double"), F.col("exports")), F.lit(1.0)))


def sanitized(column: Column) -> Column:
    """Text without lines that address the reader, blank lines collapsed."""
    for pattern in rules.CHATTY:
        column = F.regexp_replace(column, pattern, "")
    return F.regexp_replace(F.regexp_replace(column, r"\n{3,}", "\n\n"), r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def rescued_json(column: Column) -> Column:
    """The text if it parses as JSON, else a fenced block of it that does, else null."""
    fenced = F.nullif(F.regexp_extract(column, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    parses = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parses(column), parses(fenced))


SECRETS = r"sk-[A-Za-z0-9_-]{20,}|gh[ps]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|secret_[A-Za-z0-9]{20,}"


def entropy(column: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(column, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
