"""Column expressions over paths and source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspar.functions import rules

SUFFIX = r"\.(ts|tsx|js|jsx)$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, of the last segment; empty if it has none or begins with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def first_match(text: Column, table: tuple, default: str) -> Column:
    """The label of the first row of (label, keywords) with a keyword in the lower-cased text."""
    text = F.lower(text)
    for label, keywords in reversed(table):
        default = F.when(any_of([text.contains(k) for k in keywords]), label).otherwise(default)
    return default


def is_api_route(path: Column) -> Column:
    return path.contains("/pages/api/") | (path.contains("/app/") & (path.endswith("/route.ts") | path.endswith("/route.js")))


def is_page(path: Column) -> Column:
    in_app = any_of([path.endswith(f"/page.{e}") for e in ("tsx", "jsx", "ts", "js")])
    in_pages = path.contains("/pages/") & ~path.contains("/pages/api/") & any_of([path.endswith(f".{e}") for e in ("tsx", "jsx", "ts", "js")])
    return F.when(path.contains("/app/"), in_app).otherwise(in_pages)


def after(path: Column, mark: str) -> Column:
    return F.substring(path, F.instr(path, mark) + len(mark), F.length(path))


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), path)


def route_path(path: Column) -> Column:
    """The route that a file serves; other files give their own path."""
    named = lambda p: F.regexp_replace(F.regexp_replace(p, r"\[(.*?)\]", ":$1"), r"/$", "")
    app = named(F.regexp_replace(F.regexp_replace(after(path, "/app/"), r"/page" + SUFFIX, ""), r"/route" + SUFFIX, ""))
    pages = named(F.regexp_replace(F.regexp_replace(after(path, "/pages/"), SUFFIX, ""), r"/index$", ""))
    api = F.concat(F.lit("/api/"), F.regexp_replace(after(path, "/pages/api/"), SUFFIX, ""))
    return F.when(path.contains("/app/"), _rooted(app)).when(path.contains("/pages/api/"), api).when(path.contains("/pages/"), _rooted(pages)).otherwise(path)


def changed_route_path(path: Column) -> Column:
    """The narrower projection for change lists: no plain pages, slashes kept."""
    app = F.regexp_replace(F.regexp_replace(F.regexp_replace(after(path, "/app/"), r"/page" + SUFFIX, ""), r"/route" + SUFFIX, ""), r"\[(.*?)\]", ":$1")
    api = F.concat(F.lit("/api/"), F.regexp_replace(after(path, "/pages/api/"), SUFFIX, ""))
    return F.when(path.contains("/app/"), _rooted(app)).when(path.contains("/pages/api/"), api).otherwise(path)


def is_changed_route(path: Column) -> Column:
    return path.contains("/pages/api/") | any_of([path.endswith(x) for x in ("/route.ts", "/route.js", "/page.tsx", "/page.jsx", "/page.ts", "/page.js")])


def valid_route(route: Column) -> Column:
    return F.coalesce(~route.isin("", "...", "*") & (F.length(route) <= 200) & route.rlike(r"^[/a-zA-Z0-9]"), F.lit(False))


def label(key: Column) -> Column:
    for pattern, to in ((r"^src/", ""), (r"^app/\((.*?)\)", "app/$1"), (r"/\((.*?)\)", "/$1"), (r"/+", "/")):
        key = F.regexp_replace(key, pattern, to)
    return key


def node_id(key: Column) -> Column:
    return F.regexp_replace(key, r"[^a-zA-Z0-9_]", "_")


def file_key(path: Column) -> Column:
    """Graph key of a file: no code extension, then no /index."""
    return F.regexp_replace(F.regexp_replace(slashed(path), r"\.(js|ts|jsx|tsx|mjs|cjs)$", ""), r"/index$", "")


def resolve(importer: Column, specifier: Column) -> Column:
    """Graph key that a relative import names: POSIX join of the importer's folder, . and .. folded, leading .. kept."""
    folder = F.regexp_replace(importer, r"(^|/)[^/]*$", "")
    parts = F.split(F.concat_ws("/", folder, specifier), "/")

    def push(stack: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)) != "..")
        return F.when(part.isin("", "."), stack).when(up, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.array_append(stack, part))

    empty = F.array().cast("array<string>")
    return file_key(F.array_join(F.aggregate(parts, empty, push), "/"))


def package_name(specifier: Column) -> Column:
    """Package of a bare specifier: two segments if scoped, else one."""
    parts = F.split(specifier, "/")
    return F.array_join(F.slice(parts, 1, F.when(specifier.startswith("@"), 2).otherwise(1)), "/")


def safe_path_error(path: Column) -> Column:
    """Null if a configured path is safe, else the code of what is wrong with it."""
    return (
        F.when(path.isNull(), "not_a_string")
        .when(path.contains(".."), "traversal")
        .when(path.startswith("/") | path.rlike(r"^[a-zA-Z]:"), "absolute")
        .when(path.contains("\0"), "null_byte")
    )


def impacted_module(path: Column) -> Column:
    """Below the first of the known roots: root and next segment; else the first segment."""
    parts = F.split(slashed(path), "/")
    roots = F.array(*map(F.lit, rules.IMPACT_ROOTS))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_contains(roots, F.element_at(parts, i)) & (i < F.size(parts)))
    first = F.get(places, F.lit(0))
    named = F.concat_ws("/", F.element_at(parts, first), F.nullif(F.element_at(parts, first + 1), F.lit("")))
    return F.when(first.isNotNull(), named).otherwise(F.coalesce(F.nullif(F.element_at(parts, 1), F.lit("")), F.lit("root")))


def half_up(x: Column) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(x + 0.5)
