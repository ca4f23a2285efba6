"""Settings of many repositories checked in one pass: structure, globs, publishers, domains, secrets and shell characters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.functions import rules
from quillspar.operators.parsing import SECRETS

try:  # settings in YAML need it, JSON doesn't
    import yaml
except ImportError:
    yaml = None

#: The version that is known, and where pages may be published.
VERSION, PUBLISHERS = "1", ("notion", "markdown", "confluence", "github_wiki")
NODE = "at string, depth int, top string, second string, third string, item boolean, kind string, value string, names array<string>"
_NODES = pa.schema([("at", pa.string()), ("depth", pa.int32()), ("top", pa.string()), ("second", pa.string()), ("third", pa.string()), ("item", pa.bool_()), ("kind", pa.string()), ("value", pa.string()), ("names", pa.list_(pa.string()))])


def _kind(x) -> str:
    if isinstance(x, bool) or x is None:
        return "boolean" if x is not None else "null"
    return {dict: "object", list: "array", str: "string", int: "number", float: "number"}.get(type(x), "other")


def _nodes(text: str | None, form: str) -> Iterator[tuple]:
    """Every value of a settings file from its root on, in order; one node of kind `unreadable` if it can't be parsed."""
    try:
        root = json.loads(text or "") if form == "json" else yaml.safe_load(text or "")
    except (ValueError, RecursionError) if form == "json" else (yaml.YAMLError, ValueError, RecursionError):
        yield ("root", 0, None, None, None, False, "unreadable", None, [])
        return
    left = [(root, "root", (), False)]
    while left:  # a stack of our own, so that depth has no bound
        x, at, names, item = left.pop()
        kind = _kind(x)
        held = [k for k, v in x.items() if v is not None] if kind == "object" else [str(len(x))] if kind == "array" and x else []
        yield (at, len(names), *(names + (None,) * 3)[:3], item, kind, x if kind == "string" else json.dumps(x) if kind in ("number", "boolean") else None, [str(k) for k in held])
        inner = [(v, f"{at}.{k}", (*names, str(k)), False) for k, v in x.items()] if kind == "object" else [(v, f"{at}[{i}]", (*names, str(i)), True) for i, v in enumerate(x)] if kind == "array" else []
        left += reversed(inner)


def nodes(rows: DataFrame, key: str, column: str, form: str = "json") -> DataFrame:
    """(key, at, depth, top, second, third, item, kind, value, names): all values of settings in JSON or YAML, by Arrow batches.

    top to third are the names on the way from the root, positions in lists included; `names` are those of an object's
    members that aren't null, or a list's length unless it is empty. Null and empty settings are unreadable as JSON, null as YAML.
    """
    if form == "yaml" and yaml is None:
        raise RuntimeError("settings in YAML need the package yaml")
    field = rows.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = list(_nodes(text, form))
                for k in range(0, len(found), 4096):
                    part = found[k : k + 4096]
                    own = [pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _NODES, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([i] * len(part), pa.int64())), *own], names=[key, *_NODES.names])

    return rows.select(key, column).mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, {NODE}")


def _issue(condition: Column, severity: str, text: str) -> Column:
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("issue")))


def issues(rows: DataFrame, key: str, column: str, form: str = "json") -> DataFrame:
    """(key, at, severity, issue): what is wrong (error) or unsafe to leave out (warning), and where; each node on its own."""
    c = F.col
    at = lambda depth, top, second=None: (c("depth") == depth) & (c("top") == top) & (c("second") == second if second else F.lit(True))
    is_not = lambda *kinds: ~c("kind").isin(*kinds, "null")
    lacks = lambda name: (c("kind") == "object") & ~F.array_contains("names", name)
    root, text = c("depth") == 0, c("kind") == "string"
    glob = lambda *lists: (c("depth") == 3) & (c("top") == "scan") & c("second").isin(*lists) & c("item")
    named = at(2, "publishers") & F.when(c("item"), ~c("value").isin(*PUBLISHERS) | ~text).otherwise(~c("second").isin(*PUBLISHERS))
    branch = (c("depth") == 3) & (c("top") == "notion") & (c("second") == "branches") & c("item")
    domain = at(2, "domains")
    part = lambda name: (c("depth") == 3) & (c("top") == "domains") & (c("third") == name)
    shell = glob("include", "exclude", "ignore") & text
    checks = [
        _issue(root & (c("kind") == "unreadable"), "error", "can't be read"),
        _issue(root & is_not("object", "unreadable"), "error", "must be an object"),
        _issue(root & lacks("configVersion"), "error", "configVersion is missing"),
        _issue(at(1, "configVersion") & (c("kind") != "null") & ((c("kind") != "number") | (c("value") != VERSION)), "error", "version isn't known"),
        _issue(root & lacks("scan"), "warning", "scan is missing, defaults hold"),
        _issue(root & lacks("publishers"), "warning", "publishers are missing, nothing is published"),
        _issue(at(1, "publishers") & c("kind").isin("array", "object") & (F.size("names") == 0), "warning", "publishers are missing, nothing is published"),
        _issue(at(1, "publishers") & is_not("array", "object"), "error", "must be a list or an object"),
        _issue(named, "error", "isn't a known publisher"),
        _issue(at(2, "publishers") & ~c("item") & is_not("object", "boolean"), "error", "must be an object or a boolean"),
        _issue((at(2, "scan", "include") | at(2, "scan", "ignore")) & is_not("array"), "error", "must be a list of globs"),
        _issue(glob("include", "ignore") & ~text, "error", "must be a text"),
        _issue(glob("include") & text & c("value").contains(".."), "error", "leaves its folder"),
        _issue(glob("include") & c("value").isin("**", "**/*"), "error", "matches everything"),
        _issue((at(2, "scan", "root") | at(2, "notion", "workspaceId") | part("description")) & is_not("string"), "error", "must be a text"),
        _issue(at(2, "notion", "branches") & is_not("array"), "error", "must be a list"),
        _issue(branch & ~text, "error", "must be a text"),
        _issue(branch & text & (c("value").contains("..") | c("value").contains("/")), "error", "isn't a safe branch name"),
        _issue(at(1, "notion") & lacks("branches"), "warning", "branches are missing, all are published"),
        _issue(at(1, "notion") & lacks("workspaceId"), "warning", "workspaceId is missing"),
        _issue(at(1, "domains") & is_not("object"), "error", "must be an object"),
        _issue(domain & ~c("item") & is_not("object"), "error", "must be an object"),
        _issue(domain & lacks("match"), "error", "needs a list `match`"),
        _issue(part("match") & is_not("array"), "error", "needs a list `match`"),
        _issue((c("depth") == 4) & (c("top") == "domains") & (c("third") == "match") & c("item") & ~text, "error", "must be a text"),
        _issue(text & c("value").rlike(SECRETS), "error", "holds a secret"),
        *[_issue(shell & c("value").contains(x), "error", f"holds {x}") for x in rules.SHELL_CHARACTERS],
        _issue(shell & (c("value").contains("$(") | c("value").contains("${")), "error", "substitutes a command"),
    ]
    found = F.explode(F.array_compact(F.array(*checks))).alias("found")
    return nodes(rows, key, column, form).select(key, "at", found).select(key, "at", "found.severity", "found.issue")
