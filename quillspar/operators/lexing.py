"""Comments, strings, templates and code of source text told apart in pieces, and schemas in tagged templates.

An automaton with a few states reads the text. What a piece does is a function from the state before it to the state after
it, so pieces of one long text are read by different tasks: each piece tells for every state where it leads, these functions
are composed in blocks of `FAN` and blocks of blocks (so no group is larger than that), and once the state before each
piece is known, the pieces are read again and spans that run over several are put together.

Strings end at their quote or before a newline, templates at the next backtick, both after an even number of backslashes;
`${` doesn't nest. Literals of regular expressions are code. A comment or literal that nothing ends runs to the text's end.
Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspar.session import drop_table, write_table

CODE, SLASH, LINE, BLOCK, STAR, SINGLE, SINGLE_ESCAPE, DOUBLE, DOUBLE_ESCAPE, TEMPLATE, TEMPLATE_ESCAPE = STATES = range(11)
KINDS = {LINE: "comment", BLOCK: "comment", STAR: "comment", SINGLE: "string", SINGLE_ESCAPE: "string", DOUBLE: "string", DOUBLE_ESCAPE: "string", TEMPLATE: "template", TEMPLATE_ESCAPE: "template"}
#: Characters of a piece, pieces of a block, and characters before a template in which its tag is looked for.
PIECE, FAN, TAG = 1 << 18, 32, 64

_OPENS = re.compile(r"//|/\*|['\"`]|/\Z")
_BEGUN = {"//": LINE, "/*": BLOCK, "'": SINGLE, '"': DOUBLE, "`": TEMPLATE}
_LITERAL = {SINGLE: re.compile(r"(?:[^'\\\n]|\\[\s\S])*+"), DOUBLE: re.compile(r'(?:[^"\\\n]|\\[\s\S])*+'), TEMPLATE: re.compile(r"(?:[^`\\]|\\[\s\S])*+")}
_TAIL = re.compile(r"\w*\s*\Z", re.A)


def _close(piece: str, at: int, state: int) -> tuple[int, int]:
    """Where the comment or literal that is open at `at` ends, and the state there: code again, or what the piece ends in."""
    size = len(piece)
    if at == size:
        return size, state
    if state == LINE:
        end = piece.find("\n", at)
        return (end, CODE) if end >= 0 else (size, LINE)
    if state in (BLOCK, STAR):
        if state == STAR and piece[at] == "/":
            return at + 1, CODE
        end = piece.find("*/", at)
        return (end + 2, CODE) if end >= 0 else (size, STAR if piece[-1] == "*" else BLOCK)
    if state in (SINGLE_ESCAPE, DOUBLE_ESCAPE, TEMPLATE_ESCAPE):
        at, state = at + 1, state - 1
    end = _LITERAL[state].match(piece, at).end()
    if end == size:
        return size, state
    if piece[end] == "\\":  # the piece's last character
        return size, state + 1
    return (end, CODE) if piece[end] == "\n" else (end + 1, CODE)


def lexed(piece: str, state: int) -> Iterator[tuple[int, int, int, int]]:
    """(kind's state, start, end, state after) of each comment and literal; start is -1 for what is open before the piece.

    A slash at the end of the piece that may begin a comment is one too, of state SLASH.
    """
    at = 0
    if state == SLASH:
        state = {"/": LINE, "*": BLOCK}.get(piece[:1], CODE if piece else SLASH)
        if state == SLASH:
            return
        if state != CODE:
            end, after = _close(piece, 1, state)
            yield state, -1, end, after
            at, state = end, after
    elif state != CODE:
        end, after = _close(piece, 0, state)
        yield state, -1, end, after
        at, state = end, after
    while state == CODE and (m := _OPENS.search(piece, at)):
        begun = _BEGUN.get(m[0], SLASH)
        end, after = (m.end(), SLASH) if begun == SLASH else _close(piece, m.end(), begun)
        yield begun, m.start(), end, after
        at, state = end, after


def effects(piece: str) -> tuple[list[int], list[int], list[str], list[bool]]:
    """For each state before the piece: the state after it, where what is then open begins (-1: before the piece), the end of
    the code that may be a tag, and whether that reaches back before the piece.

    States that meet in code at one place share the rest of the way, so the piece isn't read for each of them.
    """
    known: dict[int, tuple[int, int, int]] = {}
    ends, opens, tails, whole = [], [], [], []
    for state in STATES:
        if not piece:
            result = (state, -1, 0)
        else:
            seen, result = [], (CODE, -1, 0) if state in (CODE, SLASH) else (state, -1, 0)
            code_from = 0
            if state == CODE:
                seen.append(0)
            for _, start, end, after in lexed(piece, state) if not (state == CODE and 0 in known) else ():
                code_from = end
                result = (after, start, code_from)
                if after == CODE:
                    if end in known:
                        break
                    seen.append(end)
            if state == CODE and 0 in known:
                result = known[0]
            elif result[0] == CODE and code_from in known:
                result = known[code_from]
            for at in seen:
                known.setdefault(at, result)
        after, start, code_from = result
        ends.append(after)
        opens.append(start if after != CODE else -1)
        # a slash that begins nothing is code, but no part of a tag
        tail = _TAIL.search(piece, max(code_from, len(piece) - TAG))[0] if after == CODE else ""
        tails.append(tail)
        whole.append(after == CODE and state == CODE and len(tail) == len(piece))
    return ends, opens, tails, whole


_EFFECT = "size long, breaks long, ends array<int>, opens array<long>, lines array<long>, tails array<string>, whole array<boolean>"


def pieces(files: DataFrame, size: int = PIECE) -> DataFrame:
    """(path, k, piece): texts of up to `size` characters as they stand, longer ones cut and dealt to tasks by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                for k, at in enumerate(range(0, len(content), size)):
                    yield pa.RecordBatch.from_pydict({"path": [path], "k": pa.array([k], pa.int64()), "piece": [content[at : at + size]]})

    length = F.length("content")
    short = files.filter((length > 0) & (length <= size)).select("path", F.lit(0).cast("long").alias("k"), F.col("content").alias("piece"))
    long = files.filter(length > size).select("path", "content").mapInArrow(run, "path string, k long, piece string")
    return short.union(long.repartition("path", "k"))


def _effects(cut: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, k, piece in zip(*(batch.column(c).to_pylist() for c in ("path", "k", "piece")), strict=True):
                ends, opens, tails, whole = effects(piece)
                lines = [piece.count("\n", 0, x) if x >= 0 else -1 for x in opens]
                out.append((path, k, len(piece), piece.count("\n"), ends, opens, lines, tails, whole))
            if out:
                names = ("path", "k", "size", "breaks", "ends", "opens", "lines", "tails", "whole")
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return cut.mapInArrow(run, f"path string, k long, {_EFFECT}")


def _then(a: Column, b: Column) -> Column:
    """The effect of a and then b."""
    states = F.sequence(F.lit(0), F.lit(len(STATES) - 1))
    pick = lambda array, s: F.get(array, s)
    middle = lambda s: pick(a["ends"], s)
    own = lambda s: pick(b["opens"], middle(s)) >= 0
    joined = lambda s: F.right(F.concat(pick(a["tails"], s), pick(b["tails"], middle(s))), F.lit(TAG))
    return F.struct(
        (a["size"] + b["size"]).alias("size"), (a["breaks"] + b["breaks"]).alias("breaks"),
        F.transform(states, lambda s: pick(b["ends"], middle(s))).alias("ends"),
        F.transform(states, lambda s: F.when(own(s), a["size"] + pick(b["opens"], middle(s))).otherwise(pick(a["opens"], s))).alias("opens"),
        F.transform(states, lambda s: F.when(own(s), a["breaks"] + pick(b["lines"], middle(s))).otherwise(pick(a["lines"], s))).alias("lines"),
        F.transform(states, lambda s: F.when(pick(b["whole"], middle(s)), joined(s)).otherwise(pick(b["tails"], middle(s)))).alias("tails"),
        F.transform(states, lambda s: pick(a["whole"], s) & pick(b["whole"], middle(s))).alias("whole"),
    )


_NAMES = [c.split()[0] for c in _EFFECT.split(", ")]
#: What is known before a piece.
_BEFORE = "state int, at long, line long, open long, open_line long, tail string"


def _after(before: Column, x: Column) -> Column:
    """What is known after a piece with effect x, from what is known before it."""
    s = before["state"]
    own = F.get(x["opens"], s) >= 0
    return F.struct(
        F.get(x["ends"], s).alias("state"), (before["at"] + x["size"]).alias("at"), (before["line"] + x["breaks"]).alias("line"),
        F.when(own, before["at"] + F.get(x["opens"], s)).otherwise(before["open"]).alias("open"),
        F.when(own, before["line"] + F.get(x["lines"], s)).otherwise(before["open_line"]).alias("open_line"),
        F.when(F.get(x["whole"], s), F.right(F.concat(before["tail"], F.get(x["tails"], s)), F.lit(TAG))).otherwise(F.get(x["tails"], s)).alias("tail"),
    )


def entries(effects_of: DataFrame, longest: int, fan: int = FAN) -> DataFrame:
    """(path, k, before): what is known before each piece, from the effects of all; `longest` is the greatest k.

    Blocks of `fan` pieces are composed, their blocks likewise, and what is known goes back down the same way.
    """
    each = effects_of.select("path", "k", F.struct(*_NAMES).alias("x"))
    if longest == 0:
        start = F.struct(F.lit(CODE).alias("state"), F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("line"), F.lit(-1).cast("long").alias("open"), F.lit(-1).cast("long").alias("open_line"), F.lit("").alias("tail"))
        return each.select("path", "k", start.alias("before"))
    block = F.floor(F.col("k") / fan).cast("long").alias("block")
    grouped = write_table(each.groupBy("path", block).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("members")), "blocks")
    composed = grouped.select("path", F.col("block").alias("k"), F.aggregate(F.slice("members", 2, fan), F.element_at("members", 1)["x"], lambda acc, m: _then(acc, m["x"])).alias("x"))
    above = entries(composed.select("path", "k", "x.*"), longest // fan, fan).withColumnRenamed("k", "block")
    # a block holds its first piece, so running through its members needs no more than fan steps
    step = lambda acc, m: F.struct(_after(acc["b"], m["x"]).alias("b"), F.concat(acc["out"], F.array(F.struct(m["k"].alias("k"), acc["b"].alias("before")))).alias("out"))
    run = F.aggregate("members", F.struct(F.col("before").alias("b"), F.array().cast(f"array<struct<k:long,before:struct<{_BEFORE.replace(' ', ':').replace(',:', ',')}>>>").alias("out")), step, lambda acc: acc["out"])
    return grouped.join(above, ["path", "block"]).select("path", F.explode(run).alias("m")).select("path", "m.k", "m.before")


_SPAN = "path string, start long, finish long, kind string, line long, tag string, text string"


def spans(files: DataFrame, size: int = PIECE, fan: int = FAN) -> DataFrame:
    """(path, start, finish, kind, line, tag, text) of each comment, string and template, its marks included.

    Code points from 0, `finish` exclusive; the 1-based line where it begins; tag is the name right before a template, blanks
    between them allowed, as far as name and blanks have TAG characters, else empty. `path` must tell files apart; null paths are no files.
    """
    cut = write_table(pieces(files.filter("path IS NOT NULL"), size), "pieces")
    told = write_table(_effects(cut), "effects")
    longest = told.agg(F.max("k")).first()[0] or 0
    known = write_table(entries(told, longest, fan), "entries")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, piece, b in zip(*(batch.column(c).to_pylist() for c in ("path", "piece", "before")), strict=True):
                out, line, counted, code_from, tail = [], b["line"], 0, 0, b["tail"] if b["state"] == CODE else ""
                for kind, start, end, after in lexed(piece, b["state"]):
                    if start < 0:
                        at, begun, tag, text = b["open"], b["open_line"], None, piece[:end]
                    else:
                        line, counted = line + piece.count("\n", counted, start), start
                        at, begun, tag, text = b["at"] + start, line, "", piece[start:end]
                        if kind == TEMPLATE:
                            code = (tail if code_from == 0 else "") + piece[code_from:start]
                            tag = _TAIL.search(code, max(0, len(code) - TAG))[0].strip()
                    out.append((path, at, b["at"] + end, KINDS.get(kind), begun, tag, text, start >= 0 and after == CODE))
                    code_from, tail = end, ""
                for i in range(0, len(out), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 8192], strict=True), kinds, strict=True)], names=["path", "start", "finish", "kind", "line", "tag", "text", "closed"])

    found = write_table(cut.join(known, ["path", "k"]).select("path", "piece", "before").mapInArrow(run, f"{_SPAN}, closed boolean"), "spans")
    for table in (cut, told, known):
        drop_table(table)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finish", "text"))), lambda x: x["text"]), "")
    joined = found.filter("NOT closed").groupBy("path", "start").agg(F.max("finish").alias("finish"), F.max("kind").alias("kind"), F.min("line").alias("line"), F.max("tag").alias("tag"), texts.alias("text"))
    columns = [c.split()[0] for c in _SPAN.split(", ")]
    return found.filter("closed").select(*columns).union(joined.filter("kind IS NOT NULL").select(*columns))


#: Names before a template that make it a schema.
SCHEMA_TAGS = ("gql", "graphql")


def tagged_schemas(files: DataFrame, tags: tuple[str, ...] = SCHEMA_TAGS) -> DataFrame:
    """(ord, path, content): the texts of templates with such a tag, as schema files numbered by where they begin."""
    found = spans(files).filter(F.col("tag").isin(*tags) & (F.col("kind") == "template"))
    return found.select(F.col("start").alias("ord"), "path", F.regexp_replace(F.expr("substr(text, 2)"), "`$", "").alias("content"))


def code_of(source: str) -> str:
    """The text with each comment as a space and each literal as two quotes: what stays is code, its newlines those of code."""
    out, at = [], 0
    for kind, start, end, _ in lexed(source, CODE):
        if kind != SLASH:
            out += [source[at:start], " " if KINDS[kind] == "comment" else '""']
            at = end
    return "".join([*out, source[at:]])
