"""Spans told by pieces equal those of a loop over characters."""

import random

import pytest

from quillspar.operators import lexing, parsing


def by_characters(source):
    """(start, finish, kind, line) by one loop, written apart from the automaton."""
    found, i, n = [], 0, len(source)
    while i < n:
        two, at = source[i : i + 2], i
        if two == "//":
            while i < n and source[i] != "\n":
                i += 1
            kind = "comment"
        elif two == "/*":
            end = source.find("*/", i + 2)
            i, kind = (end + 2 if end >= 0 else n), "comment"
        elif source[i] in "'\"`":
            mark, kind = source[i], "template" if source[i] == "`" else "string"
            i += 1
            while i < n:
                if source[i] == "\\":
                    i += 2
                elif source[i] == mark:
                    i += 1
                    break
                elif source[i] == "\n" and mark != "`":
                    break
                else:
                    i += 1
            i = min(i, n)
        else:
            i += 1
            continue
        found.append((at, i, kind, source.count("\n", 0, at) + 1))
    return found


def sources(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("//**'\"`\\\n aé\U0001f600g(") for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("size", "fan"), [(1, 2), (3, 2), (7, 4), (1 << 18, 32)])
def test_pieces_equal_a_loop_over_characters(spark, size, fan):
    texts = dict(enumerate(sources(60, 70, size)))
    files = spark.createDataFrame([(str(k), t) for k, t in texts.items()] + [("null", None), ("empty", "")], "path string, content string")
    got = {}
    for r in lexing.spans(files, size, fan).collect():
        got.setdefault(r.path, []).append((r.start, r.finish, r.kind, r.line))
        assert r.text == texts[int(r.path)][r.start : r.finish]
    assert {k: sorted(v) for k, v in got.items()} == {str(k): x for k, t in texts.items() if (x := by_characters(t))}


def test_effects_equal_those_of_characters_composed():
    for text in sources(300, 12, 1):
        ends = lexing.effects(text)[0]
        for state in lexing.STATES:
            now = state
            for c in text:
                now = lexing.effects(c)[0][now]
            assert ends[state] == now, (text, state)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_tags_and_schemas(spark, size):
    source = "a = gql`type A { id: ID }`; // graphql`type B { x: Int }`\nb = gql  \n `type C { y: Int }`; c = 'gql`'; d = css`type D { z: Int }`; e = `${f}`; g = h /gql`type E { e: Int }`"
    found = sorted((r.start, r.tag) for r in lexing.spans(spark.createDataFrame([("x", source)], "path string, content string"), size, 2).collect() if r.kind == "template")
    assert [t for _, t in found] == ["gql", "gql", "css", "", "gql"]
    names = {r.name: r.path for r in parsing.schema_members(lexing.tagged_schemas(spark.createDataFrame([("x", source)], "path string, content string"))).collect()}
    assert names == {"A": "x", "C": "x", "E": "x"}


def test_exact_complexity_knows_marks_in_literals(spark):
    source = 'const u = "http://x"; const v = "/*"; if (a) { b ? c : d } const w = "*/"; // if (x)\n'
    assert parsing.complexity(source, exact=True) == 3
    assert parsing.complexity(source) == 1  # what stands between the marks is taken as a comment
    files = spark.createDataFrame([("f.js", source)], "path string, content string")
    assert parsing.measured(files, exact=True).first().complexity == 3


def test_empty_table_and_repeated_texts(spark):
    assert lexing.spans(spark.createDataFrame([], "path string, content string")).count() == 0
    files = spark.createDataFrame([("a", "'x'"), ("b", "'x'"), (None, "'x'")], "path string, content string")
    assert sorted(r.path for r in lexing.spans(files).collect()) == ["a", "b"]
