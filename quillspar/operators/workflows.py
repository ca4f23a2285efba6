"""Workflows of an older kind brought up to date: a pass over the lines of each, which knows steps and script blocks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The runtime's step, and what tells the steps that it follows and that need variables.
RUNTIME, RUNTIME_STEP = "actions/setup-node@", ("- name: Setup Node.js", "  uses: actions/setup-node@v4", "  with:", "    node-version: 20")
CHECKOUT = re.compile(r"uses:\s*actions/checkout@v\d+")
PUBLISHES = re.compile(r"- name: .*(?:publish|generate).*documentation", re.I)
INSTALL = re.compile(r"\s*npm\s+(?:ci|install)\s*")


@dataclass(frozen=True)
class Tool:
    """A tool whose workflows change: its old name, the package that holds it now, and environment variables of its step.

    `secrets` are read from secrets of the same names, the first tells whether a workflow has them; `settings` are names
    with values that follow them.
    """

    name: str
    package: str
    secrets: Sequence[str] = ()
    settings: Sequence[tuple[str, str]] = ()


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _scripts(lines: list[str]) -> list[int]:
    """For each line the number of the script block (`run: |`) it stands in, or -1."""
    inside, out, begun = -1, [], 0
    for k, line in enumerate(lines):
        if inside >= 0 and line.strip() and _depth(line) <= begun:
            inside = -1
        out.append(inside)
        if re.match(r"\s*(?:- )?run:\s*\|", line):
            inside, begun = k, _depth(line)
    return out


def _secret(name: str) -> str:
    return f"{name}: ${{{{ secrets.{name} }}}}"


def migrated(content: str, tool: Tool) -> str:
    """One workflow without the tool's old folder and the install of its script, on a set-up runtime, with its variables."""
    lines = content.split("\n")
    enters = re.compile(rf"\s*cd\s+tools/{re.escape(tool.name)}\s*", re.I)
    scripts = _scripts(lines)
    entered = {s for line, s in zip(lines, scripts, strict=True) if s >= 0 and enters.fullmatch(line)}
    lines = [x for x, s in zip(lines, scripts, strict=True) if not enters.fullmatch(x) and not (s in entered and INSTALL.fullmatch(x))]
    calls = re.compile(rf"npx\s+{re.escape(tool.name)}\s+")
    lines = [calls.sub(f"npx {tool.package}@latest ", x) for x in lines]
    if RUNTIME not in content:
        lines = _with_runtime(lines)
    held = any(s in content for s in tool.secrets[:1])
    if tool.secrets and not held and "env:" not in content:
        lines = _with_environment(lines, tool)
    elif held and tool.settings and tool.settings[0][0] not in content:
        last = next((k for k, x in enumerate(lines) if x.strip() == _secret(tool.secrets[-1])), None)
        if last is not None:
            lines[last + 1 : last + 1] = [" " * _depth(lines[last]) + f"{n}: {v}" for n, v in tool.settings]
    return "\n".join(lines)


def _with_runtime(lines: list[str]) -> list[str]:
    """The step that sets up the runtime, after the first checkout that is a named step."""
    for k, line in enumerate(lines):
        if k and CHECKOUT.search(line) and "- name:" in lines[k - 1]:
            pad = " " * _depth(lines[k - 1])
            return [*lines[: k + 1], "", *[pad + x for x in RUNTIME_STEP], *lines[k + 1 :]]
    return lines


def _with_environment(lines: list[str], tool: Tool) -> list[str]:
    """The variables before the command of the first step that publishes or generates documentation."""
    for k, line in enumerate(lines[1:], 1):
        if line.lstrip().startswith("run:") and PUBLISHES.search(lines[k - 1]):
            pad = " " * _depth(line)
            added = [*map(_secret, tool.secrets), *[f"{n}: {v}" for n, v in tool.settings]]
            return [*lines[:k], f"{pad}env:", *[f"{pad}  {x}" for x in added], *lines[k:]]
    return lines


def migrated_workflow(content: Column, tool: Tool) -> Column:
    """Workflows brought up to date, by Arrow batches; null stays null, and what needs no change stays as it is."""

    @F.pandas_udf("string")
    def change(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: migrated(x, tool), na_action="ignore")

    return change(content)
