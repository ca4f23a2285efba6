"""All queries of this library but those over corpora."""

from __future__ import annotations

from quillspar.plans import base, changes, contexts, facts, lexing, live, rendering, settings, snippets, sources_and_text, structure  # noqa: F401  importing a module registers its queries


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
