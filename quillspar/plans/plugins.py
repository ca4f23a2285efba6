"""Plugins: callables over DataFrames, registered by name."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

HOOKS = ("afterScan", "afterRender", "afterPublish")
log = logging.getLogger(__name__)


@dataclass
class Plugin:
    name: str
    version: str = "0"
    renderers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    publishers: dict[str, Callable[[DataFrame], None]] = field(default_factory=dict)
    hooks: dict[str, Callable] = field(default_factory=dict)

    def check(self) -> None:
        if not self.name or not isinstance(self.name, str):
            raise ValueError("a plugin needs a name")
        for kind in ("renderers", "publishers", "hooks"):
            for key, f in getattr(self, kind).items():
                if not callable(f) or kind == "hooks" and key not in HOOKS:
                    raise ValueError(f"{self.name}: {kind} may not hold {key}")


class Registry:
    """The last plugin wins a key; hooks chain in order, a null result keeps the value, errors are logged and passed over."""

    def __init__(self) -> None:
        self.plugins: list[Plugin] = []

    def register(self, make: Callable[[], Plugin]) -> bool:
        """Add a plugin; one that can't be made or is not valid is skipped with a warning."""
        try:
            plugin = make()
            plugin.check()
        except Exception as e:
            log.warning("plugin skipped: %s", e)
            return False
        self.plugins.append(plugin)
        return True

    def renderers(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        return {k: f for p in self.plugins for k, f in p.renderers.items()}

    def publishers(self) -> dict[str, Callable[[DataFrame], None]]:
        return {k: f for p in self.plugins for k, f in p.publishers.items()}

    def run(self, hook: str, value):
        for p in self.plugins:
            if f := p.hooks.get(hook):
                try:
                    made = f(value)
                except Exception as e:
                    log.warning("%s: %s failed: %s", p.name, hook, e)
                    continue
                value = value if made is None else made
        return value
