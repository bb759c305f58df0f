"""Extensions: names, nodes, processors and methods that an application adds, and takes away again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from sparkloom.errors import ValidationError
from sparkloom.operators import prepare
from sparkloom.plans import flow, pandas_source


@dataclass
class Plugin:
    """What one extension brings: aliases of node types and processors, their handlers, and methods of
    the source front end ``(compiler, base, args, kw) -> value`` by name."""

    name: str
    node_aliases: dict[str, str] = field(default_factory=dict)
    processor_aliases: dict[str, str] = field(default_factory=dict)
    nodes: dict[str, Callable] = field(default_factory=dict)
    processors: dict[str, Callable] = field(default_factory=dict)
    methods: dict[str, Callable] = field(default_factory=dict)


class Registry:
    """Plugins in use. Activating one puts its names in place, deactivating restores what was there."""

    def __init__(self) -> None:
        self.active: dict[str, list[tuple[dict, str, Any]]] = {}

    def activate(self, plugin: Plugin) -> None:
        if plugin.name in self.active:
            raise ValidationError(f"plugin {plugin.name!r} is active")
        unknown = [t for t in plugin.node_aliases.values() if t not in flow.NODES and t not in plugin.nodes] + [t for t in plugin.processor_aliases.values() if t not in prepare.PROCESSORS and t not in plugin.processors]
        if unknown:
            raise ValidationError(f"aliases of {unknown}, which do not exist")
        before: list[tuple[dict, str, Any]] = []

        def put(table: dict, name: str, value: Any) -> None:
            before.append((table, name, table.get(name)))
            table[name] = value

        for table, made in ((flow.NODES, plugin.nodes), (prepare.PROCESSORS, plugin.processors), (pandas_source.METHODS, plugin.methods)):
            for name, f in made.items():
                put(table, name, f)
        for table, aliases in ((flow.NODES, plugin.node_aliases), (prepare.PROCESSORS, plugin.processor_aliases)):
            for name, target in aliases.items():
                put(table, name, table[target])
        self.active[plugin.name] = before

    def deactivate(self, name: str) -> None:
        if name not in self.active:
            raise ValidationError(f"plugin {name!r} is not active")
        for table, key, old in reversed(self.active.pop(name)):
            if old is None:
                table.pop(key, None)
            else:
                table[key] = old

    def clear(self) -> None:
        """Deactivate all, the last first."""
        for name in reversed(list(self.active)):
            self.deactivate(name)
