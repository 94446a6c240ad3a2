"""Extensions: functions that become methods of graphs or collections, and layouts, by name."""

from __future__ import annotations

from collections.abc import Callable

from graphloom.graph import Collection, Graph
from graphloom.operators import layouts

KINDS = {"core": Graph, "collection": Collection}
REGISTERED: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """Kind ``core`` or ``collection``: the function takes the graph or collection first; kind ``layout``: see ``layouts.layout``.
    Names that begin with an underscore, aren't identifiers, or exist are refused."""
    if kind not in (*KINDS, "layout"):
        raise ValueError(f"extensions of kind {kind!r} don't exist")
    if name.startswith("_") or (kind != "layout" and not name.isidentifier()):
        raise ValueError(f"{name!r} is no name for an extension")
    if kind == "layout":
        layouts.layout(name)(function)
    elif hasattr(KINDS[kind], name):
        raise ValueError(f"a {kind} has {name!r} already")
    else:
        setattr(KINDS[kind], name, function)
    REGISTERED[kind, name] = function


def extension(kind: str, name: str) -> Callable | None:
    """What is registered under the name, or None."""
    return REGISTERED.get((kind, name)) or (layouts.LAYOUTS.get(name) if kind == "layout" else None)


def use(module: Callable[[Callable], None]) -> None:
    """Lets a module register its extensions: it is called with ``register``."""
    module(register)
