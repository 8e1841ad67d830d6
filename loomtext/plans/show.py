"""Patterns as trees of text, with what each part results in."""

from __future__ import annotations

from loomtext.plans.build import lift
from loomtext.plans.nodes import Alt, At, Back, Cap, Char, Const, Named, Node, Ref, Rep


def _told(p: Node) -> str:
    name = type(p).__name__
    if isinstance(p, Const):
        return f"{name} {p.text!r}" + " in any case" * p.caseless
    if isinstance(p, Char):
        try:
            return f"{name} [{p.of.java()}]"
        except TypeError:
            return f"{name} by a function"
    if isinstance(p, Rep):
        return f"{name} {p.least} to {p.most}" + " lazily" * p.lazy
    if isinstance(p, At):
        return f"{name} {p.what}"
    if isinstance(p, (Named, Ref)):
        return f"{name} {p.name}"
    if isinstance(p, Cap):
        return f"{name} {p.index or '?'}" + f" {p.name}" * bool(p.name)
    if isinstance(p, Back):
        return f"{name} to {', '.join(map(str, p.groups))}"
    return name


def _result(p: Node) -> str:
    kind = p.kind()
    return "no result" if kind is None else kind.simpleString()


def tree(p) -> str:
    """A line for each part, indented below what holds it; a part met again within itself is not opened again."""
    lines: list[str] = []

    def walk(n: Node, depth: int, path: tuple) -> None:
        again = id(n) in path
        lines.append(f"{'  ' * depth}{_told(n)}: {_result(n) if not again else '...'}")
        if not again:
            for c in n.to if isinstance(n, Ref) else n.options if isinstance(n, Alt) else n.children():
                walk(c, depth + 1, (*path, id(n)))

    walk(lift(p), 0, ())
    return "\n".join(lines)


def explain(p) -> str:
    """The tree, the tier that runs the pattern, and the regular expression where there is one."""
    from loomtext.functions.columns import tier
    from loomtext.plans.java import is_regular, regex

    p = lift(p)
    return "\n".join([tree(p), f"tier: {tier(p)}", *([f"regex: {regex(p)}"] if is_regular(p) else [])])
