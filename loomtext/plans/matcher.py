"""Running a pattern on one text: parse, match, all matches, all parses.

``parse`` is held to the start and need not take the whole text; ``match`` searches.  ``match_all`` gives every way at
every position: after a match it goes on with the next way at the same place, and then with the next character, so
matches overlap.  ``parse_all`` gives every way at one place, the preferred ones first.  Positions count characters
from 1.  A capture that took no part is null, not empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from loomtext.plans.build import rewritten
from loomtext.plans.nodes import Cap, Context, Node
from loomtext.sources.pcre import Regex

BUDGET = 5_000_000


class PartialMatch(ValueError):
    """A text that the pattern does not match: the furthest place that any way reached, and the text around it."""

    def __init__(self, at: int, text):
        self.index, self.excerpt = at + 1, text[max(0, at - 20) : at + 20]
        super().__init__(f"no match at {at + 1}: {self.excerpt!r}")


@dataclass(frozen=True)
class Program:
    """A pattern with numbered captures."""

    node: Node
    groups: int = 0
    names: dict | None = None
    budget: int | None = BUDGET

    def context(self, text) -> Context:
        return Context(text, self.groups, self.budget, self.names)

    def ways(self, text, at: int = 0, ctx: Context | None = None) -> Iterator[tuple[Context, int, Any]]:
        ctx = ctx or self.context(text)
        for end, state in self.node.iterate(ctx, at):
            yield ctx, end, state

    def parse(self, text, at: int = 0):
        """The result at ``at``; raises PartialMatch."""
        ctx = self.context(text)
        for _, end, state in self.ways(text, at, ctx):
            return self.node.value(ctx, at, end, state)
        raise PartialMatch(max(at, ctx.far), text)

    def attempt(self, text, at: int = 0) -> tuple[bool, Any]:
        """(whether it matches at ``at``, the result), in one pass."""
        for ctx, end, state in self.ways(text, at):
            return True, self.node.value(ctx, at, end, state)
        return False, None

    def reached(self, text) -> int | None:
        """The position (from 1) of the furthest character that no way could take; None where the text matches."""
        ctx = self.context(text)
        for _ in self.ways(text, 0, ctx):
            return None
        return ctx.far + 1

    def try_parse(self, text, at: int = 0, sentinel=None):
        try:
            return self.parse(text, at)
        except PartialMatch:
            return sentinel

    def try_parse_at(self, text, at: int = 0):
        """(result, position after it), or None."""
        for ctx, end, state in self.ways(text, at):
            return self.node.value(ctx, at, end, state), end + 1
        return None

    def parse_all(self, text, at: int = 0) -> Iterator[Any]:
        for ctx, end, state in self.ways(text, at):
            yield self.node.value(ctx, at, end, state)

    def record(self, ctx: Context, at: int, end: int) -> dict:
        """A match: its text, first position, position after it, and captures by number and name."""
        by_index = {g: n for n, gs in (self.names or {}).items() for g in gs}
        captures = []
        for g in range(1, self.groups + 1):
            a, b = ctx.groups[g] or (None, None)
            captures.append({"idx": g, "name": by_index.get(g), "text": None if a is None else ctx.text[a:b], "start": None if a is None else a + 1, "stop": b})
        return {"match": ctx.text[at:end], "offset": at + 1, "after": end + 1, "captures": captures}

    def match_all(self, text, start: int = 1, stop: int | None = None) -> Iterator[dict]:
        """All matches that begin from ``start`` to ``stop`` (the end, the place after the last character too)."""
        ctx = self.context(text)
        for at in range(start - 1, (len(text) + 1 if stop is None else stop)):
            ctx.memo.clear()
            ctx.groups[:] = [None] * (self.groups + 1)
            for _, end, _ in self.ways(text, at, ctx):
                yield self.record(ctx, at, end)

    def match(self, text, start: int = 1) -> dict | None:
        return next(self.match_all(text, start), None)


def compiled(p: Node, budget: int | None = BUDGET) -> Program:
    """Numbers the captures that have no number yet (in order), and keeps those that have one."""
    if isinstance(p, Program):
        return p
    if isinstance(p, Regex):
        return Program(p, p.groups, p.names, budget)
    count, names = 0, {}
    numbered: dict[int, int] = {}

    def settle(n: Node) -> Node:
        nonlocal count
        if isinstance(n, Cap):
            if not n.index:
                count += 1
                n = replace(n, index=count)
            count = max(count, n.index)
            numbered[n.index] = n.index
            if n.name and n.index not in names.get(n.name, ()):
                names[n.name] = (*names.get(n.name, ()), n.index)
        return n

    p = rewritten(p, settle)
    return Program(p, count, names, budget)


