"""Patterns from EBNF text: ``rule = definition ;`` one after another.

Terminals stand in single or double quotes; names may hold spaces; ``n * x`` is n times, ``n * m x`` n to m times;
``,`` joins; ``|``, ``/`` and ``!`` are choices; ``[ ]`` and ``(/ /)`` are optional, ``{ }`` and ``(: :)`` repeat,
``( )`` groups; ``(* *)`` is a comment; ``? ?`` never matches.  An exception (``a - b``) raises ``Unsupported``; so does
left recursion, which could not end.
"""

from __future__ import annotations

import re

from loomtext.plans.java import no_left_recursion
from loomtext.plans.nodes import Alt, At, Const, Named, Node, Opt, Ref, Rep, Seq, Text, Unsupported
from loomtext.plans.build import Grammar

#: What opens a bracket, what closes it.
BRACKETS = {"(/": "/)", "(:": ":)", "(": ")", "[": "]", "{": "}"}
_TOKEN = re.compile(r"""\s+|\(\*.*?\*\)|(?P<text>'[^']*'|"[^"]*")|(?P<special>\?[^?]*\?)|(?P<mark>\(/|/\)|\(:|:\)|[()\[\]{}=;,|/!*-])|(?P<int>[0-9]+)|(?P<name>[A-Za-z_][\w ]*\w|[A-Za-z_])""", re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no EBNF at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, re.sub(r"\s+", " ", m[0]) if m.lastgroup == "name" else m[0]))
    return out


class _Rules:
    def __init__(self, text: str):
        self.tokens, self.at, self.grammar = tokens(text), 0, Grammar()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind == "mark" and text in texts:
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ValueError(f"{text!r} is missing before {self.peek()[1]!r}")

    def rules(self) -> dict[str, Ref]:
        names = []
        while self.at < len(self.tokens):
            kind, name = self.peek()
            if kind != "name":
                raise ValueError(f"a rule cannot begin with {name!r}")
            self.at += 1
            self.need("=")
            self.grammar[name] = Named(self.choice(), name)
            self.need(";")
            names.append(name)
        for n in names:
            no_left_recursion(self.grammar.refs[n])
        return {n: self.grammar.refs[n] for n in names}

    def choice(self) -> Node:
        options = [self.joined()]
        while self.take("|", "/", "!"):
            options.append(self.joined())
        return options[0] if len(options) == 1 else Alt(options, [None] * len(options))

    def joined(self) -> Node:
        parts = [self.term()]
        while self.take(","):
            parts.append(self.term())
        return parts[0] if len(parts) == 1 else Seq(tuple(parts), (None,) * len(parts))

    def term(self) -> Node:
        out = self.factor()
        if self.take("-"):
            raise Unsupported("an exception in EBNF")
        return out

    def factor(self) -> Node:
        kind, text = self.peek()
        if kind == "int":
            self.at += 1
            self.need("*")
            least = most = int(text)
            kind, text = self.peek()
            if kind == "int":
                self.at += 1
                most = int(text)
            return Rep(self.primary(), least, most)
        return self.primary()

    def primary(self) -> Node:
        kind, text = self.peek()
        self.at += 1
        if kind == "text":
            return Const(text[1:-1])
        if kind == "special":
            return At("never")
        if kind == "name":
            return self.grammar.ref(text)
        if text in BRACKETS:
            inner = self.choice()
            self.need(BRACKETS[text])
            return Opt(inner) if text in ("[", "(/") else Rep(inner) if text in ("{", "(:") else inner
        raise ValueError(f"no EBNF at {text!r}")


def ebnf(text: str) -> dict[str, Ref]:
    """The rules by name; their results are lists and tuples of the matched terminals."""
    return _Rules(text).rules()


def ebnf_text(text: str, rule: str) -> Text:
    """One rule, with the matched text as its result."""
    return Text(ebnf(text)[rule])
