"""Character classes: sets of code points closed under union, intersection and complement.

A class is kept as a small expression, so that it can be asked in Python and written as a Java class alike.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache


def java_char(c: str) -> str:
    """One character as Java regex text, valid in and out of brackets."""
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


class CharClass:
    def __contains__(self, c: str) -> bool:
        raise NotImplementedError

    def java(self) -> str:
        """What stands inside brackets."""
        raise NotImplementedError

    def __or__(self, other: "CharClass") -> "CharClass":
        return Union((self, other))

    def __and__(self, other: "CharClass") -> "CharClass":
        return Both(self, other)

    def __invert__(self) -> "CharClass":
        return self.inner if isinstance(self, Not) else Not(self)

    def __sub__(self, other: "CharClass") -> "CharClass":
        return Both(self, ~other)


@dataclass(frozen=True)
class Ranges(CharClass):
    """Pairs of first and last characters."""

    pairs: tuple[tuple[str, str], ...]

    def __contains__(self, c):
        return any(a <= c <= b for a, b in self.pairs)

    def java(self):
        return "".join(java_char(a) if a == b else f"{java_char(a)}-{java_char(b)}" for a, b in self.pairs) or "&&[^\\x{0}-\\x{10ffff}]"


@lru_cache(maxsize=1)
def categories() -> frozenset[str]:
    """The names of Unicode's general categories and their groups."""
    own = {unicodedata.category(chr(c)) for c in range(0x110000)}
    return frozenset(own | {x[0] for x in own} | {"L&"})


@dataclass(frozen=True)
class Category(CharClass):
    """A Unicode general category (``L``, ``Lu``, ``L&`` ...)."""

    name: str

    def __contains__(self, c):
        own = unicodedata.category(c)
        return own in ("Ll", "Lu", "Lt") if self.name == "L&" else own.startswith(self.name)

    def java(self):
        return "\\p{Ll}\\p{Lu}\\p{Lt}" if self.name == "L&" else f"\\p{{{self.name}}}"


@dataclass(frozen=True)
class Union(CharClass):
    parts: tuple[CharClass, ...]

    def __contains__(self, c):
        return any(c in p for p in self.parts)

    def java(self):
        return "".join(p.java() if isinstance(p, (Ranges, Category)) else f"[{p.java()}]" for p in self.parts)


@dataclass(frozen=True)
class Both(CharClass):
    one: CharClass
    two: CharClass

    def __contains__(self, c):
        return c in self.one and c in self.two

    def java(self):
        return f"[{self.one.java()}]&&[{self.two.java()}]"


@dataclass(frozen=True)
class Not(CharClass):
    inner: CharClass

    def __contains__(self, c):
        return c not in self.inner

    def java(self):
        return f"^[{self.inner.java()}]" if isinstance(self.inner, (Both, Not)) else f"^{self.inner.java()}"


@dataclass(frozen=True)
class Caseless(CharClass):
    """Holds a character if it holds any case of it."""

    inner: CharClass

    def __contains__(self, c):
        return c in self.inner or any(len(x) == 1 and x in self.inner for x in (c.lower(), c.upper(), c.title()))

    def java(self):
        raise TypeError("case is for the emitter's flags")


@dataclass(frozen=True)
class Predicate(CharClass):
    """Any Python test of one character; never regular."""

    test: object

    def __contains__(self, c):
        return bool(self.test(c))

    def java(self):
        raise TypeError("a predicate has no regex")


def chars(*items: object) -> CharClass:
    """A class from characters, strings of them, ``(first, last)`` pairs, sets, classes and predicates."""
    pairs: list[tuple[str, str]] = []
    parts: list[CharClass] = []
    for x in items:
        if isinstance(x, CharClass):
            parts.append(x)
        elif isinstance(x, str):
            pairs += [(c, c) for c in x]
        elif isinstance(x, tuple):
            pairs.append((x[0], x[1]))
        elif isinstance(x, (set, frozenset, list)):
            parts.append(chars(*sorted(x)))
        elif callable(x):
            parts.append(Predicate(x))
        else:
            raise TypeError(f"no character class from {x!r}")
    if pairs or not parts:
        parts.insert(0, Ranges(tuple(merged(pairs))))
    return parts[0] if len(parts) == 1 else Union(tuple(parts))


def merged(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Sorted pairs, with those that touch joined."""
    out: list[tuple[str, str]] = []
    for a, b in sorted(pairs):
        if out and ord(a) <= ord(out[-1][1]) + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: The white space of each kind, line ends, and the POSIX classes.
HORIZONTAL = chars("\t   ᠎  　", (" ", " "))
VERTICAL = chars("\n\x0b\x0c\r\x85  ")
SPACE = HORIZONTAL | VERTICAL
INLINE_SPACE = chars(" \t\x85‎‏  \x0b\x0c")
DIGIT = chars(("0", "9"))
HEX = chars(("0", "9"), ("A", "F"), ("a", "f"))
WORD = Category("L") | Category("N") | chars("_")
ANY = ~chars()
POSIX = {
    "alnum": chars(("0", "9"), ("A", "Z"), ("a", "z")),
    "alpha": chars(("A", "Z"), ("a", "z")),
    "ascii": chars(("\x00", "\x7f")),
    "blank": chars(" \t"),
    "cntrl": chars(("\x00", "\x1f"), "\x7f"),
    "digit": DIGIT,
    "graph": chars(("\x21", "\x7e")),
    "lower": chars(("a", "z")),
    "print": chars(("\x20", "\x7e")),
    "punct": chars(("\x21", "\x2f"), ("\x3a", "\x40"), ("\x5b", "\x60"), ("\x7b", "\x7e")),
    "space": chars(" \t\n\x0b\x0c\r"),
    "upper": chars(("A", "Z")),
    "word": chars(("0", "9"), ("A", "Z"), ("a", "z"), "_"),
    "xdigit": HEX,
}
