"""The builder: patterns from Python values and from each other.

    P("Customer#") * number().named("no")

``*`` and ``+`` join patterns and flatten; ``|`` is an ordered choice (with a value that is no pattern: an option
with that default); ``~p`` is the matched text; ``p >> value`` a constant result; ``p[i]`` and ``p["name"]`` a part of the
result; ``a / b`` is ``b`` where ``a`` ends just before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

from loomtext.plans import classes as C
from loomtext.plans.nodes import (
    MANY, Again, Alt, At, Atomic, Bytes, Cap, Char, Const, Constant, Date, Effect, Filter, Look, Map, Mapped, Memo, Named,
    Node, Number, Opt, Range, Ref, Rep, Seq, Text, Then, Words, Wrap, as_type,
)

any_char = Char(C.ANY)
always, never = At("always"), At("never")
at_start, at_end = At("start"), At("end")


def lift(x) -> Node:
    """A pattern from a pattern, a literal, a class, a range of characters, or a ``(pattern, value)`` pair."""
    if isinstance(x, Node):
        return x
    if isinstance(x, (str, bytes)):
        return Const(x)
    if isinstance(x, C.CharClass):
        return Char(x)
    if isinstance(x, (set, frozenset)):
        return Char(C.chars(x))
    if isinstance(x, tuple) and len(x) == 2:
        return Constant(lift(x[0]), x[1])
    if isinstance(x, dict):
        return either(*[Constant(Const(k), v) for k, v in sorted(x.items(), key=lambda kv: (-len(kv[0]), kv[0]))])
    if isinstance(x, list):
        return words(x)
    raise TypeError(f"no pattern from {x!r}")


P = lift


def char_in(*items) -> Char:
    return Char(C.chars(*items))


def char_not_in(*items) -> Char:
    return Char(~C.chars(*items))


def unicode(*names: str) -> Char:
    """One character of any of the general categories."""
    return Char(C.chars(*[C.Category(n) for n in names]))


def both(a: Char, b: Char) -> Char:
    return Char(a.of & b.of)


def without(a: Char, b: Char) -> Char:
    return Char(a.of - b.of)


def seq(*parts, **named) -> Seq:
    """A sequence; keyword parts and named patterns make a struct, else a tuple."""
    every = [*((None, lift(p)) for p in parts), *((n, lift(p)) for n, p in named.items())]
    names = [n or (p.name if isinstance(p, Named) else None) for n, p in every]
    return Seq(tuple(p for _, p in every), tuple(names))


def flat(*parts) -> Seq:
    """A sequence in which sequences dissolve and empty successes vanish."""
    out, names = [], []
    for p in map(lift, parts):
        if isinstance(p, At) and p.what == "always":
            continue
        if isinstance(p, Seq):
            out += p.parts
            names += p.names
        else:
            out.append(p)
            names.append(p.name if isinstance(p, Named) else None)
    return Seq(tuple(out), tuple(names))


def spaced(*parts) -> Seq:
    """A sequence with optional white space between parts; the spaces leave no result."""
    gap = Blank(Rep(Char(C.SPACE)))
    out = [x for p in parts for x in (gap, lift(p))][1:]
    return Seq(tuple(out), tuple(p.name if isinstance(p, Named) else None for p in out))


@dataclass(frozen=True, eq=False)
class Blank(Wrap):
    """Matches as its child does and leaves no result."""

    def value(self, ctx, at, end, state):
        return None

    def kind(self):
        return None


def either(*options, result=None, convert: bool = False, **named) -> Alt:
    every = [*((None, lift(p)) for p in options), *((n, lift(p)) for n, p in named.items())]
    names = [n or (p.name if isinstance(p, Named) else None) for n, p in every]
    return Alt([p for _, p in every], names, as_type(result), convert)


def choice(a, b) -> Node:
    """``a | b``: characters make a class, choices one choice, and a value that is no pattern a default."""
    if not isinstance(a, Node) or not isinstance(b, Node):
        try:
            a, b = lift(a), lift(b)
        except TypeError:
            return Opt(a, b) if isinstance(a, Node) else Opt(b, a, lazy=True)
    one = lambda p: Char(C.chars(p.text)) if isinstance(p, Const) and isinstance(p.text, str) and len(p.text) == 1 else p
    a, b = one(a), one(b)
    if isinstance(a, Char) and isinstance(b, Char) and not (a.caseless or b.caseless):
        return Char(a.of | b.of)
    options = [*(a.options if isinstance(a, Alt) and a.result is None else [a]), *(b.options if isinstance(b, Alt) and b.result is None else [b])]
    return either(*options)


def rep(p, least: int = 0, most: int = MANY, f: Callable | None = None, kind=None) -> Node:
    out = Rep(lift(p), least, most)
    return out.map(f, kind) if f else out


def rep1(p, most: int = MANY, f: Callable | None = None, kind=None) -> Node:
    return rep(p, 1, most, f, kind)


def opt(p, default=None, f: Callable | None = None, kind=None) -> Node:
    """Zero or one; left out, the default is the type's own (empty text or list) unless given."""
    p = lift(p)
    if f:
        p = p.map(f, kind)
    return Opt(p, empty(p.kind()) if default is None else default)


def empty(kind):
    return "" if isinstance(kind, T.StringType) else [] if isinstance(kind, T.ArrayType) else b"" if isinstance(kind, T.BinaryType) else None


def lazy(p: Rep | Opt) -> Node:
    return replace(p, lazy=True)


def atomic(p) -> Atomic:
    return Atomic(lift(p))


def rep_stop(p, stop, least: int = 0) -> Rep:
    """``p`` again and again, each time only where ``stop`` does not match."""
    return Rep(Pick0(Seq((Look(lift(stop), wanted=False), lift(p)), (None, None))), least)


@dataclass(frozen=True, eq=False)
class Pick0(Wrap):
    """The first result of a sequence."""

    def value(self, ctx, at, end, state):
        return self.of.value(ctx, at, end, state)[0]

    def kind(self):
        return self.of.kind().fields[0].dataType


def rep_until(p, until, with_until: bool = False, text: bool = False) -> Node:
    """``p`` until ``until``, which is matched too; the repetition is atomic.  ``text``: its text, not its list."""
    body = Atomic(rep_stop(p, until))
    both_parts = Seq((Text(body) if text else body, lift(until)), (None, None))
    return both_parts if with_until else both_parts[0]


def join(p, delimiter, least: int = 0, most: int = MANY, infix: str = "skip") -> Node:
    """A delimited list.  ``prefix``/``suffix``: each item with the delimiter before/after it (null at the edge)."""
    p, d = lift(p), lift(delimiter)
    if infix == "skip":
        rest = Rep(Seq((Blank(d), p), (None, None)), max(0, least - 1), most - 1)
    else:
        rest = Rep(Seq((d, p), (None, None)), max(0, least - 1), most - 1)
    item, sign = p.kind() or T.StringType(), d.kind() or T.StringType()

    def joined(found):
        first, others = found
        if infix == "skip":
            return [first, *(x[0] for x in others)]
        if infix == "prefix":
            return [(None, first), *others]
        return [*((x, s) for x, s in zip([first, *(y for _, y in others)], [s for s, _ in others], strict=False)), ((others[-1][1] if others else first), None)]

    kinds = {"skip": item, "prefix": T.StructType().add("_1", sign).add("_2", item), "suffix": T.StructType().add("_1", item).add("_2", sign)}
    out = Joined(Map(Seq((p, rest), (None, None)), joined, T.ArrayType(kinds[infix])), p, d, infix)
    return Opt(out, []) if least == 0 else out


@dataclass(frozen=True, eq=False)
class Joined(Wrap):
    """Remembers what a list is made of, so that it can be split by Spark itself."""

    item: Node = None
    delimiter: Node = None
    infix: str = "skip"


def words(items: list[str] | dict, kind=None) -> Words:
    """Greedy dictionary: the longest word, then its prefixes.  A dict maps words to results of the type ``kind``."""
    return Words.of(items, as_type(kind) or T._infer_type(next(iter(items.values()))) if isinstance(items, dict) and items else None)


def caseless(p) -> Node:
    """Literals, classes and dictionaries of ``p`` in any case."""

    def fold(n: Node) -> Node:
        if isinstance(n, Words):
            return either(*[Const(w, True) if n.kinds is None else Constant(Const(w, True), v) for w, v in sorted(n.words().items(), key=lambda x: (-len(x[0]), x[0]))])
        return replace(n, caseless=True) if isinstance(n, (Const, Char)) else n

    return rewritten(lift(p), fold)


def mapped(f: Callable[[str], str], p) -> Mapped:
    return Mapped(lift(p), f)


def rewritten(p: Node, f: Callable[[Node], Node], seen: dict | None = None) -> Node:
    """``f`` of every node, children first; shared and recursive nodes once."""
    seen = {} if seen is None else seen
    if id(p) in seen:
        return seen[id(p)]
    if isinstance(p, Ref):
        out = seen[id(p)] = replace(p, to=[])
        if p.to:
            out.to[:] = [rewritten(p.to[0], f, seen)]
        return out
    if isinstance(p, Alt):  # may hold itself
        out = seen[id(p)] = replace(p, options=[])
        out.options[:] = [rewritten(c, f, seen) for c in p.options]
        made = f(out)
        seen[id(p)] = made
        return made
    children = p.children()
    out = p.rebuilt(tuple(rewritten(c, f, seen) for c in children)) if children else p
    made = seen[id(p)] = f(out)
    return made


def map_deep(f: Callable, p, which, kind=None) -> Node:
    """``f`` over the result of every part that ``which`` picks: a name, a node type, or a test of nodes."""
    test = (lambda n: isinstance(n, Named) and n.name == which) if isinstance(which, str) else (lambda n: isinstance(n, which)) if isinstance(which, type) else which
    return rewritten(lift(p), lambda n: (Named(Map(n, f, as_type(kind)), n.name) if isinstance(n, Named) else Map(n, f, as_type(kind))) if test(n) else n)


def strip_single(p) -> Node:
    """Choices of one option give way to it."""
    return rewritten(lift(p), lambda n: n.options[0] if isinstance(n, Alt) and len(n.options) == 1 and n.result is None else n)


def without_effects(p) -> Node:
    return rewritten(lift(p), lambda n: n.of if isinstance(n, Effect) else n)


def backwards(p) -> Node:
    """The pattern of the reversed text."""

    def turn(n: Node) -> Node:
        if isinstance(n, Const):
            return replace(n, text=n.text[::-1])
        if isinstance(n, Words):
            return Words.of({w[::-1]: w[::-1] if n.kinds is None else v for w, v in n.words().items()}, n.kinds)
        if isinstance(n, Seq):
            return replace(n, parts=n.parts[::-1], names=n.names[::-1])
        if isinstance(n, Look):
            return replace(n, ahead=not n.ahead)
        if isinstance(n, At):
            return At({"start": "end", "end": "start", "linestart": "lineend", "lineend": "linestart"}.get(n.what, n.what))
        return n

    return rewritten(lift(p), turn)


def look(p, ahead: bool = True, wanted: bool = True) -> Look:
    return Look(lift(p), ahead, wanted)


def text(p) -> Text:
    return Text(lift(p))


def matched_range(p) -> Range:
    return Range(lift(p))


def capture(p, name: str | None = None) -> Cap:
    return Cap(lift(p), 0, name)


def reparsed(p, inner) -> Again:
    return Again(lift(p), lift(inner))


def after(p, make: Callable, kind=None) -> Then:
    """A pattern made from the result of ``p``, at its end."""
    return Then(lift(p), make, as_type(kind))


def where(p, test: Callable) -> Filter:
    """``test(text, start, end)`` of each way."""
    return Filter(lift(p), test)


def where_result(p, test: Callable) -> Filter:
    return Filter(lift(p), test, True)


def memo(p) -> Memo:
    return Memo(lift(p))


def effect(p, f: Callable | None = None, name: str = "") -> Effect:
    p = lift(p)
    return Effect(p, f, name or (p.name if isinstance(p, Named) else ""))


def traced(p) -> Node:
    """Every named part tells its matches to the context's trace."""
    return rewritten(lift(p), lambda n: Effect(n, None, n.name) if isinstance(n, Named) else n)


def number(kind="bigint") -> Number:
    """A signed decimal number of the type."""
    kind = as_type(kind)
    sign, digits = Opt(char_in("+-"), ""), Rep(Char(C.DIGIT), 1)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        return Number(Seq((sign, digits), (None, None)), kind)
    some = either(Seq((digits, Opt(Seq((Const("."), Rep(Char(C.DIGIT))), (None, None)), None)), (None, None)), Seq((Const("."), digits), (None, None)))
    exponent = Opt(Seq((char_in("eE"), sign, digits), (None, None, None)), None)
    return Number(Seq((sign, some, exponent), (None, None, None)), kind)


def integer_base(base: int = 10, least: int = 0, most: int = MANY) -> Number:
    """A whole number in a base up to ten or sixteen; no digits are 0."""
    if not 2 <= base <= 10 and base != 16:
        raise ValueError("bases are 2 to 10 and 16")
    digit = Char(C.HEX) if base == 16 else char_in(("0", str(base - 1)))
    return Number(Rep(digit, least, most), T.LongType(), base, 0)


#: What stands for each strptime code in a regex.
#: Formats of these codes alone are read by Spark itself, the codes' values by name.
FIELDS = {"%Y": r"(?!0000)[0-9]{4}", "%m": "(?:1[0-2]|0?[1-9])", "%d": "(?:3[01]|[12][0-9]|0?[1-9])", "%H": "(?:2[0-3]|1[0-9]|0?[0-9])", "%M": "(?:[1-5][0-9]|0?[0-9])", "%S": "(?:[1-5][0-9]|0?[0-9])"}
_CODES = {"%Y": (4, 4), "%m": (1, 2), "%d": (1, 2), "%H": (1, 2), "%M": (1, 2), "%S": (1, 2), "%y": (2, 2), "%f": (1, 6)}


def date(*formats: str, time: bool = False) -> Date:
    """A date in any of the strptime formats (numeric codes, ``%b`` and ``%B``)."""
    formats = formats or ("%Y-%m-%d",)

    def shape(f: str) -> Node:
        parts, at = [], 0
        while at < len(f):
            code = f[at : at + 2]
            if code in _CODES:
                parts.append(Rep(Char(C.DIGIT), *_CODES[code]))
            elif code in ("%b", "%B"):
                parts.append(Rep(Char(C.Category("L")), 3, 12))
            else:
                parts.append(Const(f[at]))
                at -= 1
            at += 2
        return Text(Seq(tuple(parts), (None,) * len(parts)))

    return Date(either(*[shape(f) for f in formats]), formats, time)


def trim(p, left=None, right=None, space: C.CharClass = C.HORIZONTAL) -> Node:
    """``p`` with optional white space around it; the result is that of ``p``."""
    gap = Rep(Char(space))
    return Seq((Blank(lift(left) if left is not None else gap), lift(p), Blank(lift(right) if right is not None else gap)), (None, None, None))[0]


def raw(width: int, code: str = "s", big: bool = False) -> Bytes:
    return Bytes(width, code, big)


class Grammar:
    """Names and their patterns; ``ref`` may come before ``set``."""

    def __init__(self):
        self.refs: dict[str, Ref] = {}

    def ref(self, name: str, kind=None) -> Ref:
        return self.refs.setdefault(name, Ref(name, [], as_type(kind)))

    __getitem__ = ref

    def __setitem__(self, name: str, p) -> None:
        self.ref(name).set(p)

    def rule(self, f: Callable) -> Ref:
        """Decorator: the function's name and the pattern it returns."""
        self[f.__name__] = f()
        return self.refs[f.__name__]

    def resolved(self, p) -> Node:
        """``p`` with every reference of this grammar filled in; unknown names raise."""
        for r in self.refs.values():
            r.target  # noqa: B018  raises for a name without a pattern
        return rewritten(lift(p), lambda n: n)




@dataclass(frozen=True, eq=False)
class Whole(Wrap):
    """A pattern of whole texts that Spark has a function of its own for: ``column`` makes the result of the text's column."""

    column: Callable = None
    result: T.DataType | None = None

    def kind(self):
        return self.result or self.of.kind()


@dataclass(frozen=True, eq=False)
class Read(Wrap):
    """A pattern that ends with the text, and a function that reads most such texts sooner.

    ``read`` gives the result of the rest of a text, or raises ValueError or RecursionError where the pattern is to decide.  It gives way
    to the pattern for good once the pattern is rewritten to another one.
    """

    read: Callable = None

    def rebuilt(self, children):
        return replace(self, of=children[0]) if alike(self.of, children[0]) else children[0]

    def iterate(self, ctx, at):
        try:
            told = _Told(self.read(ctx.text[at:]))
        except (ValueError, RecursionError):
            yield from self.of.iterate(ctx, at)
            return
        yield ctx.size, told
        ways = self.of.iterate(ctx, at)
        next(ways, None)  # the same way as that just told
        yield from ways

    def value(self, ctx, at, end, state):
        return state.value if isinstance(state, _Told) else self.of.value(ctx, at, end, state)


@dataclass(frozen=True)
class _Told:
    value: object


def alike(a, b, met: set | None = None) -> bool:
    """Whether two patterns are the same, node by node."""
    met = set() if met is None else met
    if a is b or (id(a), id(b)) in met:
        return True
    met.add((id(a), id(b)))
    if isinstance(a, Node):
        return type(a) is type(b) and all(alike(getattr(a, f.name), getattr(b, f.name), met) for f in fields(a))
    if isinstance(a, (tuple, list)):
        return type(a) is type(b) and len(a) == len(b) and all(alike(x, y, met) for x, y in zip(a, b, strict=True))
    return type(a) is type(b) and a == b
