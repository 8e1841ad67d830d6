"""Grammars of whole small languages, built from the patterns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.patterns import horizontal_space_maybe, newline, space_maybe, word
from loomtext.plans import classes as C
from loomtext.plans.build import (
    Blank, Grammar, after, caseless, at_end, char_in, char_not_in, either, flat, integer_base, join, number, opt, raw, rep, rep1, rep_until, seq, text,
    trim, Read, Whole,
)
from loomtext.plans.nodes import Alt, Char, Const, Node, Text, Wrap, as_type

FRACTION = "struct<num:bigint,den:bigint>"


def arithmetic() -> Node:
    """Sums, products and brackets of whole numbers, evaluated exactly: struct<num, den>; null on division by zero."""
    g = Grammar()
    sum_ = g.ref("sum")
    one = either(Text(rep1(Char(C.DIGIT))).map(Fraction), seq(Blank(Const("(")), sum_, Blank(Const(")")))[0])

    def folded(found):
        (_, value), *rest = found
        for sign, x in rest:
            if value is None or x is None or sign == "/" and not x:
                return None
            value = value + x if sign == "+" else value - x if sign == "-" else value * x if sign == "*" else value / x
        return value

    product = join(trim(one), char_in("*/"), 1, infix="prefix").map(folded)
    g["sum"] = join(product, char_in("+-"), 1, infix="prefix").map(folded)
    whole = seq(sum_, at_end)[0]
    return whole.map(lambda v: None if v is None else {"num": v.numerator, "den": v.denominator}, FRACTION)


def _not_json(name: str):
    raise ValueError(name)


_JSON, _PAIRS = (json.JSONDecoder(strict=False, parse_constant=_not_json, object_pairs_hook=hook) for hook in (None, list))
_HALVES = re.compile(r"\\u[dD][89a-fA-F]|[\ud800-\udfff]")


def _read_json(said: str):
    """What the grammar makes of most JSON texts, by Python's reader, which takes no text that the grammar does not."""
    if ("\\u" in said or not said.isascii()) and _HALVES.search(said):
        json.dumps(_PAIRS.decode(said), ensure_ascii=False).encode()  # raises at half a character, which the grammar does not take
    return _JSON.decode(said)


def json_value() -> Node:
    """Any JSON text, as a Python value (JSON text again in a string column)."""
    g = Grammar()
    value = g.ref("value")
    escape = seq(Blank(Const("\\")), either(
        Const('"'), Const("\\"), Const("/"), Const("b") >> "\b", Const("f") >> "\f", Const("n") >> "\n", Const("r") >> "\r", Const("t") >> "\t",
        seq(Blank(Const("u")), text(rep(Char(C.HEX), 4, 4)))[0].map(lambda h: chr(int(h, 16))),
    ))[0]
    quoted = seq(Blank(Const('"')), rep(either(char_not_in('"\\'), escape)).map("".join), Blank(Const('"')))[0]
    quoted = quoted.map(lambda s: s.encode("utf-16", "surrogatepass").decode("utf-16"), "string")
    digits = rep1(Char(C.DIGIT))
    figure = Text(flat(opt(Const("-")), digits, opt(flat(Const("."), digits)), opt(flat(char_in("eE"), opt(char_in("+-")), digits))))
    figure = figure.map(lambda s: float(s) if set(s) & set(".eE") else int(s))
    gap = lambda p: trim(p, space_maybe, space_maybe)
    comma, colon = Const(","), Const(":")
    array = seq(Blank(Const("[")), Blank(space_maybe), join(gap(value), comma), Blank(Const("]")))[0]
    pair = seq(gap(quoted), Blank(colon), gap(value))
    table = seq(Blank(Const("{")), Blank(space_maybe), join(pair, comma).map(dict), Blank(Const("}")))[0]
    g["value"] = Alt([table, array, quoted, figure, Const("true") >> True, Const("false") >> False, Const("null").map(lambda _: None)], [None] * 7, T.StringType())
    return Read(seq(gap(value), at_end)[0], _read_json)


def json_at(path: str, kind: str) -> Node:
    """The value at a path (``$.a[0].b``) of whole JSON texts, by Spark's own reader and its Variant type; null where it is not there, or
    not of the type.  Spark takes a text that gives a key twice for no JSON."""
    column = lambda c: F.try_variant_get(F.try_parse_json(c), path, kind)
    steps = [int(x[1:-1]) if x[0] == "[" else x.strip(".") for x in re.findall(r"\[[0-9]+\]|\.[^.\[]+", path)]

    def walked(value):
        for step in steps:
            if not (isinstance(value, dict) and step in value or isinstance(value, list) and isinstance(step, int) and step < len(value)):
                return None
            value = value[step]
        return value

    return Whole(json_value().map(walked, kind), column, as_type(kind))


def bson_document() -> Node:
    """A BSON document of doubles, strings, documents, arrays, binaries, booleans, dates, nulls and integers: list of (key, value)."""
    g = Grammar()
    document = g.ref("document")
    name = rep_until(raw(1), b"\0").map(lambda bs: b"".join(bs).decode())
    sized = lambda extra=0: after(raw(4, "i"), lambda n: raw(max(0, n + extra)))
    string = seq(sized(-1), Blank(Const(b"\0")))[0].map(lambda b: b.decode())
    kinds = {
        b"\x01": raw(8, "d"), b"\x02": string, b"\x03": document, b"\x04": document.map(lambda kv: [v for _, v in kv]),
        b"\x05": after(raw(4, "i"), lambda n: seq(Blank(raw(1)), raw(n))[0]).map(lambda b: b.hex()), b"\x08": raw(1, "?"), b"\x09": raw(8, "q"),
        b"\x0a": Const(b"").map(lambda _: None), b"\x10": raw(4, "i"), b"\x12": raw(8, "q"),
    }
    element = either(*[seq(Blank(Const(k)), name, v) for k, v in kinds.items()], result="string")
    g["document"] = seq(Blank(raw(4, "i")), rep(element), Blank(Const(b"\0")))[0]
    return document


def number_ranges() -> Node:
    """``[1-3,9]`` (brackets optional) as the numbers 1, 2, 3, 9."""
    figure = number()
    span = seq(figure, Blank(Const("-")), figure).map(lambda ab: list(range(ab[0], ab[1] + 1)), "array<bigint>")
    item = either(span, figure.map(lambda n: [n], "array<bigint>"))
    return seq(Blank(opt(Const("["))), join(trim(item), Const(","), 1), Blank(opt(Const("]"))))[0].map(lambda xs: [n for x in xs for n in x], "array<bigint>")


def people() -> Node:
    """Persons and their addresses, one block after another: ``Lastname, Name`` or ``Name Lastname``, after a label or none, and
    lines ``Street 1, 12345 City``, after a line with a label or none."""
    name, gap = text(rep1(Char(C.Category("L") | C.chars("-")))), Blank(horizontal_space_maybe)
    label = lambda word: Blank(opt(seq(caseless(Const(word)), ":", horizontal_space_maybe)))
    ordered = seq(lastname=name, name=seq(Blank(Const(",")), gap, name)[0])
    turned = seq(name, Blank(Const(" ")), gap, name).map(lambda x: {"lastname": x[1], "name": x[0]}, ordered.kind())
    person = seq(label("name"), either(ordered, turned, result=ordered.kind()))[0]
    street = Text(join(name, Const(" "), 1))
    door = seq(street=street, no=seq(Blank(Const(" ")), number())[0])
    address = seq(door=door, zip=seq(Blank(Const(",")), Blank(horizontal_space_maybe), integer_base(10, 5, 5))[0], city=seq(Blank(Const(" ")), Text(join(name, Const(" "), 1)))[0])
    block = seq(person=person, addresses=rep(seq(Blank(newline), gap, Blank(opt(seq(caseless(Const("address")), ":", opt(newline), horizontal_space_maybe))), address)[0]))
    return join(block, rep1(newline), 1)


def html_attributes() -> Node:
    """``key="value" other='x'`` as a list of (key, value)."""
    key = text(rep1(Char(C.WORD | C.chars("-:"))))
    bare = text(rep1(char_not_in(" \t\n\r\"'<>=")))
    quoted = either(*[seq(Blank(Const(q)), text(rep(char_not_in(q))), Blank(Const(q)))[0] for q in "\"'"], bare)
    return join(seq(key=key, value=opt(seq(Blank(trim(Const("="))), quoted)[0], "")), rep1(Char(C.SPACE)))


def html_element() -> Node:
    """A nested element: (tag, attributes, children), children being texts and elements."""
    g = Grammar()
    element = g.ref("element")

    def inside(head):
        tag, attributes = head
        close = Const(f"</{tag}>")
        content = rep(either(element, text(rep1(char_not_in("<"))), result="string"))
        return seq(content, Blank(close))[0].map(lambda children: (tag, attributes, children))

    attributes = opt(seq(Blank(rep1(Char(C.SPACE))), html_attributes())[0], [])
    opening = seq(Blank(Const("<")), word, attributes, Blank(space_maybe), Blank(Const(">")))
    g["element"] = after(opening, inside)
    return element


@dataclass(frozen=True, eq=False)
class Palindrome(Wrap):
    """A matcher of one's own: palindromes of characters that ``of`` matches, the longest first, around each middle."""

    least: int = 2

    def iterate(self, ctx, at):
        for end in range(ctx.size, at + self.least - 1, -1):
            piece = ctx.text[at:end]
            if piece == piece[::-1] and all(self.of.holds(c) for c in piece):
                yield end, None

    def value(self, ctx, at, end, state):
        return ctx.text[at:end]

    def kind(self):
        return T.StringType()


def palindromes(least: int = 2) -> Node:
    return Palindrome(Char(C.WORD), least)


def length_prefixed(make: Callable[[int], Node] | None = None) -> Node:
    """A number, a colon and as many characters."""
    make = make or (lambda n: text(rep(Char(C.ANY), n, n)))
    return after(seq(number(), Blank(Const(":")))[0], make)


