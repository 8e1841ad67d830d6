"""Patterns as Spark columns.

A regular pattern becomes built-in regular-expression, split and higher-order functions (the plan stays in the JVM and in
generated code); any other runs in Arrow batches, behind a test for the literals that every match must hold.  Both
give the same result; ``tier`` says which one a pattern takes, and ``force`` asks for one.

A null text gives null.  ``parse`` raises on a text that does not match, ``try_parse`` gives null.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.plans import classes as C
from loomtext.plans.build import FIELDS, Blank, Joined, Pick0, Whole, lift
from loomtext.plans.classes import java_char
from loomtext.plans.java import Emitter, is_regular, nullable, recursion_check, regex
from loomtext.plans.matcher import BUDGET, Program, compiled
from loomtext.plans.nodes import (
    Alt, Atomic, Cap, Char, Const, Constant, Date, Effect, Look, Map, Named, Node, NotRegular, Number, Opt, Pick, Ref, Rep,
    Seq, Text, Words, as_type,
)

CAPTURE = "struct<idx:int,name:string,text:string,start:bigint,stop:bigint>"
MATCH = f"struct<match:string,offset:bigint,after:bigint,captures:array<{CAPTURE}>>"


#: Entries of a dictionary with results that are written into the plan; larger ones run in the matcher, or as a join.
MOST_LITERALS = 256


# -- the regular tier -------------------------------------------------------------------------


class _Columns:
    """Finds the parts whose text the result needs, and how the result is made of them."""

    def __init__(self):
        self.marks: dict[int, Node] = {}

    def mark(self, p: Node) -> Callable[[Callable], Column]:
        self.marks[id(p)] = p
        return lambda at: at(p)

    def build(self, p: Node) -> Callable[[Callable], Column] | None:
        """A function of ``at`` (the text of a marked part, '' where it took no part); None: no result."""
        if p.kind() is None:
            return None
        if isinstance(p, (Const, Char, Text)):
            return self.mark(p)
        if isinstance(p, Number):
            own, kind = self.mark(p), p.kind()
            if p.base != 10:
                return lambda at: F.coalesce(F.conv(F.nullif(own(at), F.lit("")), p.base, 10).cast("bigint"), F.lit(p.empty))
            return lambda at: F.coalesce(own(at).try_cast(kind), F.lit(p.empty)) if p.empty is not None else own(at).try_cast(kind)
        if isinstance(p, Words):
            own = self.mark(p)
            if p.kinds is None:
                return own
            known = p.words()
            if not 0 < len(known) <= MOST_LITERALS:
                raise NotRegular("a dictionary with too many results for a literal")
            return lambda at: F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), own(at))
        if isinstance(p, Constant):
            return lambda at: F.lit(p.result)
        if isinstance(p, Pick):
            of = p.of
            if isinstance(of, Seq) and not isinstance(p.which, slice):
                if isinstance(p.which, str):
                    return self.build(of.parts[of.names.index(p.which)])
                return self.build([q for q in of.parts if q.kind() is not None][p.which] if not any(of.names) else of.parts[p.which])
            inner, kind = self.build(of), of.kind()
            if isinstance(p.which, slice) and isinstance(kind, T.StructType):
                return lambda at: F.struct(*[inner(at)[f.name].alias(f"_{i + 1}") for i, f in enumerate(kind.fields[p.which])])
            if isinstance(kind, T.StructType):
                name = p.which if isinstance(p.which, str) else kind.names[p.which]
                return lambda at: inner(at)[name]
            return lambda at: F.get(inner(at), F.lit(p.which)) if p.which >= 0 else F.try_element_at(inner(at), F.lit(p.which))
        if isinstance(p, Seq):
            kind = p.kind()
            chosen = [q for q, n in zip(p.parts, p.names, strict=True) if n] if any(p.names) else [q for q in p.parts if q.kind() is not None]
            parts = [self.build(q) for q in chosen]
            return lambda at: F.struct(*[f(at).alias(n) for f, n in zip(parts, kind.names, strict=True)])
        if isinstance(p, Opt):
            if nullable(p.of):
                raise NotRegular("an empty match and none are the same to a regex")
            inner, own = self.build(p.of), self.mark(p)
            return lambda at: F.when(own(at) != "", inner(at)).otherwise(_literal(p.default, p.kind()))
        if isinstance(p, Alt):
            if p.result is None and all(isinstance(q, (Const, Char, Text)) for q in p.options):
                return self.mark(p)
            if any(nullable(q) for q in p.options) or p.convert or isinstance(kind := p.kind(), T.StructType) and kind.names[:1] == ["tag"]:
                raise NotRegular("options that a regex cannot tell apart")
            raise NotRegular("options with results of their own")
        if isinstance(p, Joined) and isinstance(p.delimiter, Const) and p.infix == "skip":
            inner = _Columns()
            item = inner.build(p.item)
            if item is None or not _apart(p.item, p.delimiter.text):
                raise NotRegular("items that may hold the delimiter")
            own = self.mark(p)
            split = "".join(map(C.java_char, p.delimiter.text))
            return lambda at: F.transform(F.split(own(at), split), lambda x: item(inner.reader(x, p.item)))
        if isinstance(p, Rep):
            if isinstance(p.of, Char):
                own = self.mark(p)
                return lambda at: F.when(own(at) == "", F.array().cast("array<string>")).otherwise(F.split(own(at), ""))
            raise NotRegular("a list of its own")
        if isinstance(p, Map) and p.column is not None:
            inner = self.build(p.of)
            return lambda at: p.column(inner(at))
        if isinstance(p, (Named, Atomic, Effect, Cap)):
            return self.build(p.of)
        if isinstance(p, Ref):
            return self.build(p.target)
        raise NotRegular(type(p).__name__)

    def reader(self, text: Column, whole: Node) -> Callable[[Node], Column]:
        emitter = Emitter(set(self.marks))
        pattern = "\\A" + _grouped(emitter.write(whole))
        # the whole match is a group too, so that one regex serves every part
        return lambda p: F.regexp_extract(text, pattern, emitter.group_of[id(p)])


def _grouped(pattern: str) -> str:
    return f"(?:{pattern})"


def _apart(item: Node, delimiter: str) -> bool:
    """Whether no item's match can hold the delimiter's first character."""
    from loomtext.plans.java import nodes

    for n in nodes(item):
        if isinstance(n, Const) and (not isinstance(n.text, str) or delimiter[0] in n.text):
            return False
        if isinstance(n, Char) and n.holds(delimiter[0]):
            return False
        if not isinstance(n, (Const, Char, Seq, Alt, Rep, Opt, Number, Text, Named, Constant, Atomic, Map, Pick, Cap)):
            return False
    return True


def _literal(value, kind) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    return F.array().cast(kind) if value == [] else F.lit(value)


def _constants(p: Node) -> Node:
    """Choices of constants of literals, as maps from the matched text."""
    from loomtext.plans.build import rewritten

    def settle(n: Node) -> Node:
        if isinstance(n, Alt) and n.result is None and n.options and all(isinstance(q, Constant) and isinstance(q.of, Const) and not q.of.caseless for q in n.options):
            kind, table = n.kind(), {}
            for q in n.options:
                table.setdefault(q.of.text, q.result)
            if isinstance(kind, T.StructType):
                return n
            column = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])
            return Map(Text(Alt([q.of for q in n.options], [None] * len(n.options))), table.__getitem__, kind, column)
        return n

    return rewritten(p, settle)


def _apart_nodes(p: Node) -> Node:
    """A copy in which no node stands twice, so that each place has a group of its own."""
    if isinstance(p, Ref):
        return replace(p, to=[_apart_nodes(c) for c in p.to])
    children = p.children()
    return p.rebuilt(tuple(map(_apart_nodes, children))) if children else replace(p)


def _plan(p: Node) -> tuple[Node, "_Columns", Callable]:
    recursion_check(p)
    p = _apart_nodes(_constants(p))
    plan = _Columns()
    made = plan.build(p)
    if made is None:
        raise NotRegular("no result")
    Emitter(set(plan.marks)).write(p)
    return p, plan, made


def _named(p: Node) -> Node:
    while isinstance(p, Named):
        p = p.of
    return p


def _dates(p: Date) -> Callable[[Column], Column]:
    """A date at the start of a text by its formats, each tried as it stands and with its last figure cut."""

    def read(f: str, column: Column) -> list[Column]:
        codes, parts, at = [], [], 0
        while at < len(f):
            if (code := f[at : at + 2]) in FIELDS and code not in codes:
                codes.append(code)
                parts.append(f"({FIELDS[code]})")
                at += 2
            elif f[at] == "%":
                raise NotRegular("a date's code that Spark reads otherwise")
            else:
                parts.append(java_char(f[at]))
                at += 1
        if not {"%Y", "%m", "%d"} <= set(codes):
            raise NotRegular("a date without year, month or day")
        last = codes[-1] if f.endswith(codes[-1]) else None
        made = []
        for cut in (False, True) if last not in (None, "%Y") else (False,):
            shape = "".join([*parts[:-1], "([0-9])"] if cut else parts)
            value = lambda c, shape=shape: F.regexp_extract(column, "\\A" + shape, codes.index(c) + 1).try_cast("int") if c in codes else F.lit(0)
            found = F.try_make_timestamp_ntz(*map(value, ("%Y", "%m", "%d", "%H", "%M")), value("%S").cast("decimal(16,6)"))
            made.append(F.when(column.rlike("\\A" + shape), found))
        return made

    return lambda column: F.coalesce(*[x for f in p.formats for x in read(f, column)]).cast(p.kind())


def _own_function(p: Node) -> Callable[[Column], Column] | None:
    """How Spark itself reads the pattern at the start of a text, where it has a function for it."""
    p = _named(p)
    if isinstance(p, Whole):
        return p.column
    return _dates(p) if isinstance(p, Date) else None


def regular_column(column: Column, p: Node) -> Column:
    """The result as built-in functions; null where there is no match.  Raises NotRegular."""
    if own := _own_function(p):
        return own(column)
    p, plan, made = _plan(p)
    return F.when(column.rlike("\\A" + _grouped(regex(p))), made(plan.reader(column, p)))


def tier(p) -> str:
    """``regex`` or ``matcher``."""
    try:
        regular_column(F.lit(""), lift(p)) if _own_function(lift(p)) else _plan(lift(p))
    except NotRegular:
        return "matcher"
    return "regex"


# -- the matcher's tier -----------------------------------------------------------------------


def needed(p: Node) -> list[str]:
    """Literals that every match holds."""
    if isinstance(p, Const) and isinstance(p.text, str) and not p.caseless:
        return [p.text] if p.text else []
    if isinstance(p, Seq):
        return [x for q in p.parts for x in needed(q)]
    if isinstance(p, Rep):
        return needed(p.of) if p.least else []
    if isinstance(p, Look):
        return needed(p.of) if p.wanted else []
    if isinstance(p, (Text, Named, Atomic, Cap, Number, Constant, Pick, Map, Blank, Pick0)) and p.children():
        return needed(p.children()[0])
    return []


def plain(value, kind: T.DataType):
    """A result as the kind's Python value: tuples and dicts by field, lists by item; anything else where text is asked, as JSON."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        if isinstance(value, dict):
            return {f.name: plain(value.get(f.name), f.dataType) for f in kind.fields}
        return {f.name: plain(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {plain(k, kind.keyType): plain(v, kind.valueType) for k, v in (value.items() if isinstance(value, dict) else value)}
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False, separators=(",", ":"))
    if isinstance(kind, T.DecimalType):
        return Decimal(value)
    if isinstance(kind, T.BinaryType):
        return bytes(value)
    return value


def _run(program: Program, each: Callable, kind: T.DataType, column: Column, guard: Column | None) -> Column:
    """``each(program, text)`` in Arrow batches; texts that lack a needed literal do not leave the JVM."""
    wrapped = T.StructType([T.StructField("value", kind)])

    @F.pandas_udf(wrapped)
    def go(texts: pd.Series) -> pd.DataFrame:
        out = [None if t is None or isinstance(t, float) else plain(each(program, t), kind) for t in texts]
        return pd.DataFrame({"value": pd.Series(out, dtype=object)})

    return go(column if guard is None else F.when(guard, column))["value"]


def _guard(column: Column, p: Node) -> Column | None:
    found = [x for x in needed(p) if x]
    return F.contains(column, F.lit(max(found, key=len))) if found else None


def try_parse(column, p, kind: T.DataType | str | None = None, force: str | None = None, budget: int | None = BUDGET) -> Column:
    """The pattern's result at the start of the text; null where it does not match."""
    column, p = _column(column), lift(p)
    kind = as_type(kind) or p.kind() or T.BooleanType()
    if force != "matcher":
        try:
            return regular_column(column, p)
        except NotRegular:
            if force == "regex":
                raise
    guard = None if isinstance(p.kind(), T.BinaryType) or _binary(p) else _guard(column, p)
    return _run(compiled(p, budget), lambda program, t: program.try_parse(t), kind, column, guard)


def _binary(p: Node) -> bool:
    from loomtext.plans.java import nodes
    from loomtext.plans.nodes import Bytes

    return any(isinstance(n, Bytes) or isinstance(n, Const) and isinstance(n.text, bytes) for n in nodes(p))


def parse(column, p, kind: T.DataType | str | None = None, force: str | None = None, budget: int | None = BUDGET) -> Column:
    """As ``try_parse``, but a text that does not match ends the query with its excerpt."""
    column, p = _column(column), lift(p)
    wrong = F.raise_error(F.concat(F.lit("no match: "), F.substring(column.cast("string"), 1, 40)))
    if force != "matcher":
        try:
            found = regular_column(column, p)
        except NotRegular:
            if force == "regex":
                raise
        else:
            matched = found.isNotNull() if _own_function(p) else matches(column, p)
            return F.when(column.isNull(), F.lit(None)).when(matched, found).otherwise(wrong)
    kind = as_type(kind) or p.kind() or T.BooleanType()
    both = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", kind)])
    # one call for both: whether it matches, and the result
    told = _run(compiled(p, budget), lambda program, t: program.attempt(t), both, column, None)
    return F.when(column.isNull(), F.lit(None)).when(told["ok"], told["value"]).otherwise(wrong)


def matches(column, p, force: str | None = None) -> Column:
    """Whether the pattern matches at the start."""
    column, p = _column(column), lift(p)
    if force != "matcher" and _own_function(p):
        return F.when(column.isNotNull(), regular_column(column, p).isNotNull())
    if force != "matcher" and is_regular(p):
        return column.rlike("\\A" + _grouped(regex(p)))
    return F.coalesce(_run(compiled(p), lambda program, t: next(program.ways(t), None) is not None, T.BooleanType(), column, None if _binary(p) else _guard(column, p)), F.when(column.isNotNull(), F.lit(False)))


def contains(column, p, force: str | None = None) -> Column:
    """Whether the pattern matches anywhere."""
    column, p = _column(column), lift(p)
    if force != "matcher" and is_regular(p):
        return column.rlike(regex(p))
    return F.coalesce(_run(compiled(p), lambda program, t: program.match(t) is not None, T.BooleanType(), column, _guard(column, p)), F.when(column.isNotNull(), F.lit(False)))


def try_parse_at(column, p, kind: T.DataType | str | None = None) -> Column:
    """struct<value, pos>: the result and the position after it; null where there is no match."""
    column, p = _column(column), lift(p)
    kind = as_type(kind) or p.kind() or T.BooleanType()
    out = T.StructType([T.StructField("value", kind), T.StructField("pos", T.LongType())])
    return _run(compiled(p), lambda program, t: program.try_parse_at(t), out, column, _guard(column, p))


def error_of(column, p) -> Column:
    """struct<index, excerpt> where the pattern does not match at the start, else null.

    ``index``: the position (from 1) of the furthest character that no way of the pattern could take; ``excerpt``: the text's first
    20 characters.  Only texts that do not match leave the JVM, where a regular pattern tells which those are.
    """
    column, p = _column(column), lift(p)
    failed = column if not is_regular(p) else F.when(~column.rlike("\\A" + _grouped(regex(p))), column)
    index = _run(compiled(p), lambda program, t: program.reached(t), T.LongType(), failed, None)
    return F.when(index.isNotNull(), F.struct(index.alias("index"), F.substring(column, 1, 20).alias("excerpt")))


def match(column, p, start: int = 1, force: str | None = None) -> Column:
    """The first match from ``start`` on: struct<match, offset, after, captures>; null where there is none."""
    column, p = _column(column), lift(p)
    program = compiled(p)
    if force != "matcher" and not program.groups and start == 1 and is_regular(p):
        pattern = F.lit(regex(p))
        found, at = F.regexp_substr(column, pattern), F.regexp_instr(column, pattern).cast("bigint")
        none = F.array().cast(f"array<{CAPTURE}>")
        return F.when(found.isNotNull(), F.struct(found.alias("match"), at.alias("offset"), (at + F.length(found)).alias("after"), none.alias("captures")))
    return _run(program, lambda own, t: own.match(t, start), as_type(MATCH), column, _guard(column, p))


def match_all(column, p, start: int = 1, stop: int | None = None) -> Column:
    """All matches, alternative and overlapping ones too, as an array of match records."""
    column, p = _column(column), lift(p)
    return _run(compiled(p), lambda own, t: list(own.match_all(t, start, stop)), T.ArrayType(as_type(MATCH)), column, None)


def match_each(column, p) -> Column:
    """Texts of the leftmost matches that do not overlap."""
    column, p = _column(column), lift(p)
    if is_regular(p):
        return F.regexp_extract_all(column, F.lit(f"({regex(p)})"), 1)

    def each(own: Program, t: str) -> list[str]:
        out, at = [], 1
        while (m := own.match(t, at)) is not None:
            out.append(m["match"])
            at = max(m["after"], m["offset"] + 1)
        return out

    return _run(compiled(p), each, T.ArrayType(T.StringType()), column, None)


def parse_all(column, p, kind: T.DataType | str | None = None) -> Column:
    """All results at the start, the preferred ones first, as an array."""
    column, p = _column(column), lift(p)
    kind = as_type(kind) or p.kind() or T.BooleanType()
    return _run(compiled(p), lambda own, t: list(own.parse_all(t)), T.ArrayType(kind), column, None)


def replace_each(column, p, value: str) -> Column:
    """The text with each leftmost match that does not overlap replaced."""
    column, p = _column(column), lift(p)
    if is_regular(p):
        return F.regexp_replace(column, F.lit(regex(p)), F.lit(value.replace("\\", "\\\\").replace("$", "\\$")))

    def each(own: Program, t: str) -> str:
        out, at = [], 1
        while (m := own.match(t, at)) is not None:
            out += [t[at - 1 : m["offset"] - 1], value]
            if m["after"] == m["offset"]:
                out.append(t[m["offset"] - 1 : m["offset"]])
            at = max(m["after"], m["offset"] + 1)
            if at > len(t):
                break
        return "".join([*out, t[at - 1 :]])

    return _run(compiled(p), each, T.StringType(), column, None)


def trace(column, p) -> Column:
    """What the named parts of the pattern did: array<struct<name, start, after>> (after null: no more ways)."""
    from loomtext.plans.build import traced

    column = _column(column)

    def each(own: Program, t: str) -> list:
        ctx = own.context(t)
        next(own.ways(t, 0, ctx), None)
        return [{"name": n, "start": a, "after": None if b is None else b + 1} for n, a, b in ctx.trace]

    return _run(compiled(traced(lift(p))), each, as_type("array<struct<name:string,start:bigint,after:bigint>>"), column, None)


def byte_offset(column, position) -> Column:
    """The byte position (from 1) of a character position (from 1) of the UTF-8 text."""
    column = _column(column)
    return F.octet_length(F.substring(column, F.lit(1), position - 1)).cast("bigint") + 1


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
