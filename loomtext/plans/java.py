"""From patterns to Java regular expressions, and the analysis that decides whether there is one."""

from __future__ import annotations

from functools import lru_cache

from loomtext.plans import classes as C
from loomtext.plans.nodes import (
    MANY, Alt, Assertion, At, Atomic, Back, Bytes, Call, Cap, Char, Cond, Const, Date, Filter, Look, Node, NotRegular, Opt, Pick, Ref, Rep, Seq,
    Then, Again, Mapped, Unsupported, Words, Wrap,
)

#: Java text of the assertions.  Line ends and word edges are spelled out, as Java's own differ.
_V, _W = C.VERTICAL.java(), C.WORD.java()
ANCHORS = {
    "start": r"\A", "end": r"\z", "last": r"(?=\n?\z)", "always": "", "never": "(?!)", "feedstart": r"(?:\A|(?<=\n)(?!\z))", "feedend": r"(?=\n|\z)",
    "word": f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))", "notword": f"(?:(?<=[{_W}])(?=[{_W}])|(?<![{_W}])(?![{_W}]))",
    "linestart": rf"(?:\A|(?<=[{_V}])(?!(?<=\r)\n))", "lineend": rf"(?:\z|(?=[{_V}])(?!(?<=\r)\n))",
}


def width(p: Node, inside: tuple = ()) -> tuple[int, int | None]:
    """Least and most characters of a match; None: no bound."""
    if id(p) in inside:
        return 0, None
    inside = (*inside, id(p))
    if isinstance(p, Const):
        return len(p.text), len(p.text)
    if isinstance(p, Char):
        return 1, 1
    if isinstance(p, Bytes):
        return p.width, p.width
    if isinstance(p, (Assertion, Look)):
        return 0, 0
    if isinstance(p, Words):
        return p.shortest() if p.trie else 0, None
    if isinstance(p, Ref):
        return width(p.target, inside)
    if isinstance(p, Seq):
        all_ = [width(x, inside) for x in p.parts]
        return sum(a for a, _ in all_), None if any(b is None for _, b in all_) else sum(b for _, b in all_)
    if isinstance(p, (Alt, Cond)):
        all_ = [width(x, inside) for x in (p.options if isinstance(p, Alt) else (p.yes, p.no))] or [(0, 0)]
        return min(a for a, _ in all_), None if any(b is None for _, b in all_) else max(b for _, b in all_)
    if isinstance(p, Rep):
        a, b = width(p.of, inside)
        return a * p.least, 0 if b == 0 else None if b is None or p.most >= MANY else b * p.most
    if isinstance(p, Opt):
        return 0, width(p.of, inside)[1]
    if isinstance(p, Then):
        return 0, None
    if isinstance(p, Back):
        return 0, None
    if isinstance(p, (Wrap, Pick)):
        return width(p.of, inside)
    return 0, None


def nullable(p: Node) -> bool:
    return width(p)[0] == 0


#: Times that Java may repeat a group of several ways: it recurses into each.
DEEPEST = 200


def steady(p: Node) -> bool:
    """Whether every match has the same width and one way, so that Java repeats it in a loop."""
    if isinstance(p, (Const, Char)):
        return True
    if isinstance(p, Seq):
        return all(map(steady, p.parts))
    if isinstance(p, Rep):
        return p.least == p.most and steady(p.of)
    return isinstance(p, (Wrap, Pick)) and not isinstance(p, (Cap, Look, Atomic, Then, Filter, Again, Mapped)) and steady(p.of)


def first(p: Node) -> list[C.CharClass] | None:
    """The classes that a match's first character is of; None where that is not known, or where a match may be empty."""
    if isinstance(p, Const):
        return [C.chars(p.text[0])] if isinstance(p.text, str) and p.text and not p.caseless else None
    if isinstance(p, Char):
        return None if p.caseless else [p.of]
    if isinstance(p, Seq):
        return first_of(list(p.parts))
    if isinstance(p, Alt):
        found = [first(q) for q in p.options]
        return None if not found or None in found else [c for f in found for c in f]
    if isinstance(p, Rep):
        return first(p.of) if p.least else None
    return first(p.of) if isinstance(p, (Wrap, Pick)) and not isinstance(p, (Look, Then, Mapped)) else None


def first_of(parts: list[Node], after: list | None = None) -> list[C.CharClass] | None:
    out: list = []
    for q in parts:
        if isinstance(q, (Rep, Opt)) and not (isinstance(q, Rep) and q.least):
            inner = first(q.of)
            if inner is None:
                return None
            out += inner
            continue
        inner = first(q)
        return None if inner is None else [*out, *inner]
    return None if after is None else [*out, *after]


@lru_cache(maxsize=256)
def _apart(a: C.CharClass, b: C.CharClass) -> bool:
    small = next((x for x in (a, b) if isinstance(x, C.Ranges) and sum(ord(j) - ord(i) for i, j in x.pairs) < 4096), None)
    every = range(0x110000) if small is None else (c for i, j in small.pairs for c in range(ord(i), ord(j) + 1))
    return not any(chr(c) in a and chr(c) in b for c in every)


def apart(a: list | None, b: list | None) -> bool:
    return a is not None and b is not None and all(_apart(x, y) for x in a for y in b)


def single(p: Node, after: list | None) -> bool:
    """Whether at most one way of ``p`` can be followed by a character of ``after`` (None: not known)."""
    if isinstance(p, (Const, Char)):
        return True
    if isinstance(p, Seq):
        return all(single(q, first_of(list(p.parts[k + 1 :]), after)) for k, q in enumerate(p.parts))
    if isinstance(p, Alt):
        options = [first(q) for q in p.options]
        return all(single(q, after) for q in p.options) and all(apart(a, b) for k, a in enumerate(options) for b in options[:k])
    if isinstance(p, Opt):
        return not p.lazy and apart(first(p.of), after) and single(p.of, after)
    if isinstance(p, Rep):
        if p.least == p.most and steady(p.of):
            return True
        inner = first(p.of)
        return not p.lazy and inner is not None and apart(inner, after) and single(p.of, [*inner, *after])
    return isinstance(p, (Wrap, Pick)) and not isinstance(p, (Look, Then, Filter, Again, Mapped, Cap)) and single(p.of, after)


class Emitter:
    """Writes one pattern; ``marks`` are nodes whose text is wanted, each a group of its own.

    A group that Java would repeat by recursion is written possessively where that is the same: at the pattern's end
    (``tail``), where its first way is the only one asked for, or where no other way could be followed by what comes next
    (``after``).  Otherwise there is no regex, as a long text would overflow the stack.
    """

    def __init__(self, marks: set[int] = frozenset()):
        self.marks, self.group_of, self.captures, self.count, self.open = marks, {}, {}, 0, []
        self.tail, self.after = True, None

    def _inside(self, p: Node, tail: bool, after: list | None) -> str:
        held = self.tail, self.after
        self.tail, self.after = tail, after
        out = self.write(p)
        self.tail, self.after = held
        return out

    def write(self, p: Node) -> str:
        if id(p) in self.marks and id(p) not in self.group_of and not self.open:
            self.count += 1
            self.group_of[id(p)] = self.count
            return f"({self._plain(p)})"
        return self._plain(p)

    def _once(self, p: Node) -> str:
        """As an item of a repetition: text inside is no longer one place, so it has no marks."""
        self.open.append(None)
        own = first(p)
        out = self._inside(p, False, None if own is None or self.after is None else [*own, *self.after])
        self.open.pop()
        return out if isinstance(p, Char) and not p.caseless else f"(?:{out})"

    def _plain(self, p: Node) -> str:
        if isinstance(p, Const):
            if not isinstance(p.text, str):
                raise NotRegular("bytes")
            out = "".join(map(C.java_char, p.text))
            return f"(?iu:{out})" if p.caseless else out
        if isinstance(p, Char):
            try:
                out = "[" + p.of.java() + "]"
            except TypeError as error:
                raise NotRegular(str(error)) from None
            return f"(?iu:{out})" if p.caseless else out
        if isinstance(p, Seq):
            last = len(p.parts) - 1
            return "".join(f"(?:{x})" if isinstance(q, Alt) else x for k, q in enumerate(p.parts) for x in (self._inside(q, self.tail and k == last, first_of(list(p.parts[k + 1 :]), self.after)),))
        if isinstance(p, Alt):
            return "(?:" + "|".join(self.write(q) for q in p.options) + ")" if p.options else "(?!)"
        if isinstance(p, (Rep, Opt)):
            least, most = (p.least, p.most) if isinstance(p, Rep) else (0, 1)
            sign = {(0, MANY): "*", (1, MANY): "+", (0, 1): "?"}.get((least, min(most, MANY)), f"{{{least},{'' if most >= MANY else most}}}")
            if isinstance(p, Opt):
                inner = self.write(p.of)
                return f"(?:{inner})?" + "?" * p.lazy
            if most > DEEPEST and not steady(p.of):
                if p.lazy or nullable(p.of) or not (self.tail or single(p, self.after)):
                    raise NotRegular("a repeated group that Java would recurse into")
                return self._once(p.of) + sign + "+"
            return self._once(p.of) + sign + "?" * p.lazy
        if isinstance(p, Words):
            return _trie_regex(p.trie)
        if isinstance(p, Atomic):
            return f"(?>{self._inside(p.of, True, None)})"
        if isinstance(p, At):
            return ANCHORS[p.what]
        if isinstance(p, Look):
            if not p.ahead and width(p.of)[1] is None:
                raise NotRegular("a look behind without bound")
            return f"(?{'' if p.ahead else '<'}{'=' if p.wanted else '!'}{self._inside(p.of, p.ahead, None)})"
        if isinstance(p, Cap):
            if id(p) in self.marks and not self.open and self.group_of.get(id(p)) == self.count:
                self.captures[p.index] = self.count
                return self.write(p.of)
            if p.index in self.captures:
                raise NotRegular("a group in two places")
            self.count += 1
            self.captures[p.index] = self.count
            return f"({self.write(p.of)})"
        if isinstance(p, Back):
            if len(p.groups) != 1 or p.groups[0] not in self.captures:
                raise NotRegular("a back reference to several groups, or ahead")
            out = f"(?:\\{self.captures[p.groups[0]]})"
            return f"(?iu:{out})" if p.caseless else out
        if isinstance(p, Cond) and p.test is not None and isinstance(p.test, Look):
            ahead = self.write(p.test)
            against = Look(p.test.of, p.test.ahead, not p.test.wanted)
            return f"(?:{ahead}{self.write(p.yes)}|{Emitter().write(against)}{self.write(p.no)})"
        if isinstance(p, Ref):
            if any(x is p for x in self.open):
                raise NotRegular("recursion")
            self.open.append(p)
            try:
                if isinstance(p, Call):
                    if any(isinstance(x, (Cap, Back)) for x in nodes(p.target.of if isinstance(p.target, Cap) else p.target)):
                        raise NotRegular("a subroutine with captures")
                    return f"(?:{self.write(p.target.of if isinstance(p.target, Cap) else p.target)})"
                return f"(?:{self.write(p.target)})"
            finally:
                self.open.pop()
        if isinstance(p, (Filter, Again, Mapped, Date)):
            raise NotRegular(type(p).__name__)
        if isinstance(p, (Wrap, Pick)) and not isinstance(p, Then):
            return self.write(p.of)
        raise NotRegular(type(p).__name__)


def _trie_regex(node: dict) -> str:
    """The words of a trie: every step tries the one branch there can be, and a word ends only where no longer one goes on."""
    if len(node) > 1 or "" not in node:
        branches = [C.java_char(c) + _trie_regex(n) for c, n in node.items() if c]
        if branches:
            out = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
            return out + "?" if "" in node else out
    return "" if node else "(?!)"


def nodes(p: Node, seen: set | None = None):
    """Every node below, once."""
    seen = set() if seen is None else seen
    if id(p) in seen:
        return
    seen.add(id(p))
    yield p
    for c in p.to if isinstance(p, Ref) else p.children():
        yield from nodes(c, seen)


def no_left_recursion(p: Node, path: tuple = (), done: set | None = None) -> None:
    """Raises if ``p`` can reach itself without taking a character."""
    done = set() if done is None else done
    if id(p) in path:
        raise Unsupported("left recursion")
    if id(p) in done:
        return
    for c in (p.target,) if isinstance(p, Ref) else p.children():
        no_left_recursion(c, (*path, id(p)), done)
        if isinstance(p, Seq) and not nullable(c):
            break
    done.add(id(p))


def regex(p: Node) -> str:
    """The Java regex of the whole pattern; raises NotRegular."""
    recursion_check(p)
    return Emitter().write(p)


def recursion_check(p: Node, path: tuple = (), done: set | None = None) -> None:
    done = set() if done is None else done
    if id(p) in path:
        raise NotRegular("recursion")
    if id(p) in done:
        return
    for c in p.to if isinstance(p, Ref) else p.children():
        recursion_check(c, (*path, id(p)), done)
    done.add(id(p))


def is_regular(p: Node) -> bool:
    try:
        regex(p)
    except NotRegular:
        return False
    return True
