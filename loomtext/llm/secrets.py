"""Secret scans over texts and the layers encoded in them.

A worklist starts with the text.  Each layer is scanned, then unwrapped: percent codes, Unicode escapes and
character references are decoded in place (so that a secret may begin before one and end after it), a kind at a time and
once, and all kinds until no code is left, codes of codes too, in one pass over the layer; base64 runs,
joined over line ends and read from each of the four places a group of letters may start at, become layers of their
own, and so do compressed payloads anywhere in them (gzip, zlib, bz2, xz, zstandard).  Each decoded character keeps the
span of the original text it came from (an unpacked one: of its payload), so a finding in any layer maps to a span of
the text.
Layers already seen are not entered again, so the work ends at a fixpoint.

Null and empty texts have no spans.  A column of the input with the name of the result's is replaced.  All members, streams and frames of a payload are read, a damaged one as far as it
goes.  An unpacked layer over ``MOST_BYTES`` (a parameter) is read as a stream of windows of that size that overlap by
a quarter, so memory stays bounded; a layer encoded within it is cut if it crosses a window's end by more than that.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import steps, table

MOST_BYTES = 64 << 20
#: Packed bytes handed to a decompressor at once.
BLOCK = 1 << 16
KINDS = ("assign", "access", "hex")
#: The contract's patterns, and the shortest match kept of each (of group 2 for the first).
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: RE2 forms that hold whenever a pattern may: only texts with one of them reach the worklist.
LIKELY = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "layers": r"%[0-9A-Fa-f]{2}|\\(u[0-9A-Fa-f{]|U0|x[0-9A-Fa-f])|&#[0-9xX]|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][ \t>]*([\r\n]|\\[rn])(\s|>|\\[rn])*[A-Za-z0-9+/_-]",
}


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one layer, leftmost and non-overlapping per kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: Stretches of URLs and of string literals in which bytes stand for themselves or as codes.
_QUOTED = {
    "%": re.compile(r"(?:%[0-9A-Fa-f]{2}|[!#-$&-;=?-~])+"),
    "\\x": re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'"]|[ -\[\]-~])+"""),
    "": re.compile("[\0-\xff]+"),
}
_QUOTE = re.compile(r"""%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"])""")
_NAMED = dict(zip("abfnrtv0\\'\"", "\a\b\f\n\r\t\v\0\\'\"", strict=True))
#: Runs of base64 letters of either alphabet, over line ends (also written ones, quotation marks and indents).  The
#: shortest secret, of 12 bytes, has 16 letters.
_LETTERS, _LINE = r"[A-Za-z0-9+/_-]", r"[ \t>]*+(?:(?:[\r\n]|\\[rn])[ \t>]*+)++"
_JOINT = re.compile(rf"(?<={_LETTERS}){_LINE}(?={_LETTERS})")
_RUN, _RUNS = re.compile(_LETTERS + "{16,}"), re.compile(rf"(?<!{_LETTERS}){_LETTERS}++(?:{_LINE}{_LETTERS}++)*+")
_LINES = re.compile(_LINE)
_STANDARD = str.maketrans("-_", "+/")
#: Hold whenever bytes may have a secret or a layer.
_NAMES, _MARKS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), (b"AKIA", b"%", b"\\", b"&#")
_WORTH = re.compile(rb"[0-9a-f]{24}|[A-Za-z0-9+/_\\\s>-]{16}")
#: The first bytes of gzip, zlib, bz2, xz and zstandard payloads.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
_MARKED = re.compile(_MAGIC.pattern.decode("latin-1"))


#: Stand-ins of bytes that are not UTF-8, to the Latin-1 characters of those bytes.
_BYTES = {0xDC00 + b: chr(b) for b in range(0x80, 0x100)}


def _bytes_of(codes: str, width: int, mark: str) -> list[tuple[str, int, int]]:
    """(character, first place, end place) of a run of byte codes; a byte that is not UTF-8 stays a code."""
    text, at = _lossy(bytes.fromhex(codes.replace(mark, "")), False)
    out = []
    for c, a, b in zip(text, (width * at[:-1]).tolist(), (width * at[1:]).tolist(), strict=True):
        out += [(x, a + i, a + i + 1) for i, x in enumerate(codes[a:b])] if "\ud800" <= c < "\ue000" else [(c, a, b)]
    return out


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    return _bytes_of(m[0], 3, "%")


def _escape(m: re.Match) -> list[tuple[str, int, int]]:
    s = m[0]
    if s.startswith("\\x"):
        return _bytes_of(s, 4, "\\x")
    if s.startswith("\\u") and s[2] != "{":
        out, at = [], 0
        for c in bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "surrogatepass"):
            n = 12 if ord(c) > 0xFFFF else 6
            out += [(x, at + i, at + i + 1) for i, x in enumerate(s[at : at + n])] if "\ud800" <= c < "\ue000" else [(c, at, at + n)]
            at += n
        return out
    code = int(s[3:-1], 16) if s[2] == "{" or s[2] in "xX" else int(s[2:-1]) if s[0] == "&" else int(s[2:], 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return [(c, i, i + 1) for i, c in enumerate(s)]
    return [(chr(code), 0, len(s))]


_CODE = re.compile(
    r"%(?P<p>[0-9A-Fa-f]{2})|\\x(?P<x>[0-9A-Fa-f]{2})|\\u(?P<u>[0-9A-Fa-f]{4})|\\u\{(?P<b>[0-9A-Fa-f]{1,6})\}|\\U(?P<l>[0-9A-Fa-f]{8})|&#(?P<d>[0-9]{1,7});|&#[xX](?P<h>[0-9A-Fa-f]{1,6});"
)
#: The longest code but one character, and the characters that a code may hold.
_REACH, _CODED, _OPENS = 9, frozenset("0123456789abcdefABCDEFxXuU{};&#%\\"), frozenset("%\\&")


def _value(m: re.Match) -> str | int | None:
    """The character of a code, the number of a byte's code beyond ASCII, or None for no character."""
    kind = m.lastgroup
    n = int(m[kind], 10 if kind == "d" else 16)
    if kind in "px":
        return chr(n) if n < 0x80 else n
    return chr(n) if n <= 0x10FFFF else None


class _Rewritten:
    """A layer with all its codes decoded, and those that decoded characters make with their neighbours, till none is left.

    ``held``: stretches of the layer as they are (None) and decoded characters or bytes, with the places they came from.
    A decoded character is looked at with the ``_REACH`` characters on either side, and each code found there shortens
    the text, so the time is in proportion to the layer however deep its codes are nested.
    """

    def __init__(self, layer: str):
        self.layer, self.held = layer, []
        at = past = 0
        while m := _CODE.search(layer, past):
            value, low, high = _value(m), m.start(), m.end()
            if value is None:
                past = low + 1
                continue
            if low > at:
                self.held.append((at, low, None))
            at = high
            while isinstance(value, str) and value in _CODED:
                before = self._before()
                if value not in _OPENS and not _OPENS.intersection(before):
                    break
                near, p = before + value + layer[at : at + _REACH], len(before)
                found = next((x for q in range(p + 1) if near[q] in _OPENS and (x := _CODE.match(near, q)) and x.end() > p and _value(x) is not None), None)
                if found is None:
                    break
                low = min(low, self._drop(p - found.start(), low))
                at += found.end() - p - 1
                value, high = _value(found), max(high, at)
            self.held.append((low, high, value))
            past = at
        if at < len(layer):
            self.held.append((at, len(layer), None))

    def _before(self) -> str:
        parts, left = [], _REACH
        for low, high, value in reversed(self.held):
            part = self.layer[max(low, high - left) : high] if value is None else value if isinstance(value, str) else "\0"
            parts.append(part)
            if (left := left - len(part)) <= 0:
                break
        return "".join(reversed(parts))

    def _drop(self, n: int, low: int) -> int:
        """Takes the last ``n`` characters away and tells where they began."""
        while n:
            low, high, value = self.held.pop()
            if value is not None:
                n -= 1
            elif high - low > n:
                self.held.append((low, high - n, None))
                return high - n
            else:
                n -= high - low
        return low

    def parts(self) -> Iterator[tuple[int, int, str | None]]:
        """The stretches and characters, with the bytes beyond ASCII joined as UTF-8 (else as Latin-1), and surrogates in pairs."""
        held, k = self.held, 0
        while k < len(held):
            low, high, value = held[k]
            if isinstance(value, int):
                end = k
                while end < len(held) and isinstance(held[end][2], int):
                    end += 1
                text, at = _lossy(bytes(v for _, _, v in held[k:end]))
                for c, a, b in zip(text, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    yield held[k + a][0], held[k + b - 1][1], c
                k = end
                continue
            if value and "\ud800" <= value < "\ue000":
                after = held[k + 1][2] if k + 1 < len(held) else None
                if value < "\udc00" and isinstance(after, str) and "\udc00" <= after < "\ue000":
                    yield low, held[k + 1][1], (value + after).encode("utf-16-be", "surrogatepass").decode("utf-16-be")
                    k += 2
                    continue
                value = None
            yield low, high, value
            k += 1


class _Source:
    """Bytes, from a place on or from pieces, taken block by block; what was not used is given back."""

    def __init__(self, held: bytes, at: int = 0, pieces: Iterator[bytes] = iter(())):
        self.held, self.at, self.pieces, self.whole = held, at, pieces, False

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and (more := next(self.pieces, None)) is not None:
            self.held, self.at = self.held[self.at :] + more, 0
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out


def _engine(head: bytes):
    if head[:3] == b"\x1f\x8b\x08" or head[:1] == b"\x78":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    return None


def _unpacked(source: _Source) -> Iterator[bytes]:
    """Pieces of what is packed in all members, streams and frames from here on, as far as they can be read."""
    first, most = True, min(1 << 20, MOST_BYTES)
    try:
        while True:
            head = source.peek(8)
            if (engine := _engine(head)) is None:
                if head[:1] and 0x50 <= head[0] < 0x60 and head[1:4] == b"\x2a\x4d\x18":
                    n = int.from_bytes(source.take(8)[4:], "little")
                    while n and (got := source.take(min(n, BLOCK))):
                        n -= len(got)
                elif not first and head[:1] == b"\0":
                    source.at -= len(source.take(BLOCK).lstrip(b"\0"))
                else:
                    return
                continue
            first, source.whole, full = False, False, False
            #: A zstandard block of four bytes may hold 128 KB, and its output has no bound of its own.
            zstd = not hasattr(engine, "needs_input") and not isinstance(engine, type(zlib.decompressobj()))
            while not engine.eof:
                data = b"" if zstd else getattr(engine, "unconsumed_tail", b"")
                if not data and not full and getattr(engine, "needs_input", True) and not (data := source.take(256 if zstd else BLOCK)):
                    return
                out = engine.decompress(data) if zstd else engine.decompress(data, most)
                full = not zstd and not hasattr(engine, "needs_input") and len(out) == most
                if out:
                    yield out
            source.at -= len(engine.unused_data)
            source.whole = True
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, zstandard.ZstdError):
        source.whole = False


def _gathered(stream: Iterator[bytes], n: int) -> bytes:
    out, size = [], 0
    while size < n and (piece := next(stream, None)) is not None:
        out.append(piece)
        size += len(piece)
    return b"".join(out)


def _windows(raw: bytes, at: int) -> Iterator[bytes]:
    """What the payload at a place holds: whole, or over ``MOST_BYTES`` in windows that overlap by a quarter.

    A packed layer of more than one window is unpacked in turn; the worklist does that for all others.
    """
    depth, seen = 1, set()
    while True:
        stream = _unpacked(_Source(raw, at))
        for _ in range(depth - 1):
            stream = _unpacked(_Source(b"", 0, stream))
        window = _gathered(stream, MOST_BYTES)
        deeper = len(window) >= MOST_BYTES and _MAGIC.match(window) and (key := hashlib.sha256(window).digest()) not in seen
        while window:
            yield window
            more = _gathered(stream, MOST_BYTES - MOST_BYTES // 4)
            window = more and window[-(MOST_BYTES // 4) :] + more
        if not deeper:
            return
        seen.add(key)
        depth += 1


def _payloads(raw: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the compressed payloads in ``raw``; a damaged one may end anywhere."""
    past = 0
    for m in _MAGIC.finditer(raw):
        if m.start() < past:
            continue
        source = _Source(raw, m.start())
        if sum(map(len, _unpacked(source))):
            past = source.at if source.whole else past
            yield m.start(), source.at if source.whole else len(raw)


def _worth(raw: bytes) -> bool:
    low = raw.lower()
    return any(x in low for x in _NAMES) or any(x in raw for x in _MARKS) or _WORTH.search(raw) is not None


def _lossy(raw: bytes, latin: bool = True) -> tuple[str, np.ndarray]:
    """Text of any bytes (those that are not UTF-8 as Latin-1, or as lone surrogates), and the first byte of each character and the end."""
    text = raw.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    widths[(codes >= 0xDC80) & (codes < 0xDD00)] = 1
    return text.translate(_BYTES) if latin else text, np.concatenate([[0], np.cumsum(widths)])


def _letters(layer: str) -> Iterator[tuple[str, re.Match]]:
    """The letters of each base64 run, without line ends, and the run."""
    for m in (_RUNS if _JOINT.search(layer) else _RUN).finditer(layer):
        if len(m[0]) >= 16 and len(run := _LINES.sub("", m[0])) >= 16:
            yield run.translate(_STANDARD), m


def _places(m: re.Match) -> np.ndarray:
    """The places of a run's letters in its layer."""
    keep = np.ones(len(m[0]), bool)
    for line in _LINES.finditer(m[0]):
        keep[line.start() : line.end()] = False
    return m.start() + np.flatnonzero(keep)


def _opened(run: str) -> Iterator[tuple[bytes, int]]:
    """The bytes of a base64 run from each of the four places it may start at, and that place."""
    for k in range(4):
        n = len(run) - k
        n -= n % 4 == 1
        yield base64.b64decode(run[k : k + n] + "=" * (-n % 4)), k


def _quoted(layer: str) -> Iterator[tuple[bytes, np.ndarray]]:
    """The bytes of each stretch of codes and characters, and the place in the layer of each byte and of the end.

    A plus sign of a URL is read both as itself and as a space.
    """
    for mark, pattern in _QUOTED.items():
        if mark not in layer or not (mark or _MARKED.search(layer)):
            continue
        for m in pattern.finditer(layer):
            run = m[0]
            if mark and mark not in run:
                continue
            parts, widths, at = [], [], 0
            for code in _QUOTE.finditer(run) if mark else ():
                if code[0][0] != mark[0]:
                    continue
                c = _NAMED[code[3]] if code[3] else chr(int(code[1] or code[2], 16))
                parts += [run[at : code.start()], c]
                widths += [np.ones(code.start() - at, np.int64), np.array([len(code[0])])]
                at = code.end()
            raw = "".join([*parts, run[at:]]).encode("latin-1")
            if not _MAGIC.search(raw):
                continue
            places = m.start() + np.cumsum(np.concatenate([[0], *widths, np.ones(len(run) - at, np.int64)]))
            yield raw, places
            if mark == "%" and "+" in run:
                plain = np.frombuffer(raw, np.uint8).copy()
                plain[[layer[i] == "+" for i in places[:-1].tolist()]] = 0x20
                yield plain.tobytes(), places


def spans(text: str, base: set | None = None) -> list[tuple[int, int, str]]:
    """All spans of the text's secrets, in any layer, in code points."""
    found = set(scan(text) if base is None else base)
    start = np.arange(len(text))
    work, seen = [(text, start, start + 1, True)], {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}

    def enter(layer: str, starts, ends, fresh: bool = True) -> None:
        if (key := hashlib.sha256(layer.encode("utf-8", "surrogatepass") + bytes(f"@{starts[0]}" if len(starts) else "", "ascii")).digest()) not in seen:
            seen.add(key)
            work.append((layer, starts, ends, fresh))

    def put(layer: str, parts: list, starts, ends) -> None:
        """Enters a layer with some of its characters replaced."""
        inner = "".join([layer[a:b] if c is None else c for a, b, c in parts])
        if not starts.strides[0]:
            return enter(inner, np.broadcast_to(starts[0], len(inner)), np.broadcast_to(ends[0], len(inner)), False)
        low, high = np.array([a for a, _, _ in parts]), np.array([b for _, b, _ in parts])
        size = np.array([b - a if c is None else 1 for a, b, c in parts])
        own = np.repeat(np.arange(len(parts)), size)
        step = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        kept = np.array([c is None for _, _, c in parts])[own]
        enter(inner, starts[low[own] + step * kept], ends[np.where(kept, low[own] + step, high[own] - 1)], False)

    def inside(raw: bytes, a: int, low: int, high: int):
        return ((window, low, high) for window in _windows(raw, a))

    while work:
        if not isinstance(work[-1], tuple):
            if (piece := next(work[-1], None)) is None:
                work.pop()
                continue
            raw, low, high = piece
            work += [inside(raw, a, low, high) for a, _ in _payloads(raw)]
            if _worth(raw):
                inner = raw.decode("utf-8", "surrogateescape")
                enter(inner, np.broadcast_to(low, len(inner)), np.broadcast_to(high, len(inner)))
            continue
        layer, starts, ends, fresh = work.pop()
        #: An unpacked layer has one span, and no map of its characters.
        flat = not starts.strides[0]
        for a, b, kind in scan(layer) if layer is not text else ():
            found.add((int(starts[a:b].min()), int(ends[a:b].max()), kind))
        if fresh:
            for pattern, decoded in ((_PERCENT, _percent), (_ESCAPE, _escape)):
                parts, at = [], 0
                for m in pattern.finditer(layer):
                    parts += [(at, m.start(), None), *((m.start() + a, m.start() + b, c) for c, a, b in decoded(m))]
                    at = m.end()
                if parts:
                    put(layer, [*parts, (at, len(layer), None)], starts, ends)
            if _CODE.search(layer):
                put(layer, list(_Rewritten(layer).parts()), starts, ends)
        for run, letters in _letters(layer):
            for raw, k in _opened(run):
                if flat:
                    work.append(iter([(raw, int(starts[0]), int(ends[0]))]))
                    continue
                own = None
                for a, b in _payloads(raw):
                    own = _places(letters)[k:] if own is None else own
                    around = own[a * 4 // 3 : (b * 4 - 1) // 3 + 1]
                    work.append(inside(raw, a, int(starts[around].min()), int(ends[around].max())))
                if _worth(raw):
                    own = _places(letters)[k:] if own is None else own
                    inner, at = _lossy(raw)
                    enter(inner, starts[own[at[:-1] * 4 // 3]], ends[own[(at[1:] * 4 - 1) // 3]])
        for raw, places in _quoted(layer):
            for a, b in _payloads(raw):
                work.append(inside(raw, a, int(starts[places[a] : places[b]].min()), int(ends[places[a] : places[b]].max())))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def likely(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    for pattern in LIKELY.values():
        out |= np.asarray(pa.compute.match_substring_regex(texts, pattern).fill_null(False), dtype=bool)
    return out


SPAN = "array<struct<start:bigint,end:bigint,kind:string,layer:boolean>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("layer", pa.bool_())]))


def find(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: each secret's place in the whole text; ``layer``: seen in a decoded layer only."""
    from loomtext.llm.bpe import _append, _appended

    def run(batches):
        for batch in steps(batches, text):
            column = batch.column(text)
            out: list[list] = [[] for _ in range(len(batch))]
            for k in np.flatnonzero(likely(column)).tolist():
                whole = column[k].as_py()
                base = set(scan(whole))
                out[k] = [{"start": a, "end": b, "kind": kind, "layer": (a, b, kind) not in base} for a, b, kind in spans(whole, base)]
            yield _append(batch, into, pa.array(out, _SPANS))

    return docs.mapInArrow(run, _appended(docs, into, SPAN))


def redacted(found: DataFrame, text: str = "text", mark: str = "[secret]", spans: str = "spans") -> DataFrame:
    """``found`` with every span of its texts replaced by ``mark`` (overlapping spans as one) and without ``spans``."""

    @F.pandas_udf("string")
    def cut(texts, places):
        out = [whole if own is None or not len(own) else replaced(whole, [(p["start"], p["end"]) for p in own], mark) for whole, own in zip(texts, places, strict=True)]
        return type(texts)(out, index=texts.index, dtype=object)

    return found.withColumn(text, cut(F.col(f"`{text}`"), F.col(f"`{spans}`"))).drop(spans)


def replaced(whole: str, places: list[tuple[int, int]], mark: str) -> str:
    parts, at = [], 0
    for a, b in sorted(places):
        if a >= at:
            parts += [whole[at:a], mark]
        at = max(at, b)
    return "".join([*parts, whole[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret of its texts replaced, in one pass: as ``redacted`` of ``find``."""

    def run(batches):
        for batch in steps(batches, text):
            column, changed = batch.column(text), {}
            for k in np.flatnonzero(likely(column)).tolist():
                whole = column[k].as_py()
                if own := spans(whole):
                    changed[k] = replaced(whole, [(a, b) for a, b, _ in own], mark)
            if changed:
                texts = [changed.get(k, x) for k, x in enumerate(column.to_pylist())]
                batch = pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == text else batch.column(f.name) for f in batch.schema], batch.schema.names)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: ~s["layer"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
