"""Patterns ready for use: spaces, words, lines."""

from __future__ import annotations

from loomtext.plans import classes as C
from loomtext.plans.build import at_end, at_start, atomic, either, join, look, rep, rep1, seq, text
from loomtext.plans.nodes import At, Char, Const

space_inline = Char(C.INLINE_SPACE)
whitespace, whitespace_maybe = text(rep1(space_inline)), text(rep(space_inline))
horizontal_space = text(rep1(Char(C.HORIZONTAL)))
horizontal_space_maybe = text(rep(Char(C.HORIZONTAL)))
vertical_space = text(rep1(Char(C.VERTICAL)))
vertical_space_maybe = text(rep(Char(C.VERTICAL)))
space_char = Char(C.SPACE)
space, space_maybe = text(rep1(space_char)), text(rep(space_char))
newline = atomic(either(Const("\r\n"), Char(C.VERTICAL)))
word_char, non_word_char = Char(C.WORD), Char(~C.WORD)
word, non_word = text(rep1(word_char)), text(rep1(non_word_char))
words = join(word, horizontal_space)
word_boundary = At("word")
beyond_word = either(seq(look(word_char, ahead=False), look(word_char, wanted=False)), look(non_word_char), at_end)
at_linestart, at_lineend = At("linestart"), At("lineend")
inline = text(rep(Char(~C.VERTICAL)))
hex_digit = Char(C.HEX)
whole = lambda p: seq(at_start, p, at_end)


def char_table(chars: str) -> list[tuple[str, str, str]]:
    """(code point, name, category) of each character."""
    import unicodedata

    return [(f"U+{ord(c):04X}", unicodedata.name(c, "?"), unicodedata.category(c)) for c in chars]
