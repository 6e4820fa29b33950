"""Replacing every match of a pattern by a computed value.

`regexp_replace` can only put back constants and groups. So it is used to fence
each match off with a mark, the text is split at the marks, and every second
piece, which is a match, is handed to a function. The pattern runs once over
the text, in its full context, so lookaround and empty matches are exact.

The mark is a Unicode noncharacter. Should a text hold it already, `shield`
spells it by two other noncharacters for as long as the work goes on. No
detector tells these apart from any other odd character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

MARK = "\ufdd0"
_ESCAPE, _ESCAPED_ESCAPE, _ESCAPED_MARK = "\ufdd1", "\ufdd1\ufdd2", "\ufdd1\ufdd3"
RESERVED = "\ufdd0\ufdd1\ufdd2\ufdd3"


def shield(text: Column) -> Column:
    """`text` without the mark character; undone by `unshield`."""
    text = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPED_ESCAPE))
    return F.replace(text, F.lit(MARK), F.lit(_ESCAPED_MARK))


def unshield(text: Column) -> Column:
    text = F.replace(text, F.lit(_ESCAPED_MARK), F.lit(MARK))
    return F.replace(text, F.lit(_ESCAPED_ESCAPE), F.lit(_ESCAPE))


def split_matches(text: Column, pattern: str) -> Column:
    """Pieces of a shielded text: gap, match, gap, ... , match, gap."""
    fenced = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return F.split(fenced, MARK, -1)


def split_shortened(text: Column, pattern: str, end: str) -> Column:
    """Like `split_matches`, for a pattern that goes on too far: a match ends with its last `end`; without one it is none.

    For what may be arbitrarily long, where a pattern that gives back piece by piece would need stack for
    each. `end` may look at a MARK where the long match ends.
    """
    opening, closing, inside = f"{MARK}<", f"{MARK}>", f"[^{MARK}]*"
    fenced = F.regexp_replace(text, F.lit(pattern), F.lit(f"{opening}$0{closing}"))
    fenced = F.regexp_replace(fenced, F.lit(f"{opening}(?!{inside}{end})({inside}){closing}"), F.lit("$1"))
    fenced = F.regexp_replace(fenced, F.lit(f"{opening}({inside}{end})({inside}){closing}"), F.lit(f"{MARK}$1{MARK}$2"))
    return F.split(fenced, MARK, -1)


def is_match(position: Column) -> Column:
    """Whether the piece at this 0-based position is a match."""
    return position % 2 == 1


def join_pieces(pieces: Column, rewrite: Callable[[Column], Column]) -> Column:
    """The text put together again with each match rewritten."""
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(is_match(i), rewrite(p)).otherwise(p)), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """`text` with every match of `pattern` replaced by `rewrite(match)`."""
    pieces = split_matches(shield(text), pattern)
    return unshield(join_pieces(pieces, lambda m: shield(rewrite(unshield(m)))))


def literal_replacement(text: str) -> str:
    """`text` as a replacement for `regexp_replace` that is taken literally."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def any_literal(terms: tuple[str, ...]) -> str:
    """A pattern for any of the terms, each taken literally."""
    def quote(char: str) -> str:
        return char if char.isalnum() or not char.isascii() else "\\" + char

    return "(?:" + "|".join("".join(map(quote, term)) for term in terms) + ")"
