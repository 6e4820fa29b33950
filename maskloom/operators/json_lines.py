"""JSON lines: only the string values of an object are masked.

A line is cut into pieces: the strings of a JSON object and the gaps between
them, or, when it is no JSON object, the line as a whole. Keys and gaps stay,
values and whole lines are masked, and the pieces are joined again. Key order,
numbers and repeated spaces inside strings survive; spaces between pieces go.
No schema is needed, and each line may have a shape of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from maskloom.config import JSON_DEPTH, MaskConfig
from maskloom.functions import patterns as rx
from maskloom.functions.matching import is_match, join_pieces, let, shield, split_matches, unshield

_ANY_LENGTH = {"maxStringLen": str(2 ** 31 - 1)}

# Kinds of pieces.
_GAP, _KEY, _VALUE, _LINE = "gap", "key", "value", "line"


def is_blank(line: Column) -> Column:
    return line.rlike(rx.BLANK)


def has_object_shape(line: Column) -> Column:
    """Whether the line starts with `{` and ends with `}`, spaces aside."""
    return line.rlike(rx.JSON_OBJECT_SHAPE)


def _skeleton(line: Column) -> Column:
    """The line with each valid string and each number or literal as a token, and no spaces.

    A token is a mark, which occurs nowhere else in a shielded text, and a letter. What is no JSON is left over.
    """
    text = F.regexp_replace(shield(line), rx.VALID_JSON_STRING, rx.STRING_TOKEN)
    # Where something is left over, it has a character that no JSON has outside of strings.
    text = F.regexp_replace(text, rx.JSON_SCALAR, rx.VALUE_TOKEN)
    return F.regexp_replace(text, r"[ \t\r\n]+", "")


def is_json_object(line: Column, depth: int = JSON_DEPTH) -> Column:
    """Whether the line is one valid JSON object, nested no deeper than `depth`, and nothing else.

    One pass makes tokens; then every pass takes the innermost objects and lists for values, as a parser
    reduces its stack, until one value is left. Keys may repeat.
    """
    def reduced(tokens: Column) -> Column:
        step = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), tokens, lambda rest, _: F.when(
            rest != rx.VALUE_TOKEN, F.regexp_replace(rest, rx.INNERMOST, rx.VALUE_TOKEN)).otherwise(rest))
        return tokens.rlike(rx.ONLY_TOKENS) & (step == rx.VALUE_TOKEN)

    return F.coalesce(F.when(has_object_shape(line), let(_skeleton(line), reduced)), F.lit(False))


def _unescape(literal: Column) -> Column:
    """The text of a quoted JSON string."""
    body = F.substring(literal, F.lit(2), F.length(literal) - 2)
    parsed = F.element_at(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>", _ANY_LENGTH), 1)
    return F.when(F.contains(literal, F.lit("\\")), F.coalesce(parsed, body)).otherwise(body)


def _escape(text: Column, ascii_only: bool) -> Column:
    """`text` as a quoted JSON string."""
    options = {"writeNonAsciiCharacterAsCodePoint": "true"} if ascii_only else {}
    listed = F.to_json(F.array(text), options)
    escaped = F.substring(listed, F.lit(2), F.length(listed) - 2)
    plain = r'\A[ -~&&[^"\\]]*\z'
    if ascii_only:
        plain = r'\A[ -~&&[^"\\<>&\'+`]]*\z'
        body = F.substring(escaped, F.lit(2), F.length(escaped) - 2)
        body = F.replace(body, F.lit('\\"'), F.lit("\\u0022"))
        for char in "<>&'+`\x7f":
            body = F.replace(body, F.lit(char), F.lit(f"\\u{ord(char):04X}"))
        escaped = F.concat(F.lit('"'), body, F.lit('"'))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.rlike(plain), quoted).otherwise(escaped)


def _piece(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def _json_pieces(line: Column) -> Column:
    def classify(piece: Column, position: Column) -> Column:
        literal = unshield(piece)
        key = F.regexp_replace(literal, r"(?U)\s*:\z", "")
        return (F.when(~is_match(position),
                       _piece(_GAP, F.regexp_replace(literal, r"\s+", "")))
                .when(F.endswith(piece, F.lit(":")), _piece(_KEY, _unescape(key)))
                .otherwise(_piece(_VALUE, _unescape(literal))))

    return F.transform(split_matches(shield(line), rx.JSON_STRING), classify)


def line_pieces(line: Column, cfg: MaskConfig) -> Column:
    """The pieces of a line, each with its kind; `is_maskable` tells which to mask."""
    whole = F.array(_piece(_LINE, line))
    if not cfg.detect_json:
        return whole
    return (F.when(is_blank(line), F.array(_piece(_GAP, line)))
            .when(is_json_object(line, cfg.json_depth), _json_pieces(line))
            .otherwise(whole))


def is_maskable(piece: Column) -> Column:
    return piece["kind"].isin(_VALUE, _LINE)


def mask_pieces(line: Column, mask: Callable[[Column], Column], cfg: MaskConfig) -> Column:
    """The line with `mask` applied to its JSON string values, or to all of it."""
    masked = F.transform(line_pieces(line, cfg), lambda p: F.struct(
        p["kind"].alias("kind"),
        F.when(is_maskable(p), mask(p["text"])).otherwise(p["text"]).alias("text")))

    def spell(piece: Column) -> Column:
        quoted = _escape(piece["text"], cfg.json_ascii)
        return (F.when(piece["kind"] == _VALUE, quoted)
                .when(piece["kind"] == _KEY, F.concat(quoted, F.lit(":")))
                .otherwise(piece["text"]))

    joined = F.array_join(F.transform(masked, spell), "")
    return F.when(line.isNotNull(), joined)
