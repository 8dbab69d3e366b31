"""Text expressions shared by the parsers, guards and overlays."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space as Python's str methods see it (Java's \s needs (?U) and lacks 1C-1F).
WS = r"[\s\x1c-\x1f]"
# The same characters spelled out, for trims that look at the ends only.
_SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                   0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

_DIGITS_FROM = "".join(
    chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
)
_DIGITS_TO = "".join(str(unicodedata.digit(c)) for c in _DIGITS_FROM)
# Full-width ASCII block: each character is its ASCII twin plus a fixed offset.
_WIDE_FROM = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
_WIDE_TO = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def fold_digits(text: Column) -> Column:
    """Any Unicode decimal digit becomes its ASCII digit."""
    return F.translate(text, _DIGITS_FROM, _DIGITS_TO)


def is_blank(text: Column) -> Column:
    """True for text without any visible character; null stays null."""
    return ~text.rlike(rf"(?U)[^\s\x1c-\x1f]")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACES))


def squash(text: Column) -> Column:
    """Collapse white space runs to one blank and trim both ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){WS}+", " "))


def same_text(left: Column, right: Column) -> Column:
    """Equality after white space is squashed; the cheap byte comparison goes first."""
    return F.when(left == right, F.lit(True)).otherwise(squash(left) == squash(right))


def clip(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def strip_fence(text: Column) -> Column:
    """Drop a leading ``` line and, when present, a trailing ``` line."""
    s = strip(text)
    body = F.regexp_replace(s, r"^```[^\n\r]*(?:\r\n|\n|\r|$)", "")
    body = F.regexp_replace(body, r"(?:^|\r\n|\n|\r)[^\S\r\n]*```[^\n\r]*$", "")
    return F.when(s.startswith("```"), strip(body)).otherwise(s)


def strip_closed_fence(text: Column) -> Column:
    """Drop the fence only when the last line is exactly the closing ```."""
    s = strip(text)
    inner = F.regexp_extract(s, r"(?s)^```[^\n]*\n(.*?)\n?[^\S\n]*```$", 1)
    closed = s.rlike(r"(?s)^```[^\n]*\n(?:.*\n)?[^\S\n]*```$")
    return F.when(closed, strip(inner)).otherwise(s)


def json_element(text: Column) -> Column:
    """The text parsed as the first element of an array, as a variant (null for junk).

    The parser ignores what follows a complete value; the array's second element must still be reached.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "\u241e"]')))


def json_signature(parsed: Column) -> Column:
    """Type signature of the one JSON value that ``json_element`` parsed; null where text follows it."""
    closed = F.try_variant_get(parsed, "$[1]", "string") == "\u241e"
    return F.when(closed, F.schema_of_variant(F.try_variant_get(parsed, "$[0]", "variant")))


def is_json_object(text: Column) -> Column:
    """True when the text parses as one JSON object (arrays, scalars and junk are not)."""
    return F.coalesce(json_signature(json_element(text)).startswith("OBJECT"), F.lit(False))


def escape_literal(text: Column) -> Column:
    """Escape backslash, double quote and line feed for a quoted literal."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def escape_ntriples(text: Column) -> Column:
    """``escape_literal`` plus carriage return, so that one triple is always one line."""
    return F.replace(escape_literal(text), F.lit("\r"), F.lit("\\r"))


# --- alias keys -------------------------------------------------------------------------

# Characters for which NFKC + case folding is the translate/lower below: ASCII, its
# full-width twins and precomposed Hangul syllables.
_PLAIN = r"^[\x00-\x7f가-힣！-～　]*$"


@F.pandas_udf(StringType())
def _nfkc_alnum(texts: pd.Series) -> pd.Series:
    def key(value):
        if value is None:
            return None
        return "".join(
            ch for ch in unicodedata.normalize("NFKC", value).casefold() if ch.isalnum()
        )

    return texts.map(key)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def alias_key(text: Column) -> Column:
    """NFKC, case fold, keep letters and digits.

    Spark has no NFKC, so text outside the plain set goes to one Arrow-batched UDF; plain
    text is handled in the JVM and reaches the UDF only as null.
    """
    plain = text.rlike(_PLAIN)
    fast = F.regexp_replace(
        F.lower(F.translate(text, _WIDE_FROM, _WIDE_TO)), r"[^\p{L}\p{N}]", ""
    )
    slow = _nfkc_alnum(F.when(~plain, text))
    return F.when(plain, fast).otherwise(slow)


def series_numbers(text: Column) -> Column:
    """Sorted distinct series numbers: the N of every ``N호``."""
    plain = text.rlike(_PLAIN)
    folded = F.when(plain, F.translate(text, _WIDE_FROM, _WIDE_TO)).otherwise(
        _nfkc(F.when(~plain, text))
    )
    found = F.regexp_extract_all(folded, F.lit(rf"(?U)(\d+){WS}*호"), F.lit(1))
    return F.array_sort(F.array_distinct(found))
