"""Quoted spans in delimited text: hidden behind placeholders, so that what is left can be split by a pattern.

A placeholder is SOH, a one-letter tag, the span's index, STX. An SOH of the text itself is first written as
SOH + "e", and "e" is no tag, so that no text can look like a placeholder whatever it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = r'"[^"]*+(?:""[^"]*+)*+"'
PLACEHOLDER = r"\x01[a-df-z]\d+\x02"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("\x01"), F.lit("\x01e"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("\x01e"), F.lit("\x01"))


def spans_of(escaped: Column, pattern: str = SPAN) -> Column:
    """The quoted spans in order, quotes included."""
    return F.regexp_extract_all(escaped, F.lit(pattern), F.lit(0))


def mask(escaped: Column, spans: Column, tag: Callable[[Column], Column], pattern: str = SPAN, lead: Callable[[Column], Column] | None = None) -> Column:
    """The text with every span replaced by its placeholder; lead keeps what a match holds before its quote."""
    pieces = F.split(escaped, pattern, -1)

    def joined(piece: Column, i: Column) -> Column:
        span = F.get(spans, i - 1)
        held = F.concat(F.lit("\x01"), tag(span), (i - 1).cast("string"), F.lit("\x02"), piece)
        return F.when(i == 0, piece).otherwise(F.concat(lead(span), held) if lead else held)

    return F.array_join(F.transform(pieces, joined), "")


def unquote(span: Column) -> Column:
    return F.replace(F.substring(span, F.lit(2), F.length(span) - 2), F.lit('""'), F.lit('"'))


def restore(token: Column, spans: Column, bare: Column) -> Column:
    """Placeholders looked up in the array of spans; where bare holds, without the enclosing quotes."""

    def put(text: Column, held: Column) -> Column:
        span = F.get(spans, F.substring(held, F.lit(3), F.length(held) - 3).cast("int"))
        return F.replace(text, held, F.when(bare, unquote(span)).otherwise(span))

    full = F.aggregate(F.regexp_extract_all(token, F.lit(PLACEHOLDER), F.lit(0)), token, put)
    return unescape(F.when(token.contains("\x01"), full).otherwise(token))
