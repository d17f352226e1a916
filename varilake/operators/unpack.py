"""Several values packed in one text field: one row per value, with its place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilake.functions import quoting

KEY = "[A-Za-z][A-Za-z0-9_]*"


@dataclass(frozen=True)
class Packing:
    """How a field packs its values: the separators as a pattern over masked text, and whether empty places count."""

    separators: str
    keep_empty: bool


INFO = Packing(rf"[;|\t]|,(?=[ \t]*(?:{KEY}=|\x01k|\x01n\d+\x02=))", False)
ALT = Packing("[,/;|]", True)
FMT = Packing(r"[:;\t]", True)


def _tag(span: Column) -> Column:
    """k: the span begins with a key and `=`; n: it is only a key; q: anything else."""
    return F.when(span.rlike(rf'^"{KEY}='), "k").when(span.rlike(rf'^"{KEY}"\z'), "n").otherwise("q")


def values_of(text: Column, packing: Packing) -> Column:
    """Array of the single values of one field. Null gives null.

    Quoted spans become indexed placeholders, the rest is split, blanks and tabs around a value go, and the
    placeholders are looked up again. Quotes round a value or round what follows its first `=` are removed, any
    others are left as they are; a quote that is never closed is an ordinary character.
    """
    escaped = quoting.escape(text)
    spans = quoting.spans_of(escaped)
    masked = F.when(text.contains('"'), quoting.mask(escaped, spans, _tag)).otherwise(escaped)
    tokens = F.transform(F.split(masked, packing.separators, -1), lambda t: F.btrim(t, F.lit(" \t")))
    if not packing.keep_empty:
        tokens = F.filter(tokens, lambda t: t != "")
    return F.transform(tokens, lambda t: quoting.restore(t, spans, t.rlike(r"^(?:[^\x01=]*=)?\x01[knq]\d+\x02\z")))


def unpack(df: DataFrame, key: str, fields: dict[str, Packing]) -> DataFrame:
    """(key, field, idx from 1, val): one row per single value of the named fields.

    One pass without a shuffle. Defined cases: a null field gives no row; an empty text gives no row where empty
    places do not count and one empty value where they do; rows that repeat give their values again; other columns
    are ignored whatever their names; text of any length is split whole.
    """
    packed = F.array(*(F.struct(F.lit(f).alias("field"), values_of(df[f], p).alias("vals")) for f, p in fields.items()))
    each = df.select(df[key].alias("_key"), F.explode(packed).alias("_f"))
    return each.select("_key", F.col("_f.field"), F.posexplode("_f.vals").alias("_i", "val")).select(
        F.col("_key").alias(key), "field", (F.col("_i") + 1).alias("idx"), "val"
    )
