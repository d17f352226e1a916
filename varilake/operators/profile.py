"""Column profiles per load: nulls, distinct values, ranges, malformed values and changes between loads.

Values are counted per load first (map-side combined), so regular expressions and casts run once per distinct value
and everything after that works on counts. Power sums of the numbers are exact for every finite DOUBLE (see power_sums),
so profiles of files, days or loads add up to the profile of the whole, in any order.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ColumnSpec:
    """A column to profile. valid: which non-null values are well formed; number: the number of a valid value, or None for text."""

    tab: str
    col: str
    valid: Callable[[Column], Column]
    number: Callable[[Column], Column] | None = None


NUMBER_TEXT = r"^[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
NAMES_TEXT = r"^(?:\.|[A-Za-z0-9_]+(?:;[A-Za-z0-9_]+)*)\z"


def whole_and_positive(value: Column) -> Column:
    d = value.cast("double")
    return ~F.isnan(d) & (d >= 0) & (d < float("inf")) & (d == F.rint(d))


def numeric_text(value: Column) -> Column:
    """The number written in a text, else null."""
    return F.when(value.rlike(NUMBER_TEXT), value.try_cast("double"))


GENOTYPE_SPECS = (
    ColumnSpec("gt", "a1", lambda v: v >= 0, lambda v: v.cast("double")),
    ColumnSpec("gt", "dp", whole_and_positive, lambda v: v.cast("double")),
    ColumnSpec("variants", "qual", lambda v: (v == ".") | v.rlike(NUMBER_TEXT), numeric_text),
    ColumnSpec("variants", "filter", lambda v: v.rlike(NAMES_TEXT)),
)


_PARTIAL = (
    "tab STRING, col STRING, is_numeric BOOLEAN, load_id BIGINT, exponent INT, n_rows BIGINT, n_null BIGINT, n_bad BIGINT, distinct_count BIGINT, n_top BIGINT, n_numbers BIGINT, "
    "min_value DOUBLE, max_value DOUBLE, min_text STRING, max_text STRING, s1 DECIMAL(38,0), hh DECIMAL(38,0), hl DECIMAL(38,0), ll DECIMAL(38,0)"
)
_LIMB = 27


def _scaled(x: Column, exponent: Column) -> Column:
    """x * 2^-exponent, exact: a power of two beyond the range of DOUBLE is applied in two steps."""
    half = F.floor(exponent / 2)
    return x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - exponent)


def power_sums(df: DataFrame, spec: ColumnSpec, load: str = "load_id") -> DataFrame:
    """Mergeable figures of one column: a few rows per load, one for each exponent of its numbers.

    Every finite DOUBLE is m * 2^exponent with a whole m below 2^55. n*m, and the squares of m in limbs of 27 bits, are
    summed in DECIMAL per exponent, so the sums are exact for all finite numbers, in any order: rows of several files,
    days or loads are added up by load and exponent. Limbs keep a square times 10^20 rows within 38 digits.
    Null is counted in n_null and nowhere else; NaN is a value of its own. A null load is a load. Repeated rows count
    as often as they occur. An empty table gives no row.
    """
    counted = df.select(df[load].cast("bigint").alias("load_id"), df[spec.col].alias("v")).groupBy("load_id", "v").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("v"), F.col("n")
    good = F.coalesce(spec.valid(v), F.lit(False)) & v.isNotNull()
    x = F.when(good, spec.number(v)) if spec.number else F.lit(None).cast("double")
    finite = ~F.isnan("x") & (F.abs("x") < float("inf"))
    exponent = F.when(F.col("x") == 0, 0).when(finite, F.floor(F.log2(F.abs("x"))).cast("int") - 53)
    cells = counted.select("load_id", "n", "v", good.alias("good"), x.alias("x")).withColumn("exponent", exponent)
    cells = cells.withColumn("m", _scaled(F.col("x"), F.col("exponent")).cast("bigint"))
    high, low = F.shiftright("m", _LIMB), F.col("m").bitwiseAND(F.lit((1 << _LIMB) - 1))
    wide = lambda c: c.cast("decimal(19,0)")
    total = lambda c: F.coalesce(F.sum((wide(c) * wide(n)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    text = F.lit(None).cast("string") if spec.number else v.cast("string")
    return cells.groupBy("load_id", "exponent").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(v.isNotNull() & ~F.col("good"), n)), F.lit(0)).alias("n_bad"),
        F.count("v").alias("distinct_count"),
        F.coalesce(F.max(F.when(v.isNotNull(), n)), F.lit(0)).alias("n_top"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), n)), F.lit(0)).alias("n_numbers"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        F.min(text).alias("min_text"),
        F.max(text).alias("max_text"),
        total(F.col("m")).alias("s1"),
        total(high * high).alias("hh"),
        total(high * low).alias("hl"),
        total(low * low).alias("ll"),
    ).select(F.lit(spec.tab).alias("tab"), F.lit(spec.col).alias("col"), F.lit(spec.number is not None).alias("is_numeric"), "*")


def _moments(part: pd.DataFrame) -> tuple[float | None, float | None]:
    """Mean and standard deviation of one load from its exact sums; the variance is a fraction until it is rounded once."""
    n, first, second = 0, Fraction(0), Fraction(0)
    for r in part[part["exponent"].notna()].itertuples():
        unit = Fraction(2) ** int(r.exponent)
        n += int(r.n_numbers)
        first += int(r.s1) * unit
        second += ((int(r.hh) << 2 * _LIMB) + (int(r.hl) << _LIMB + 1) + int(r.ll)) * unit * unit
    if not n or n != part["n_numbers"].sum():  # an infinite number has no moments
        return None, None
    variance = (n * second - first * first) / (n * n)
    with localcontext(prec=60, Emax=10**6, Emin=-(10**6)):
        return float(first / n), float((Decimal(variance.numerator) / Decimal(variance.denominator)).sqrt())


_PROFILE = (
    "tab STRING, col STRING, is_numeric BOOLEAN, load_id BIGINT, n_rows BIGINT, n_null BIGINT, n_bad BIGINT, distinct_count BIGINT, n_top BIGINT, n_numbers BIGINT, "
    "min_value DOUBLE, max_value DOUBLE, min_text STRING, max_text STRING, mean_value DOUBLE, sd_value DOUBLE"
)


def combine(partials: DataFrame) -> DataFrame:
    """One row per (tab, col, load_id) from power_sums, with shares, mean and standard deviation.

    A task holds the rows of one load and column, at most one per exponent of DOUBLE (2,100) and partial. Partials of
    several tables may be united before; distinct_count and n_top then hold only if no value is in two of them.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        head = {c: [part[c].iloc[0]] for c in ("tab", "col", "is_numeric", "load_id")}
        sums = {c: [int(part[c].sum())] for c in ("n_rows", "n_null", "n_bad", "distinct_count")} | {"n_top": [int(part["n_top"].max())], "n_numbers": [int(part["n_numbers"].sum())]}
        text = lambda c, pick: [pick(t) if (t := [x for x in part[c] if isinstance(x, str)]) else None]
        mean, sd = _moments(part)
        ends = {"min_value": [part["min_value"].min()], "max_value": [part["max_value"].max()], "min_text": text("min_text", min), "max_text": text("max_text", max), "mean_value": [mean], "sd_value": [sd]}
        return pd.DataFrame(head | sums | ends).astype({"load_id": "Int64", "mean_value": "Float64", "sd_value": "Float64", "min_value": "Float64", "max_value": "Float64"})

    base = partials.select([f.name for f in T._parse_datatype_string(_PARTIAL).fields]).groupBy("tab", "col", "load_id").applyInPandas(one, _PROFILE)
    valued = F.col("n_rows") - F.col("n_null")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    return base.select(
        "*",
        share(F.col("n_null"), F.col("n_rows")).alias("null_share"),
        share(F.col("n_bad"), valued).alias("bad_share"),
        share(F.col("n_top"), valued).alias("top_share"),
    )


def profile(tables: dict[str, DataFrame], specs: tuple[ColumnSpec, ...] = GENOTYPE_SPECS, load: str = "load_id") -> DataFrame:
    """Profile of every column in specs, one row per (tab, col, load_id)."""
    return combine(reduce(DataFrame.unionByName, (power_sums(tables[s.tab], s, load) for s in specs)))


def _with_previous(profiled: DataFrame) -> DataFrame:
    """Each load beside the load numbered one less. One row per load and column: small whatever the tables' size."""
    now, then = profiled.alias("b"), profiled.alias("a")
    same = (F.col("b.tab") == F.col("a.tab")) & (F.col("b.col") == F.col("a.col"))
    return now.join(then, same & (F.col("a.load_id") == F.col("b.load_id") - 1))


def shifts(profiled: DataFrame) -> DataFrame:
    """Standardised difference of the means of neighbouring loads; null where a load has no number or nothing varies."""
    spread = F.sqrt((F.col("a.sd_value") * F.col("a.sd_value") + F.col("b.sd_value") * F.col("b.sd_value")) / 2)
    both = _with_previous(profiled).where("a.n_numbers > 0 AND b.n_numbers > 0")
    return both.select("b.tab", "b.col", "b.load_id", F.when(spread > 0, (F.col("b.mean_value") - F.col("a.mean_value")) / spread).alias("std_diff"))


def changed_measures(profiled: DataFrame, share: float = 0.12, distinct: float = 2.0, maximum: float = 3.0, mean: float = 1.25) -> DataFrame:
    """(tab, col, load_id, measure) of every measure that changed against the load numbered one less.

    Shares change by an absolute difference, the others by a factor, up or down; no number counts as 0, and a change
    between 0 and more always counts. Loads without a predecessor and null loads give nothing.
    """

    def by(name: str, limit: float) -> Column:
        return F.abs(F.col(f"b.{name}") - F.col(f"a.{name}")) >= limit

    def factor(name: str, limit: float) -> Column:
        a, b = (F.coalesce(F.col(f"{t}.{name}").cast("double"), F.lit(0.0)) for t in "ab")
        return (a != b) & (F.greatest(a, b) >= limit * F.least(a, b))

    numeric = F.col("b.is_numeric")
    tests = {
        "null_share": by("null_share", share),
        "bad_share": by("bad_share", share),
        "distinct_count": factor("distinct_count", distinct),
        "max_value": numeric & factor("max_value", maximum),
        "mean_value": numeric & factor("mean_value", mean),
        "top_share": ~numeric & by("top_share", share),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(m)) for m, test in tests.items())))
    return _with_previous(profiled).select("b.tab", "b.col", "b.load_id", F.explode(found).alias("measure"))
