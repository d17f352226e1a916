"""Top N items of every group, by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilake.session import materialize

BROADCAST_GROUPS = 500_000
"""Most groups whose counts are broadcast; more are joined by shuffling the band, which the ranking needs anyway."""
WIDEST_BAND = 0.5
"""The first band is at most this share of the rows, however many rows the groups need."""


def band_shares(rows: int, groups: int, n: int) -> tuple[float, ...]:
    """Shares of all rows above the cuts: twice what n of every group would take if scores were spread evenly, then eight times that."""
    first = min(WIDEST_BAND, 2 * n * groups / max(rows, 1))
    return tuple(x for x in (first, 8 * first) if 0 < x <= WIDEST_BAND)


def top_n(items: DataFrame, group: str, score: str, item: str, n: int, ties: tuple[Column, ...] = (), shares: tuple[float, ...] | None = None) -> DataFrame:
    """(group, rnk from 1, item): the n items of highest score in every group.

    The scores are cut into ranges at approximate percentiles, chosen by the numbers of rows and groups. The ranges are
    read from the top; in each, rows of groups that higher ranges already filled are taken out, and what is left is
    ranked exactly, going on from what the group has. Where the cuts fall changes the work, not the result. Spark keeps
    the first n ranks of a group in every task before the band's only shuffle, so a large group is never in one task.

    Order: score descending, then the ties in order, then the item ascending; item ids are compared as stored. Rows
    that repeat in all of these count once. Rows without a score (null or NaN) or item are left out; null is a group.
    Groups with fewer than n items give what they have. Empty tables give no row. Other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = items.select(
        items[group].alias("g"), items[score].cast("double").alias("s"), F.struct(*(t.alias(f"t{i}") for i, t in enumerate(ties)), F.lit(0).alias("z")).alias("t"), items[item].alias("i")
    ).where("s IS NOT NULL AND NOT isnan(s) AND i IS NOT NULL")
    if shares is None:
        size = rows.agg(F.count(F.lit(1)).alias("m"), F.approx_count_distinct("g").alias("k")).first()
        shares = band_shares(size["m"], size["k"], n)
    cuts = rows.agg(F.percentile_approx("s", [1 - x for x in shares], 1000)).first()[0] if shares else []
    edges = sorted(set(cuts or []), reverse=True)
    order = Window.partitionBy("g").orderBy(F.desc("s"), *(F.col(f"t.t{i}").asc_nulls_last() for i in range(len(ties))), "i")
    kept: list[DataFrame] = []
    for high, low in zip([None, *edges], [*edges, None], strict=True):
        band = rows
        if high is not None:
            band = band.where(F.col("s") < high)
        if low is not None:
            band = band.where(F.col("s") >= low)
        have = F.lit(0).cast("bigint")
        if kept:
            held = reduce(DataFrame.unionByName, kept).groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("_have"))
            held = materialize(held)
            held = F.broadcast(held) if held.count() <= BROADCAST_GROUPS else held
            band = band.join(held, F.col("g").eqNullSafe(F.col("_g")), "left").where(F.coalesce("_have", F.lit(0)) < n)
            have = F.coalesce("_have", F.lit(0))
        # repeated rows have the same rank: they are made one after the ranking, when few rows are left
        ranked = band.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= n)
        kept.append(materialize(ranked.select("g", (F.col("_rank") + have).cast("int").alias("rnk"), "i").where(F.col("rnk") <= n).distinct()))
    return reduce(DataFrame.unionByName, kept).select(F.col("g").alias(group), "rnk", F.col("i").alias(item))
