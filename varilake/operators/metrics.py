"""Counts per variant and per sample that many operators share: one aggregate each, combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilake.model import Genotypes


def called() -> Column:
    return F.col("a1").isNotNull() & F.col("a2").isNotNull()


def _sums() -> list[Column]:
    a1, a2 = F.col("a1").cast("bigint"), F.col("a2").cast("bigint")
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(called()).alias("called"),
        F.coalesce(F.sum(a1 + a2), F.lit(0)).alias("sum_g"),
        F.coalesce(F.sum((a1 + a2) * (a1 + a2)), F.lit(0)).alias("sum_g2"),
        F.coalesce(F.sum(a1 * a1 + a2 * a2), F.lit(0)).alias("sum_a2"),
        F.count_if(called() & (F.col("a1") != F.col("a2"))).alias("het"),
    ]


def per_variant(gt: DataFrame) -> DataFrame:
    """row_id, n_rows, called, sum_g, sum_g2, sum_a2, het of genotype rows."""
    return gt.groupBy("row_id").agg(*_sums())


def polymorphic(strict: bool) -> Column:
    """Of per_variant columns: whether the called alleles (strict: genotypes) differ; false without calls."""
    n, g = F.col("called"), F.col("sum_g")
    return (n * F.col("sum_g2") != g * g) if strict else (2 * n * F.col("sum_a2") != g * g)


def per_sample(data: Genotypes) -> DataFrame:
    """One row per sample; samples without genotype rows have zeros."""
    gt = data.live("row_id", "sample_idx", "a1", "a2", "dp")
    both = lambda x: called() & (F.col("a1") == x) & (F.col("a2") == x)
    counts = gt.groupBy("sample_idx").agg(
        F.count(F.lit(1)).alias("total_loci"),
        F.count_if(called()).alias("non_missing"),
        F.count_if(called() & (F.col("a1") != F.col("a2"))).alias("heterozygotes"),
        F.count_if(both(0)).alias("homozygotes_ref"),
        F.count_if(both(1)).alias("homozygotes_alt"),
        F.count(F.when(called(), F.col("dp"))).alias("dp_n"),
        F.sum(F.when(called(), F.col("dp"))).alias("dp_sum"),
    )
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_loci", "non_missing", "heterozygotes", "homozygotes_ref", "homozygotes_alt", "dp_n")]
    return data.samples.join(counts, "sample_idx", "left").select("sample_idx", "sample", "grp", *zeros, "dp_sum")
