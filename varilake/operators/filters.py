"""Filters of variants and genotypes. Each returns a new data set and runs nothing by itself.

Comparison directions are fixed: quality, rank and allele frequency keep values at or above their threshold, repeats
and missingness of variants at or below, heterozygosity and missingness of samples strictly below.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilake.model import Genotypes
from varilake.operators.metrics import called, per_variant, polymorphic


def _keep(data: Genotypes, condition: Column) -> Genotypes:
    return data.with_variants(data.variants.where(condition))


def _keep_ids(data: Genotypes, ids: DataFrame) -> Genotypes:
    return data.with_variants(data.variants.join(ids.select("row_id"), "row_id", "left_semi"))


def filter_quality(data: Genotypes, threshold: float = 30) -> Genotypes:
    """qual >= threshold; a missing or unreadable quality passes."""
    return _keep(data, F.coalesce("qual_num", F.lit(float(threshold))) >= threshold)


def filter_pass(data: Genotypes) -> Genotypes:
    """filter is PASS or `.`; null is dropped."""
    return _keep(data, F.col("filter").isin("PASS", "."))


def filter_biallelic(data: Genotypes) -> Genotypes:
    return _keep(data, F.col("is_biallelic"))


def filter_indels(data: Genotypes) -> Genotypes:
    """Drops indels; a variant of unknown kind is dropped too."""
    return _keep(data, ~F.col("is_indel"))


def _info_filter(data: Genotypes, column: str, condition: Column, keep_na: bool) -> Genotypes:
    """A column that is null everywhere filters nothing; that takes a look for one value."""
    if data.variants.where(F.col(column).isNotNull()).isEmpty():
        return data
    return _keep(data, F.coalesce(condition, F.lit(keep_na)))


def filter_rank(data: Genotypes, threshold: float = 0.4, keep_na: bool = False) -> Genotypes:
    return _info_filter(data, "rk", F.col("rk") >= threshold, keep_na)


def filter_rpt(data: Genotypes, threshold: float = 0.5, keep_na: bool = False) -> Genotypes:
    return _info_filter(data, "rpt", F.col("rpt") <= threshold, keep_na)


def filter_paralogs(data: Genotypes, threshold_rk: float = 0.2, threshold_rpt: float = 0.5, keep_na: bool = False) -> Genotypes:
    return filter_rpt(filter_rank(data, threshold_rk, keep_na), threshold_rpt, keep_na)


def _by_metrics(data: Genotypes, condition: Column) -> Genotypes:
    """Keeps variants by their genotype counts. The genotypes are counted before they meet the variants: one row per
    variant is joined, not one per genotype."""
    gt = data.gt.join(data.sample_list(), "sample_idx", "left_semi") if "samples" in data.filtered else data.gt
    return _keep_ids(data, per_variant(gt.select("row_id", "a1", "a2")).where(condition))


def filter_maf(data: Genotypes, threshold: float = 0.05) -> Genotypes:
    """Minor allele frequency >= threshold; variants without calls go. Codes above 1 count as they are."""
    af = F.try_divide(F.col("sum_g"), 2 * F.col("called"))
    return _by_metrics(data, F.least(af, 1 - af) >= threshold)


def filter_hets(data: Genotypes, threshold: float = 0.5) -> Genotypes:
    """Share of heterozygous among called < threshold; variants without calls go."""
    return _by_metrics(data, F.try_divide(F.col("het"), F.col("called")) < threshold)


def filter_missingness(data: Genotypes, threshold: float = 0.1) -> Genotypes:
    """Share of missing genotypes <= threshold; a variant without genotype rows counts as wholly missing."""
    share = (F.col("n_rows") - F.col("called")) / F.col("n_rows")
    return data if threshold >= 1 else _by_metrics(data, share <= threshold)


def filter_invariant(data: Genotypes, strict_poly: bool = False) -> Genotypes:
    """Keeps variants whose calls differ, by allele or (strict_poly) by genotype, and remembers the others."""
    kept = _by_metrics(data, (F.col("called") > 0) & polymorphic(strict_poly))
    gone = data.variants.join(kept.variants.select("row_id"), "row_id", "left_anti")
    return replace(kept, removed=data.removed.unionByName(gone))


def filter_missing(data: Genotypes, threshold: float = 0.5, f_invar: bool = True, strict_poly: bool = False) -> Genotypes:
    """Samples whose share of missing genotypes is < threshold; then, if f_invar, invariant variants go.

    A sample without genotype rows has no share and goes. No sample left is an error.
    """
    gt = data.live("row_id", "sample_idx", "a1")
    share = gt.groupBy("sample_idx").agg((F.count_if(F.col("a1").isNull()) / F.count(F.lit(1))).alias("share"))
    keep = data.samples.join(F.broadcast(share.where(F.col("share") < threshold)), "sample_idx", "left_semi")
    return restrict_samples(data, keep, f_invar, strict_poly)


def restrict_samples(data: Genotypes, samples: DataFrame, f_invar: bool = True, strict_poly: bool = False) -> Genotypes:
    """To the given rows of the samples. Genotypes of variants that are not live are let go, for good."""
    ids = [(r[0],) for r in samples.select("sample_idx").collect()]
    if not ids:
        raise ValueError("no sample is left")
    # the list, not its plan: a filter by missingness is not computed anew by whoever looks at the samples
    listed = F.broadcast(data.spark.createDataFrame(ids, "sample_idx INT"))
    out = data.with_samples(data.samples.join(listed, "sample_idx", "left_semi"))
    out = out.with_genotypes(out.live())
    return filter_invariant(out, strict_poly) if f_invar and len(ids) > 1 else out


def replace_gt(fmt: Column, format_: Column, gt: Column) -> Column:
    """fmt with its GT value, wherever format has it, replaced; null format: the first value."""
    at = F.coalesce(F.array_position(F.split(format_, ":"), "GT"), F.lit(1))
    parts = F.transform(F.split(fmt, ":", -1), lambda p, i: F.when(i == at - 1, gt).otherwise(p))
    return F.array_join(parts, ":")


def _rewritten(data: Genotypes, a1: Column, a2: Column, changed: Column, gt_text: Column) -> Genotypes:
    """Live genotypes with new alleles where changed, and their text with them."""
    gt = data.live().join(data.variants.select("row_id", "format"), "row_id")
    changed = F.coalesce(changed, F.lit(False))
    gt = gt.withColumn("_c", changed)
    cols = {"a1": F.when(F.col("_c"), a1).otherwise(F.col("a1")), "a2": F.when(F.col("_c"), a2).otherwise(F.col("a2")), "fmt": F.when(F.col("_c"), replace_gt(F.col("fmt"), F.col("format"), gt_text)).otherwise(F.col("fmt"))}
    return data.with_genotypes(gt.select(*(cols.get(c, F.col(c)).alias(c) for c in data.gt.columns)))


def mask_coverage(data: Genotypes, threshold: float = 10) -> Genotypes:
    """Called genotypes with a depth below the threshold, or without one, become missing; so does their text."""
    none = F.lit(None).cast("int")
    low = called() & (F.coalesce("dp", F.lit(-1.0)) < threshold)
    return _rewritten(data, none, none, low, F.when(F.col("phased"), ".|.").otherwise("./."))


def coverage_report(data: Genotypes, threshold: float = 10) -> dict[str, int]:
    """Of the live genotypes: how many are called, and how many of these mask_coverage makes missing."""
    low = called() & (F.coalesce("dp", F.lit(-1.0)) < threshold)
    return data.live("row_id", "sample_idx", "a1", "a2", "dp").agg(F.count_if(low).alias("masked"), F.count_if(called()).alias("called")).first().asDict()


def adr_report(data: Genotypes, threshold: float = 0.1) -> dict[str, int]:
    """Of the live genotypes: called heterozygotes, and how many of these filter_adr changes at either end."""
    het = called() & (F.col("a1") != F.col("a2"))
    counts = {"low": het & (F.col("adr") < threshold), "high": het & (F.col("adr") > 1 - threshold), "heterozygotes": het}
    return data.live("row_id", "sample_idx", "a1", "a2", "adr").agg(*(F.count_if(c).alias(k) for k, c in counts.items())).first().asDict()


def keep_covered(data: Genotypes, threshold: float = 10, strict_poly: bool = False) -> Genotypes:
    """Variants with at least two calls at or above the depth that differ among them."""
    gt = data.gt.join(data.sample_list(), "sample_idx", "left_semi") if "samples" in data.filtered else data.gt
    deep = per_variant(gt.where(called() & (F.col("dp") >= threshold)).select("row_id", "a1", "a2"))
    return _keep_ids(data, deep.where((F.col("called") >= 2) & polymorphic(strict_poly)))


def filter_coverage(data: Genotypes, threshold: float = 10, strict: bool = True, strict_poly: bool = False) -> Genotypes:
    return mask_coverage(data, threshold) if strict else keep_covered(data, threshold, strict_poly)


def filter_adr(data: Genotypes, threshold: float = 0.1, mode: str = "correct", f_invar: bool = True, strict_poly: bool = False) -> Genotypes:
    """Called heterozygotes whose alternate share is below threshold or above 1 - threshold.

    correct: they become homozygous for the allele seen; remove: missing. Then, if f_invar, invariant variants go.
    """
    if not 0 < threshold < 0.5 or mode not in ("correct", "remove"):
        raise ValueError("threshold must be between 0 and 0.5, mode correct or remove")
    het = called() & (F.col("a1") != F.col("a2"))
    low, high = het & (F.col("adr") < threshold), het & (F.col("adr") > 1 - threshold)
    new = F.lit(None).cast("int") if mode == "remove" else F.when(F.col("adr") < threshold, 0).otherwise(1)
    mark = F.when(F.col("phased"), "|").otherwise("/")
    text = F.concat(*(F.coalesce(new.cast("string"), F.lit(".")) if i != 1 else mark for i in range(3)))
    out = _rewritten(data, new, new, low | high, text)
    return filter_invariant(out, strict_poly) if f_invar else out


def snv_blocks(variants: DataFrame, block_size: int) -> DataFrame:
    """Variants with a position, and block: blocks of block_size from the first position of each chrom.

    The first positions are one small row per chrom, so a chrom that holds most variants is not in one task.
    """
    placed = variants.where(F.col("pos").isNotNull())
    first = placed.groupBy("chrom").agg(F.min("pos").alias("_first")).withColumnRenamed("chrom", "_chrom")
    joined = placed.join(first, F.col("chrom").eqNullSafe(F.col("_chrom")))
    return joined.withColumn("block", F.floor((F.col("pos") - F.col("_first")) / block_size)).drop("_first", "_chrom")


def filter_one_snv(data: Genotypes, block_size: int = 10_000, by_quality: bool = False) -> Genotypes:
    """One variant per block: the first by position, or the one of highest quality (missing last, then the first)."""
    order = ([F.col("qual_num").desc_nulls_last()] if by_quality else []) + [F.col("pos"), F.col("row_id")]
    blocks = snv_blocks(data.variants, block_size)
    first = F.row_number().over(Window.partitionBy("chrom", "block").orderBy(*order))
    return data.with_variants(blocks.withColumn("_i", first).where("_i = 1").drop("_i", "block"))


def filter_multi_snv(data: Genotypes, block_size: int = 10_000, min_snv: int = 2, max_snv: int = 5) -> Genotypes:
    """Blocks with at least min_snv variants; of larger ones the first max_snv."""
    blocks = snv_blocks(data.variants, block_size)
    w = Window.partitionBy("chrom", "block")
    counted = blocks.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy("pos", "row_id")))
    return data.with_variants(counted.where((F.col("_n") >= min_snv) & (F.col("_i") <= max_snv)).drop("_n", "_i", "block"))
