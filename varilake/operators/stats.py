"""Statistics per sample and per group: depth, heterozygosity, inbreeding coefficient F, Watterson's theta, pi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilake.model import Genotypes
from varilake.operators.metrics import called, per_sample
from varilake.operators.samples import draw_key

MIN_ALLELES = 4
"""Called alleles that a variant needs in a group to count for F, theta and pi."""


def _snvs(data: Genotypes) -> DataFrame:
    return data.variants.where("is_biallelic AND NOT is_indel").select("row_id")


def _counts(data: Genotypes, by_group: bool) -> DataFrame:
    """row_id[, grp], alt, nobs: alternate and all called alleles of biallelic SNVs; combined before the join."""
    gt = data.gt.where(called()).select("row_id", "sample_idx", "a1", "a2").join(data.sample_list("grp"), "sample_idx")
    keys = ["row_id", "grp"] if by_group else ["row_id"]
    counts = gt.groupBy(*keys).agg(F.sum((F.col("a1") > 0).cast("bigint") + (F.col("a2") > 0).cast("bigint")).alias("alt"), (2 * F.count(F.lit(1))).alias("nobs"))
    return counts.join(_snvs(data), "row_id", "left_semi")


def _two_pq(p: Column, n: Column) -> Column:
    return 2 * p * (1 - p) * n / (n - 1)


def inbreeding(data: Genotypes, f_ref: str = "all") -> DataFrame:
    """sample_idx, F_sites, F_hom_obs, F_hom_exp, F over biallelic SNVs, against all samples or those of the group.

    A site counts for a sample that is called there if the reference has at least MIN_ALLELES called alleles and is
    polymorphic. F = (O - E) / (N - E), null where that is not finite. With f_ref = group, samples without group have none.
    """
    if f_ref not in ("all", "group"):
        raise ValueError("f_ref must be all or group")
    by_group = f_ref == "group"
    counts = _counts(data, by_group).where((F.col("nobs") >= MIN_ALLELES) & (F.col("alt") > 0) & (F.col("alt") < F.col("nobs")))
    p = F.col("alt") / F.col("nobs")
    expected = counts.select("row_id", *(["grp"] if by_group else []), (1 - _two_pq(p, F.col("nobs"))).alias("e"))
    gt = data.gt.where(called()).select("row_id", "sample_idx", "a1", "a2").join(data.sample_list("grp"), "sample_idx")
    sites = gt.join(expected, ["row_id", "grp"] if by_group else ["row_id"])
    sums = sites.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("F_sites"), F.count_if(F.col("a1") == F.col("a2")).alias("F_hom_obs"), F.sum("e").alias("F_hom_exp"))
    zero = [F.coalesce("F_sites", F.lit(0)).alias("F_sites"), F.coalesce("F_hom_obs", F.lit(0)).alias("F_hom_obs"), F.coalesce("F_hom_exp", F.lit(0.0)).alias("F_hom_exp")]
    full = data.samples.select("sample_idx").join(sums, "sample_idx", "left").select("sample_idx", *zero)
    return full.withColumn("F", F.try_divide(F.col("F_hom_obs") - F.col("F_hom_exp"), F.col("F_sites") - F.col("F_hom_exp")))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n."""
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k)


def theta(data: Genotypes, keep_groups: list[str] | None = None) -> DataFrame:
    """grp, theta_w, pi, n_sites, n_ind for each group, and with grp null for all kept groups together.

    Sites are biallelic SNVs with at least MIN_ALLELES called alleles. pi is the mean of 2p(1-p)n/(n-1), theta_w the
    mean of 1/H(n-1) at polymorphic sites and 0 at others; without sites both are null. Samples without a group count
    for neither.
    """
    kept = data.samples.where(F.col("grp").isNotNull() if keep_groups is None else F.col("grp").isin(keep_groups))
    data = Genotypes(data.variants, data.gt, kept, data.loci, data.removed, data.header, data.filtered)
    per_group = _counts(data, True)
    total = per_group.groupBy("row_id").agg(F.sum("alt").alias("alt"), F.sum("nobs").alias("nobs")).withColumn("grp", F.lit(None).cast("string"))
    sites = per_group.unionByName(total.select(*per_group.columns)).where(F.col("nobs") >= MIN_ALLELES)
    # sites of equal counts have equal terms: the harmonic numbers are computed once per distinct pair
    same = sites.groupBy("grp", "alt", "nobs").agg(F.count(F.lit(1)).alias("m"))
    p, n = F.col("alt") / F.col("nobs"), F.col("nobs")
    term = F.when((p > 0) & (p < 1), 1 / harmonic(n - 1)).otherwise(0.0)
    sums = same.groupBy("grp").agg((F.sum(F.col("m") * term) / F.sum("m")).alias("theta_w"), (F.sum(F.col("m") * _two_pq(p, n)) / F.sum("m")).alias("pi"), F.sum("m").alias("n_sites"))
    sizes = kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n_ind"))
    sizes = sizes.unionByName(kept.agg(F.count(F.lit(1)).alias("n_ind")).withColumn("grp", F.lit(None).cast("string")))
    return sizes.withColumnRenamed("grp", "_g").join(sums, F.col("_g").eqNullSafe(F.col("grp")), "left").select(F.col("_g").alias("grp"), "theta_w", "pi", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), "n_ind")


def sample_statistics(data: Genotypes, with_theta: bool = False, f_ref: str = "all") -> DataFrame:
    """The table of one row per sample, with group means of F; order it by grp (nulls last) and sample when writing."""
    m = per_sample(data)
    hom = F.col("homozygotes_ref") + F.col("homozygotes_alt")
    out = m.select(
        "sample_idx", "sample", F.try_divide(F.col("dp_sum"), F.col("dp_n")).alias("read_depth"), F.try_divide(F.col("heterozygotes"), hom + F.col("heterozygotes")).alias("heterozygosity"), "heterozygotes", hom.alias("homozygotes"), "homozygotes_ref", "homozygotes_alt",
        F.try_divide(F.col("total_loci") - F.col("non_missing"), F.col("total_loci")).alias("missing_p"), (F.col("total_loci") - F.col("non_missing")).alias("missing_n"), "non_missing", "total_loci", F.col("grp").alias("group"),
    ).join(inbreeding(data, f_ref), "sample_idx")
    mean = F.when(F.col("group").isNotNull(), F.avg("F").over(Window.partitionBy("group")))
    out = out.withColumn("F_group_mean", mean)
    if with_theta:
        t = theta(data)
        per_group, whole = t.where("grp IS NOT NULL"), t.where("grp IS NULL")
        out = out.join(F.broadcast(per_group.select(F.col("grp").alias("group"), "theta_w", "pi", "n_ind")), "group", "left")
        out = out.join(F.broadcast(whole.select(F.lit(1).alias("_k"), F.col("theta_w").alias("theta_total"), F.col("pi").alias("pi_total"))), F.lit(1) == F.col("_k"), "left").drop("_k")
    return out.drop("sample_idx")


def missing_table(data: Genotypes) -> DataFrame:
    """sample, group, missing_n, missing_p, total_loci."""
    m = per_sample(data)
    n = F.col("total_loci") - F.col("non_missing")
    return m.select("sample", F.col("grp").alias("group"), n.alias("missing_n"), F.try_divide(n, F.col("total_loci")).alias("missing_p"), "total_loci")


def drawn_points(data: Genotypes, max_points_per_sample: int = 5000, seed: int = 0) -> DataFrame:
    """Called genotypes with a depth, each drawn with probability max_points / variants.

    The draw is a hash of row, sample and seed: it is repeatable and does not depend on partitions.
    """
    n = data.variants.count()
    p = 1.0 if n <= max_points_per_sample else max_points_per_sample / n
    u = F.conv(F.substring(draw_key(seed, "row_id", "sample_idx"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return data.live("row_id", "sample_idx", "a1", "a2", "dp").where(called() & F.col("dp").isNotNull() & (u < p))


def coverage_points(data: Genotypes, max_points_per_sample: int = 5000, seed: int = 0) -> DataFrame:
    """sample, group, dp, log10_dp of drawn_points."""
    drawn = drawn_points(data, max_points_per_sample, seed)
    return drawn.join(data.sample_list("sample", "grp"), "sample_idx").select("sample", F.col("grp").alias("group"), "dp", F.when(F.col("dp") > 0, F.log10("dp")).alias("log10_dp"))


def write_table(df: DataFrame, path: str) -> None:
    """One row per sample as CSV: comma, no quotes, missing as NA; by the driver, as the table is no larger than the samples."""
    rows = df.orderBy(F.col("group").asc_nulls_last(), "sample").toPandas()
    with open(path, "w") as out:
        out.write(",".join(rows.columns) + "\n")
        for r in rows.astype(object).itertuples(index=False):
            out.write(",".join("NA" if x is None or x != x else str(x) for x in r) + "\n")
