"""Merging data sets of different samples by locus (chrom, pos, ref, alt); two null positions are equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilake.model import GENOTYPE_COLUMNS, LOCUS, Genotypes, empty_like
from varilake.session import materialize


def _same(left: str, right: str) -> Column:
    return reduce(Column.__and__, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in LOCUS))


def _unique(rows: DataFrame) -> None:
    if not rows.groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("a data set holds a locus more than once; see first_of_locus")


def first_of_locus(data: Genotypes) -> Genotypes:
    """Without later variants of a locus that an earlier row_id has."""
    first = F.row_number().over(Window.partitionBy(*LOCUS).orderBy("row_id"))
    return data.with_variants(data.variants.withColumn("_i", first).where("_i = 1").drop("_i"))


def bind(*parts: Genotypes, mode: str = "intersect", absent_as: str = "missing", outgroup: bool = False, recover_loci: bool = False) -> Genotypes:
    """One data set of all samples.

    intersect: loci live in every part. union: loci live or removed as invariant in any part, the first part's row
    wins; with recover_loci a part also gives genotypes of loci that it filtered but whose rows it still has. outgroup:
    just the first part's live loci, other parts giving whatever genotypes they still have. row_ids of the first
    part's source stay; loci new to it are numbered after its last. A sample without a genotype at a locus is missing
    (./.), or 0/0 if absent_as is hom_ref, unless the mode is intersect. Samples occurring twice, and a locus occurring
    twice in a part, are errors.
    """
    if len(parts) < 2 or mode not in ("intersect", "union") or absent_as not in ("missing", "hom_ref"):
        raise ValueError("bind takes two or more data sets, mode intersect or union, absent_as missing or hom_ref")
    listed = [p.samples.select("sample_idx", "sample", "grp").collect() for p in parts]  # bounded lists
    names = [r["sample"] for rows in listed for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("sample names of the data sets overlap")
    union = mode == "union" and not outgroup
    columns = parts[0].variants.columns
    # written once: each is looked at several times below, and filters before it may be long
    offered = [materialize(p.variants.select(*columns).unionByName(p.removed.select(*columns)) if union else p.variants) for p in parts]
    for rows in offered:
        _unique(rows)
    base = parts[0]
    if union:
        ranked = reduce(DataFrame.unionByName, (rows.withColumn("_part", F.lit(i)) for i, rows in enumerate(offered)))
        first = F.row_number().over(Window.partitionBy(*LOCUS).orderBy("_part", "row_id"))
        every = ranked.withColumn("_i", first).where("_i = 1").drop("_i")
        old = every.where("_part = 0").drop("_part")
        new = every.where("_part > 0")
        last = base.loci.agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
        # ids after the last one, in order of part and row_id: parts are few, ids of a part keep their distances
        spans = {r[0]: (r[1], r[2]) for r in new.groupBy("_part").agg(F.min("row_id"), F.max("row_id")).collect()}
        shift, at = F.lit(0).cast("bigint"), last + 1
        for part in sorted(spans):
            low, high = spans[part]
            shift = F.when(F.col("_part") == part, F.lit(at - low)).otherwise(shift)
            at += high - low + 1
        known = new.alias("n").join(base.loci.select("row_id", *LOCUS).groupBy(*LOCUS).agg(F.min("row_id").alias("_known")).alias("l"), _same("n", "l"), "left").select("n.*", "l._known")
        new = known.withColumn("row_id", F.coalesce("_known", F.col("row_id") + shift)).drop("_known", "_part")
        target = old.unionByName(new.select(*old.columns))
    else:
        target = offered[0]
        for rows in offered[1:] if not outgroup else ():
            target = target.alias("t").join(rows.select(*LOCUS).alias("o"), _same("t", "o"), "left_semi").select("t.*")
    target = materialize(target)
    pieces, everyone, offset = [], [], 0
    for p, rows, live in zip(parts, listed, offered, strict=True):
        offers = p.loci if outgroup or recover_loci else live
        ids = offers.groupBy(*LOCUS).agg(F.min("row_id").alias("_from"))
        pairs = target.select("row_id", *LOCUS).alias("t").join(ids.alias("o"), _same("t", "o")).select(F.col("t.row_id").alias("_to"), F.col("o._from").alias("row_id"))
        gt = p.gt.join(p.sample_list(), "sample_idx", "left_semi").join(pairs, "row_id").drop("row_id").withColumnRenamed("_to", "row_id")
        pieces.append(gt.withColumn("sample_idx", (F.col("sample_idx") + offset).cast("int")).select(*GENOTYPE_COLUMNS))
        everyone += [(r["sample_idx"] + offset, r["sample"], r["grp"]) for r in rows]
        offset += max((r["sample_idx"] for r in rows), default=-1) + 1
    gt = reduce(DataFrame.unionByName, pieces)
    samples = base.spark.createDataFrame(everyone, "sample_idx INT, sample STRING, grp STRING")
    if union or outgroup:
        # written once: filling looks at it twice
        gt = fill_gaps(materialize(gt), target, samples, absent_as)
    removed = empty_like(target) if union else base.removed
    loci = base.loci.unionByName(target.select("row_id", *LOCUS, "format").join(base.loci.select("row_id"), "row_id", "left_anti"))
    return Genotypes(target, gt, samples, loci, removed, base.header)


def fill_gaps(gt: DataFrame, variants: DataFrame, samples: DataFrame, absent_as: str) -> DataFrame:
    """gt with a row for every variant and sample. The samples are a bounded list: each variant looks up which of them
    it has, and only the missing ones become rows; the full grid is never joined."""
    every = [(r[0], r[1]) for r in samples.orderBy("sample_idx").select("sample_idx", "sample").collect()]
    placed = F.broadcast(samples.sparkSession.createDataFrame([(o, i, s) for o, (i, s) in enumerate(every)], "o INT, sample_idx INT, sample STRING"))
    has = gt.join(placed.drop("sample"), "sample_idx").groupBy("row_id").agg(F.collect_set("o").alias("_has"))
    listed = F.sequence(F.lit(0), F.lit(len(every) - 1)) if every else F.array().cast("array<int>")
    gaps = variants.select("row_id").join(has, "row_id", "left").select("row_id", F.explode(F.array_except(listed, F.coalesce("_has", F.array().cast("array<int>")))).alias("o"))
    allele, text = (F.lit(0), "0/0") if absent_as == "hom_ref" else (F.lit(None), "./.")
    filled = gaps.join(placed, "o").select(
        "row_id", "sample", "sample_idx", allele.cast("int").alias("a1"), allele.cast("int").alias("a2"), F.lit(None).cast("boolean").alias("phased"), F.lit(text).alias("fmt"), *(F.lit(None).cast("double").alias(c) for c in ("dp", "gq", "adr"))
    )
    return gt.unionByName(filled)


def bind_sparse(*parts: Genotypes, **options: object) -> Genotypes:
    """bind with recover_loci, under its old name."""
    return bind(*parts, **({"recover_loci": True} | options))
