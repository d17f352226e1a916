"""The genotype data set: a variant table and a long genotype table, immutable and lazily evaluated."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilake.functions.numbering import numbered
from varilake.operators.profile import numeric_text
from varilake.session import materialize, stamp, written_folder

VARIANT_COLUMNS = ("row_id", "chrom", "pos", "id", "ref", "alt", "qual", "filter", "rk", "rpt", "n_alt", "is_biallelic", "is_indel", "info", "format")
GENOTYPE_COLUMNS = ("row_id", "sample", "sample_idx", "a1", "a2", "phased", "fmt", "dp", "gq", "adr")
LOCUS = ("chrom", "pos", "ref", "alt")
MAX_SAMPLES = 100_000
"""Samples of a data set are a list held by the driver and sent to tasks; more are an error."""


@dataclass(frozen=True)
class Genotypes:
    """variants: one row per variant. gt: one row per variant and sample; rows of variants or samples that were
    filtered away may still be there and are left out by live(). samples: sample_idx (order), sample, grp.
    loci: the locus of every variant of the source, never filtered. removed: variants removed as invariant.
    """

    variants: DataFrame
    gt: DataFrame
    samples: DataFrame
    loci: DataFrame
    removed: DataFrame
    header: tuple[str, ...] = ()
    filtered: frozenset[str] = field(default=frozenset())
    report: dict[str, int] = field(default_factory=dict)
    """What a reader found odd: counts by kind."""

    @property
    def spark(self) -> SparkSession:
        return self.variants.sparkSession

    def live(self, *columns: str) -> DataFrame:
        """Genotype rows of current variants and samples; a semi join for what was filtered and none for the rest."""
        gt = self.gt.select(*columns) if columns else self.gt
        if "samples" in self.filtered:
            gt = gt.join(self.sample_list(), "sample_idx", "left_semi")
        if "variants" in self.filtered:
            gt = gt.join(self.variants.select("row_id"), "row_id", "left_semi")
        return gt

    def sample_list(self, *columns: str) -> DataFrame:
        """The samples for a broadcast join, which MAX_SAMPLES makes safe: all readers count them."""
        return F.broadcast(self.samples.select("sample_idx", *columns))

    def with_variants(self, variants: DataFrame) -> Genotypes:
        return replace(self, variants=variants, filtered=self.filtered | {"variants"})

    def with_samples(self, samples: DataFrame) -> Genotypes:
        return replace(self, samples=samples, filtered=self.filtered | {"samples"})

    def with_genotypes(self, gt: DataFrame) -> Genotypes:
        """For genotypes made from live(): nothing is left to restrict."""
        return replace(self, gt=gt, filtered=frozenset())

    def __getitem__(self, key: tuple) -> Genotypes:
        """x[rows, samples]: rows and samples by position from 0 (negative ones count from the end), or by a list, slice or
        mask of booleans of these; samples also by name; None keeps all.

        Positions of rows are in row_id order. A mask must be as long as what it selects from; an unknown name or a
        position out of range is an error. Samples keep their order. No variant is dropped for becoming invariant.
        """
        rows, cols = key
        out = self
        if rows is not None:
            places = _places(rows, self.variants.count())
            placed = numbered(self.variants.select("row_id"), "row_id").select("row_id", F.col("n").alias("_n"))
            chosen = self.spark.createDataFrame([(i + 1,) for i in places], "_n BIGINT")
            out = self.with_variants(self.variants.join(placed.join(chosen, "_n", "left_semi"), "row_id", "left_semi"))
        if cols is None:
            return out
        listed = [(r[0], r[1]) for r in self.samples.orderBy("sample_idx").select("sample_idx", "sample").collect()]
        asked = [cols] if isinstance(cols, str) else cols
        if not isinstance(asked, slice) and len(asked := list(asked)) and isinstance(asked[0], str):
            at = {name: i for i, (_, name) in enumerate(listed)}
            if missing := [c for c in asked if c not in at]:
                raise KeyError(f"unknown samples: {missing}")
            asked = [at[c] for c in asked]
        return out.with_samples(self.samples.where(F.col("sample_idx").isin([listed[i][0] for i in _places(asked, len(listed))])))

    def summary(self) -> dict[str, object]:
        """Counts of variants by type, samples by group, share of missing and number of phased genotypes."""
        v = self.variants.agg(
            F.count(F.lit(1)).alias("variants"),
            F.count_if(F.col("is_biallelic") & ~F.col("is_indel")).alias("biallelic_snvs"),
            F.count_if(~F.col("is_biallelic") & ~F.col("is_indel")).alias("multiallelic_snvs"),
            F.count_if("is_indel").alias("indels"),
        ).first()
        g = self.live("row_id", "sample_idx", "a1", "phased").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a1").isNull()).alias("missing"), F.count_if("phased").alias("phased")).first()
        groups = {r[0]: r[1] for r in self.samples.groupBy("grp").count().collect()}
        return v.asDict() | {"samples": sum(groups.values()), "groups": groups, "missing_percent": 100 * g["missing"] / g["n"] if g["n"] else None, "phased": g["phased"]}

    def copy(self) -> Genotypes:
        """The same data set computed and stored once in the shared folder: for reuse after a long chain of filters.

        Genotypes that filters only hid are kept, so that merging can still recover them; nothing is shared with the
        source but the list of samples.
        """
        kept = self.gt.join(self.sample_list(), "sample_idx", "left_semi") if "samples" in self.filtered else self.gt
        return replace(self, variants=materialize(self.variants), gt=materialize(kept), loci=materialize(self.loci), removed=materialize(self.removed), filtered=self.filtered - {"samples"})

    def preview(self, n: int = 5) -> DataFrame:
        return self.variants.orderBy("row_id").limit(n)


def empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def _places(chosen: object, n: int) -> list[int]:
    """Positions 0 to n - 1 that an index, slice, list or mask selects."""
    if isinstance(chosen, slice):
        return list(range(n))[chosen]
    chosen = [chosen] if isinstance(chosen, int) and not isinstance(chosen, bool) else list(chosen)
    if chosen and all(isinstance(c, bool) for c in chosen):
        if len(chosen) != n:
            raise IndexError(f"a mask of {len(chosen)} for {n}")
        return [i for i, c in enumerate(chosen) if c]
    if bad := [c for c in chosen if not -n <= c < n]:
        raise IndexError(f"positions out of range: {bad[:5]}")
    return sorted({c % n for c in chosen})


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of rows that differ, the one that is least by its columns in order, so the choice is repeatable."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def _cleaned(variants: DataFrame, gt: DataFrame, ranges: bool = False) -> tuple[DataFrame, DataFrame]:
    """Each variant and each genotype once, values outside a field's domain missing; see from_tables.

    Both are brought together by row_id first (ranges: by ranges of it), which is all the shuffling that taking them
    once, and anything that is done per variant afterwards, needs.
    """
    together = lambda df: df.repartitionByRange("row_id") if ranges else df.repartition("row_id")
    variants = _first(together(variants.select(*VARIANT_COLUMNS)), ["row_id"]).withColumn("qual_num", numeric_text(F.col("qual")))
    called = (F.col("a1") >= 0) & (F.col("a2") >= 0)
    number = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(c), F.col(c)).alias(c)
    gt = _first(together(gt.select(*GENOTYPE_COLUMNS)), ["row_id", "sample_idx"])
    return variants, gt.select("row_id", "sample", "sample_idx", *(F.when(called, F.col(a)).alias(a) for a in ("a1", "a2")), "phased", "fmt", *(number(c) for c in ("dp", "gq", "adr")))


def _checked(samples: DataFrame) -> DataFrame:
    if (n := samples.count()) > MAX_SAMPLES:
        raise ValueError(f"{n} samples; at most {MAX_SAMPLES}")
    return samples.select("sample_idx", "sample", "grp")


def _whole(variants: DataFrame, gt: DataFrame, samples: DataFrame, header: tuple[str, ...]) -> Genotypes:
    return Genotypes(variants, gt, samples, variants.select("row_id", *LOCUS, "format"), empty_like(variants), tuple(header))


def from_tables(variants: DataFrame, gt: DataFrame, samples: DataFrame, header: tuple[str, ...] = ()) -> Genotypes:
    """A data set from tables that may hold rows twice; nothing is written, so every action cleans them anew (see ingest).

    A variant is taken once per row_id and a genotype once per row_id and sample; of repeated rows that differ the one
    that is least by its columns. A genotype with a null or negative allele is missing as a whole. Depths that are NaN
    or negative are null; qual becomes a number, null if it is none. Values outside a field's domain are so treated like
    missing ones by every operator.
    """
    return _whole(*_cleaned(variants, gt), _checked(samples), header)


def store(variants: DataFrame, gt: DataFrame, samples: DataFrame, header: tuple[str, ...], path: str, chunk_size: int = 0, n_samples: int = 1) -> Genotypes:
    """Writes clean tables, whose partitions are ranges of row_id, to Parquet in order, so that files and row groups are
    pruned by it, and opens them. chunk_size: variants per file at most, 0 for no limit."""
    for name, df, order, most in (("variants", variants, ["row_id"], chunk_size), ("gt", gt, ["row_id", "sample_idx"], chunk_size * n_samples)):
        df.sortWithinPartitions(*order).write.option("maxRecordsPerFile", most).parquet(f"{path}/{name}")
    samples.coalesce(1).write.parquet(f"{path}/samples")
    variants.sparkSession.createDataFrame(list(enumerate(header)), "i INT, line STRING").coalesce(1).write.parquet(f"{path}/header")
    return open_dataset(variants.sparkSession, path)


def open_dataset(spark: SparkSession, path: str) -> Genotypes:
    """A data set that store or ingest has written."""
    variants, gt, samples, header = (spark.read.parquet(f"{path}/{t}") for t in ("variants", "gt", "samples", "header"))
    return _whole(variants, gt, _checked(samples), [r[0] for r in header.orderBy("i").select("line").collect()])


def ingest(variants: DataFrame, gt: DataFrame, samples: DataFrame, path: str | None = None, header: tuple[str, ...] = ()) -> Genotypes:
    """from_tables, cleaned once and stored: at path, or in the shared folder until the application ends.

    Filters on variants reach the scan of what is stored, and counts per variant need one exchange of one row each.
    """
    return store(*_cleaned(variants, gt, ranges=True), _checked(samples), header, path or f"{written_folder(variants.sparkSession)}/{uuid.uuid4().hex}")


_STORED: dict[tuple, str] = {}


def load(spark: SparkSession, folder: str) -> Genotypes:
    """The tables variants, gt and samples of a folder, ingested once per application and state of their files."""
    tables = [f"{folder}/{t}.parquet" for t in ("variants", "gt", "samples")]
    key = (spark.sparkContext.applicationId, *(stamp(spark, t) for t in tables))
    if (path := _STORED.get(key)) is None or stamp(spark, path) is None:
        path = _STORED[key] = f"{written_folder(spark)}/{uuid.uuid4().hex}"
        ingest(*(spark.read.parquet(t) for t in tables), path)
    return open_dataset(spark, path)
