"""VCF text: read into a data set, and written from one."""

from __future__ import annotations

import uuid
import warnings
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from varilake.model import MAX_SAMPLES, Genotypes, store
from varilake.operators.profile import numeric_text
from varilake.plans.layout import PROGRAM, dense, places, write_lines, write_parts
from varilake.session import written_folder

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
MAX_POS = 2**53
MAX_ALLELE = 1_000_000
# a number as VCF writes it; what Java also takes for one ("1d", "inf", blanks) is none
NUMBER = r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_ALLELE = r"(?:\.|[0-9]+)"


def header_lines(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The lines up to #CHROM. An error if there is none, or data before it; only the file's beginning is read."""
    out = []
    for row in spark.read.text(path).toLocalIterator():
        line = row[0].rstrip("\r")
        if not line.startswith("#"):
            raise ValueError("data before the #CHROM line")
        out.append(line)
        if line.startswith("#CHROM"):
            return tuple(out)
    raise ValueError("no #CHROM line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id from 1 in file order, and line, of all data lines. Blank lines are dropped, line ends may be CRLF.

    Lines are numbered within each split of the file; the splits' first numbers come from counting their lines, so no
    task sees more than its split. A gzip file is one split; it is spread over the cluster after numbering.
    """
    text = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    data = text.where(~F.col("line").startswith("#") & (F.col("line") != "")).withColumn("i", F.monotonically_increasing_id())
    splits = data.groupBy("f", "b").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("m"))
    table, upto = [], 0
    for r in splits.orderBy("f", "b").collect():  # one row per split of the file
        table.append((r["f"], r["b"], upto - r["first"]))
        upto += r["m"]
    shifts = spark.createDataFrame(table, "f STRING, b BIGINT, shift BIGINT")
    out = data.join(shifts, ["f", "b"]).select((F.col("i") + F.col("shift") + 1).alias("row_id"), "line")
    return out.repartitionByRange("row_id") if path.endswith(".gz") else out


def alleles(gt: Column) -> dict[str, Column]:
    """a1, a2, phased and kind of a GT text.

    Two alleles are as written, one counts twice (haploid); a half-missing call is missing, so are more alleles
    (polyploid, not phased) and anything else (malformed). The first separator decides phased, also for calls that
    are missing.
    """
    small = lambda a: (a == ".") | (F.length(F.regexp_replace(a, "^0+(?=[0-9])", "")) < 7) | (F.regexp_replace(a, "^0+(?=[0-9])", "") == str(MAX_ALLELE))
    parts = F.split(gt, "[/|]", -1)
    n = F.size(parts)
    shaped = gt.rlike(rf"^{_ALLELE}(?:[/|]{_ALLELE})*\z") & F.forall(parts, small)
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    number = lambda a: F.when(a != ".", a.try_cast("int"))
    half = (n == 2) & ((one == ".") != (two == "."))
    good = shaped & (n <= 2) & ~half
    first = F.regexp_extract(gt, rf"^({_ALLELE})[/|]", 1)
    separator = F.regexp_extract(gt, rf"^{_ALLELE}([/|])", 1)
    kind = F.when(~F.coalesce(shaped, F.lit(False)), "malformed").when(n > 2, "polyploid").when(half, "half_missing").when(n == 1, "haploid").otherwise("diploid")
    return {
        "a1": F.when(good, number(one)),
        "a2": F.when(good, number(F.when(n == 1, one).otherwise(two))),
        "phased": F.coalesce((separator == "|") & small(first) & ~(shaped & (n > 2)), F.lit(False)),
        "kind": kind,
    }


def number_of(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def info_number(info: Column, key: str) -> Column:
    """The first value of a key, which must stand at the beginning of an entry; null if it is no number."""
    return number_of(F.nullif(F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1), F.lit("")))


def parse_variants(lines: DataFrame) -> DataFrame:
    """row_id, the fixed fields and what is derived from them. Missing columns of a short line are empty text."""
    f = F.split("line", "\t", -1)
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    v = lines.select("row_id", *(at(i).alias(c) for i, c in enumerate(FIXED)))
    pos = F.when(F.col("pos").rlike(r"^[0-9]{1,17}\z"), F.col("pos").cast("bigint"))
    pos = F.when(pos <= MAX_POS, pos.cast("double"))
    return v.withColumns({
        "pos": pos, "rk": info_number(F.col("info"), "Rk"), "rpt": info_number(F.col("info"), "RPT"),
        "n_alt": F.regexp_count("alt", F.lit(",")) + 1, "is_biallelic": ~F.col("alt").contains(","),
        "is_indel": (F.length("ref") != 1) | F.col("alt").rlike("[^,]{2,}") | F.col("alt").rlike("(?:^|,),"),
    })


def parse_genotypes(lines: DataFrame, n_samples: int | Column) -> DataFrame:
    """row_id, sample_idx from 0, alleles, fmt, dp, gq, adr, kind, n_samples: a row for every line and sample.

    GT, DP, GQ and AD are found by name in FORMAT. Absent trailing samples are missing, with empty text. adr is the
    alternate share of the first two AD values at sites with one alternate, where their sum is positive.
    """
    f = F.split("line", "\t", -1)
    n = n_samples if isinstance(n_samples, Column) else F.lit(n_samples)
    # absent trailing samples are nulls: no place of a line is looked up by a list of samples
    samples = F.slice(F.concat(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))), F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)
    wide = lines.select("row_id", n.alias("n_samples"), F.get(f, F.lit(4)).alias("alt"), F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ":", -1).alias("keys"), F.posexplode(samples).alias("sample_idx", "raw"))
    values = F.split(F.coalesce("raw", F.lit("")), ":", -1)
    value = lambda key: F.get(values, (F.nullif(F.array_position("keys", key), F.lit(0)) - 1).cast("int"))
    gt = alleles(F.coalesce(value("GT"), F.lit("")))
    ad = F.split(value("AD"), ",", -1)
    ref, alt = (number_of(F.get(ad, F.lit(i))) for i in range(2))
    kind = F.when(F.col("raw").isNull(), "absent").when(F.array_position("keys", "GT") == 0, "no_gt").otherwise(gt["kind"])
    return wide.select(
        "row_id", "sample_idx", gt["a1"].alias("a1"), gt["a2"].alias("a2"), gt["phased"].alias("phased"), F.coalesce("raw", F.lit("")).alias("fmt"), number_of(value("DP")).alias("dp"), number_of(value("GQ")).alias("gq"),
        F.when(~F.coalesce("alt", F.lit("")).contains(",") & (ref + alt > 0), alt / (ref + alt)).alias("adr"), kind.alias("kind"), "n_samples",
    )


REPORT = ("haploid", "half_missing", "polyploid", "malformed", "short_lines", "no_gt_lines")


def _report_counts(last: Column) -> list[Column]:
    """Counts of REPORT over parsed genotypes; a short line lacks its last sample, a line without GT has it nowhere."""
    kinds = {k: F.col("kind") == k for k in REPORT[:4]}
    kinds |= {"short_lines": (F.col("kind") == "absent") & (F.col("sample_idx") == last), "no_gt_lines": (F.col("kind") == "no_gt") & (F.col("sample_idx") == 0)}
    return [F.count_if(c).alias(k) for k, c in kinds.items()]


def parse_report(lines: DataFrame, n_samples: int | Column) -> DataFrame:
    """One row: how many genotypes were haploid, half_missing, polyploid, malformed, and lines short or without GT."""
    return parse_genotypes(lines, n_samples).agg(*_report_counts(F.col("n_samples") - 1))


def read_vcf(spark: SparkSession, path: str, chunk_size: int = 50_000, store_at: str | None = None) -> Genotypes:
    """A data set from a plain or gzip VCF file, parsed once and stored as Parquet by row_id.

    chunk_size: variants per stored file at most. It is stored at store_at, or in the shared folder until the
    application ends. What the parser found odd is counted while it is written, and given as a warning and in report.
    """
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    header = header_lines(spark, path)
    names = header[-1].split("\t")[9:]
    if len(names) > MAX_SAMPLES:
        raise ValueError(f"{len(names)} samples; at most {MAX_SAMPLES}")
    lines = numbered_lines(spark, path)
    variants = parse_variants(lines).withColumn("qual_num", numeric_text(F.col("qual")))
    samples = spark.createDataFrame([(i, s, None) for i, s in enumerate(names)], "sample_idx INT, sample STRING, grp STRING")
    counts = Observation()
    gt = parse_genotypes(lines, max(len(names), 1)).observe(counts, *_report_counts(F.col("n_samples") - 1))
    gt = (gt if names else gt.where(F.lit(False))).join(F.broadcast(samples.drop("grp")), "sample_idx").select("row_id", "sample", "sample_idx", "a1", "a2", "phased", "fmt", "dp", "gq", "adr")
    out = store(variants, gt, samples, header, store_at or f"{written_folder(spark)}/{uuid.uuid4().hex}", chunk_size, max(len(names), 1))
    report = dict(counts.get)
    if odd := {k: v for k, v in report.items() if v}:
        warnings.warn(f"{path}: {odd}", stacklevel=2)
    return replace(out, report=report)


def general(x: Column) -> Column:
    """A number as C writes it with %g: six significant digits, no trailing zeros."""
    trimmed = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")
    size = F.floor(F.log10(x))
    fixed = F.lit(None).cast("string")
    for e in range(-4, 6):
        fixed = F.when(size == e, F.format_string(f"%.{5 - e}f", x)).otherwise(fixed)
    return F.when(x == 0, "0").otherwise(trimmed(F.coalesce(fixed, F.format_string("%.5e", x))))


def update_info(data: Genotypes) -> DataFrame:
    """row_id, info with AC, AN, AF and NS, where an entry has them, computed from the live genotypes.

    Only the first entry of a key is replaced. AF is `.` without calls. A haploid call counts as two alleles.
    """
    gt = data.gt.join(data.sample_list(), "sample_idx", "left_semi") if "samples" in data.filtered else data.gt
    called = gt.where("a1 IS NOT NULL AND a2 IS NOT NULL").select("row_id", "a1", "a2")
    per = called.groupBy("row_id", "a1", "a2").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.array(F.struct(F.col("a1").alias("a")), F.struct(F.col("a2").alias("a")))
    counts = per.select("row_id", "m", F.explode(pairs).alias("x")).groupBy("row_id", F.col("x.a").alias("a")).agg(F.sum("m").alias("m"))
    held = counts.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "m"))).alias("_m"), F.sum("m").alias("_an"))
    v = data.variants.select("row_id", "alt", "info").join(held, "row_id", "left")
    an = F.coalesce("_an", F.lit(0))
    n_alt = F.regexp_count(F.coalesce("alt", F.lit("")), F.lit(",")) + 1
    count = F.transform(F.sequence(F.lit(1), n_alt), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0)))
    texts = {
        "AC": F.array_join(F.transform(count, lambda c: c.cast("string")), ","),
        "AN": an.cast("string"),
        "AF": F.array_join(F.transform(count, lambda c: F.when(an > 0, general(c / an)).otherwise(".")), ","),
        "NS": (an / 2).cast("bigint").cast("string"),
    }
    info = F.col("info")
    for key, text in texts.items():
        first = rf"^((?:.*?;)??){key}=[^;]*"
        info = F.when(F.col("info").rlike(rf"(?:^|;){key}="), F.concat(F.regexp_extract(info, rf"{first}", 1), F.lit(f"{key}="), text, F.regexp_extract(info, rf"{first}(.*)$", 2))).otherwise(info)
    return v.select("row_id", info.alias("info"))


def vcf_lines(data: Genotypes, updated: bool = True) -> DataFrame:
    """row_id, line: one VCF line per live variant with a position, the samples in order; empty fields are `.`."""
    order, n = places(data)
    held = data.gt.join(order, "sample_idx").groupBy("row_id").agg(F.collect_list(F.struct("o", "fmt")).alias("_p"))
    v = data.variants.where("pos IS NOT NULL")
    if updated:
        v = v.drop("info").join(update_info(data), "row_id")
    dot = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    fields = [dot(F.col("pos").cast("bigint").cast("string")) if c == "pos" else dot(F.col(c)) for c in FIXED]
    cells = F.transform(dense(F.col("_p"), n, "fmt", "string", F.lit(".")), lambda x: dot(x["fmt"]))
    return v.join(held, "row_id", "left").select("row_id", F.concat_ws("\t", *fields, cells).alias("line"))


def write_vcf(data: Genotypes, path: str, updated: bool = True, parts: bool = False) -> None:
    """One file, gzip if its name ends so; the header with a line naming this program once. With parts, a folder of files
    that the tasks write, which make up the file in the order of their names (layout.write_parts).

    Variants without a position can't be written; that, and variants out of order, is a warning.
    """
    if n := data.variants.where("pos IS NULL").count():
        warnings.warn(f"{n} variants without a position are not written", stacklevel=2)
    if not is_sorted(data):
        warnings.warn("the variants are not sorted by chrom and position; tools that index the file may refuse it", stacklevel=2)
    names = [r[0] for r in data.samples.orderBy("sample_idx").select("sample").collect()]
    source = f"##source={PROGRAM}"
    meta = [h for h in data.header if not h.startswith("#CHROM")] or ["##fileformat=VCFv4.2"]
    head = [*meta, *([] if source in meta else [source]), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    if parts:
        write_parts(vcf_lines(data, updated), path, ["row_id"], head, path.endswith(".gz"))
    else:
        write_lines(vcf_lines(data, updated), path, ["row_id"], head)


ORDER_BLOCK = 1 << 16
"""row_ids whose variants one task compares with their neighbours."""


def is_sorted(data: Genotypes) -> bool:
    """Whether each chrom's variants stand together and their positions do not decrease, in row_id order.

    Neighbours are compared within blocks of row_ids, and the blocks by their first and last variant: no task sees more
    than a block, or one row per block.
    """
    v = data.variants.where("pos IS NOT NULL").select("row_id", "chrom", "pos").withColumn("block", F.floor(F.col("row_id") / ORDER_BLOCK))
    w = Window.partitionBy("block").orderBy("row_id")
    steps = v.withColumns({"_c": F.lag("chrom").over(w), "_p": F.lag("pos").over(w), "_i": F.row_number().over(w)})
    new, back = ~F.col("chrom").eqNullSafe(F.col("_c")), F.col("chrom").eqNullSafe(F.col("_c")) & (F.col("pos") < F.col("_p"))
    inner = steps.where("_i > 1").groupBy("block").agg(F.bool_or(back).alias("back"))
    ends = v.groupBy("block").agg(F.min_by(F.struct("chrom", "pos"), "row_id").alias("a"), F.max_by(F.struct("chrom", "pos"), "row_id").alias("b"))
    follow = ends.withColumn("_b", F.lag("b").over(Window.orderBy("block")))  # one row per block
    across = F.col("a.chrom").eqNullSafe(F.col("_b.chrom"))
    if not inner.where("back").isEmpty() or not follow.where(across & (F.col("a.pos") < F.col("_b.pos"))).isEmpty():
        return False
    # runs of a chrom begin where the variant before has another; a chrom that begins twice is torn
    starts = steps.where((F.col("_i") > 1) & new).select("chrom").unionByName(follow.where(F.col("_b").isNull() | ~across).select("a.chrom"))
    return starts.groupBy("chrom").count().where("count > 1").isEmpty()
