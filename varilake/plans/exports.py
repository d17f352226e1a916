"""The exports. Each gives its lines, or its blocks of lines, as a DataFrame; each write_ function makes the files."""

from __future__ import annotations

import os
import shutil
import sys
import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilake.functions.numbering import numbered
from varilake.model import Genotypes
from varilake.operators.filters import snv_blocks
from varilake.plans.layout import PROGRAM, Layout, alt_copies, base_of, dense, first_base, layout, require_tokens, whole, write_blocks, write_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Groups = list[str] | None
TITLE = f"Generated by {PROGRAM}"

# Fixed values of the formats: base codes, ambiguity codes of two bases
BASE_CODES = {"A": "01", "C": "02", "G": "03", "T": "04"}
AMBIGUITY = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}
MAX_PLINK_CHROM = 95


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _base_code(allele: str) -> Column:
    return _lookup(BASE_CODES, base_of(allele), "00")


def _sequence_letter() -> Column:
    r, a = first_base("ref"), first_base("alt")
    het = _lookup(AMBIGUITY, F.concat(F.least(r, a), F.greatest(r, a)), "N")
    return F.when((F.col("a1") == 0) & (F.col("a2") == 0), r).when((F.col("a1") == 1) & (F.col("a2") == 1), a).otherwise(het)


def _full(allele: str) -> Column:
    return F.when(F.col(allele) == 0, F.col("ref")).otherwise(F.col("alt"))


# sample-major: blocks (o, block, text)


def structure(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    return layout(data, keep_groups).by_allele(lambda a: F.when(F.col(a) == 0, "0").otherwise("1"), "-9", "\t")


def write_structure(data: Genotypes, path: str, keep_groups: Groups = None, method: str = "S") -> None:
    write_blocks(structure(data, keep_groups), path, _structure_prefixes(layout(data, keep_groups), method), "\t")


def _structure_prefixes(lay: Layout, method: str) -> list[str]:
    extra, number = "" if method == "S" else "\t0\t0\t0\t0", {g: i + 1 for i, g in enumerate(lay.group_names)}
    return [f"{n}\t{number[g]}{extra}\t" for n, g in zip(lay.names, lay.groups, strict=True) for _ in range(2)]


def structure_prefixes(data: Genotypes, keep_groups: Groups = None, method: str = "S") -> DataFrame:
    """o, prefix of each of the two lines of a sample: its name, the number of its group, with method F four columns of 0."""
    rows = enumerate(_structure_prefixes(layout(data, keep_groups), method))
    return data.spark.createDataFrame(list(rows), "o INT, prefix STRING")


def write_fstructure(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    write_structure(data, path, keep_groups, "F")


def arlequin(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    return layout(data, keep_groups).by_allele(_full, "?", " ")


def write_arlequin(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    lay = layout(data, keep_groups)
    sizes = {g: lay.groups.count(g) for g in lay.group_names}
    head = ["[Profile]", "", f"Title = '{TITLE}'", f"NbSamples = {len(sizes)}", "GenotypicData = 1", "LocusSeparator = WHITESPACE", "GameticPhase = 0", "MissingData = '?'", "DataType = STANDARD", "", "[Data]", "[[Samples]]", "", f"#There are {lay.variants.count()} SNPs", ""]
    prefix, before = [], ""
    for i, (n, g) in enumerate(zip(lay.names, lay.groups, strict=True)):
        if i == 0 or g != lay.groups[i - 1]:
            before = ("}\n\n" if i else "") + f"SampleName = '{g}'\nSampleSize = {sizes[g]}\nSampleData={{\n"
        prefix += [f"{before}{n}\t1\t", "\t\t\t\t\t\t"]
        before = ""
    tail = ["}", "", "[[Structure]]", "StructureName = 'One Group'", "NbGroups = 1", "", "Group = {", *(f'\t\t"{g}"' for g in sizes), "}"]
    write_blocks(arlequin(data, keep_groups), path, prefix, " ", head, tail)


def genepop(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    a, b = _base_code("a1"), _base_code("a2")
    return layout(data, keep_groups).by_sample(F.concat(F.least(a, b), F.greatest(a, b)), "0000", " ")


def write_genepop(data: Genotypes, path: str, keep_groups: Groups = None, pop_names: bool = False) -> None:
    lay = layout(data, keep_groups)
    prefix = [("" if i and g == lay.groups[i - 1] else (f"pop {g}\n" if pop_names else "Pop\n")) + f"{n}, " for i, (n, g) in enumerate(zip(lay.names, lay.groups, strict=True))]
    with open(path, "w") as out:
        out.write(f"Title = '{TITLE}'\n")
        for i, r in enumerate(lay.variants.orderBy("row_id").select("locus").toLocalIterator()):
            out.write((", " if i else "") + r[0])
        out.write("\n")
    write_blocks(genepop(data, keep_groups), path + ".part", prefix, " ")
    _append(path, path + ".part")


def _append(path: str, part: str) -> None:
    with open(path, "ab") as out, open(part, "rb") as rest:
        shutil.copyfileobj(rest, out)
    os.unlink(part)


def fasta(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    return layout(data, keep_groups).by_sample(_sequence_letter(), "?", "")


def write_fasta(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    write_blocks(fasta(data, keep_groups), path, [f">{n}\n" for n in layout(data, keep_groups).names], "")


def snapp(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    return layout(data, keep_groups).by_sample(alt_copies(), "?", "")


def nexus_labels(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """o, label: each sample's name as the matrix shows it, padded to the longest and three more."""
    lay = layout(data, keep_groups)
    return data.spark.createDataFrame(list(enumerate(_nexus_labels(lay))), "o INT, label STRING")


def _nexus_labels(lay: Layout) -> list[str]:
    width = max((len(n.encode()) for n in lay.names), default=0) + 3
    return [f"    {n}{' ' * (width - len(n.encode()))}" for n in lay.names]


def _nexus(lay: Layout, blocks: DataFrame, path: str, kind: str) -> None:
    head = ["#NEXUS", f"[Data written by {PROGRAM}]", "BEGIN DATA;", f"  DIMENSIONS NTAX={len(lay.names)} NCHAR={lay.variants.count()};", f"  FORMAT DATATYPE={kind} MISSING=? GAP=- INTERLEAVE=NO;", "  MATRIX"]
    write_blocks(blocks, path, _nexus_labels(lay), "", head, ["  ;", "END;"])


def write_nexus(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    _nexus(layout(data, keep_groups), fasta(data, keep_groups), path, "DNA")


def write_snapp(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    _nexus(layout(data, keep_groups), snapp(data, keep_groups), path, 'INTEGERDATA SYMBOLS="012"')


def related(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    a, b = _base_code("a1"), _base_code("a2")
    code = F.when((a == "00") | (b == "00"), "0\t0").otherwise(F.concat(F.least(a, b), F.lit("\t"), F.greatest(a, b)))
    return layout(data, keep_groups).by_sample(code, "0\t0", "\t")


def write_related(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    write_blocks(related(data, keep_groups), path, [f"{n}\t" for n in layout(data, keep_groups).names], "\t")


def apparent(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    a, b = _full("a1"), _full("a2")
    return layout(data, keep_groups).by_sample(F.concat(F.least(a, b), F.lit("/"), F.greatest(a, b)), "-/-", "\t")


def write_apparent(data: Genotypes, path: str, keep_groups: Groups = None, key: str = "All") -> None:
    write_blocks(apparent(data, keep_groups), path, [f"{n}\t{key}\t" for n in layout(data, keep_groups).names], "\t")


def migrate_sequences(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    return layout(data, keep_groups).by_allele(base_of, "?", "")


def migrate_blocks(data: Genotypes, keep_groups: Groups = None, block_size: int = 100, method: str = "S") -> DataFrame:
    """n, label: the loci of a sequence file in order. S: runs of block_size SNVs; N: runs of equal (chrom, interval)."""
    lay = layout(data, keep_groups)
    v = numbered(lay.variants.select("row_id", "chrom", "pos"), "row_id")
    if method == "S":
        return v.groupBy(F.floor((F.col("n") - 1) / block_size).alias("b")).agg(F.count(F.lit(1)).alias("m")).select((F.col("b") + 1).alias("n"), F.format_string("(s%d)", "m").alias("label"))
    first = v.groupBy("chrom").agg(F.min("pos").alias("_p")).withColumnRenamed("chrom", "_c")
    v = v.join(first, F.col("chrom").eqNullSafe(F.col("_c"))).withColumn("i", F.floor((F.col("pos") - F.col("_p")) / block_size))
    # runs: a row that is no neighbour of its predecessor within (chrom, interval) begins one
    before = F.lag("n").over(Window.partitionBy("chrom", "i").orderBy("n"))
    starts = v.withColumn("_s", F.coalesce(before != F.col("n") - 1, F.lit(True)))
    run = F.sum(F.col("_s").cast("int")).over(Window.partitionBy("chrom", "i").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    runs = starts.withColumn("_r", run).groupBy("chrom", "i", "_r").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("m"))
    return numbered(runs.withColumnRenamed("n", "_at"), "_at").select("n", F.format_string("(n%d)", "m").alias("label"))


def write_migrate(data: Genotypes, path: str, keep_groups: Groups = None, block_size: int = 100, method: str = "S") -> None:
    lay = layout(data, keep_groups)
    if bad := [g for g in lay.group_names if g[:1].isdigit()]:
        raise ValueError(f"population names must not begin with a digit: {bad}")
    sizes = [2 * lay.groups.count(g) for g in lay.group_names]
    if method == "C":
        rows = migrate_counts(data, keep_groups).orderBy("g", "row_id").select("g", "line")
        with open(path, "w") as out:
            out.write(f"H {len(sizes)} {migrate_counts(data, keep_groups).where('g = 0').count()} {TITLE}\n")
            at = -1
            for g, line in rows.toLocalIterator():
                while at < g:
                    at += 1
                    out.write(f"{sizes[at]} {lay.group_names[at]}\n")
                out.write(line + "\n")
        return
    blocks = migrate_blocks(data, keep_groups, block_size, method)
    width = max(10, *(len(n.encode()) + 2 for n in lay.names))
    prefix = []
    for i, (n, g) in enumerate(zip(lay.names, lay.groups, strict=True)):
        group = "" if i and g == lay.groups[i - 1] else f"{sizes[lay.group_names.index(g)]} {g}\n"
        prefix += [f"{group if h == 1 else ''}{f'{n}_{h}':<{width}}" for h in (1, 2)]
    with open(path, "w") as out:
        out.write(f"{'N ' if method == 'N' else ''}{len(sizes)} {blocks.count()} {TITLE}\n")
        for i, r in enumerate(blocks.orderBy("n").select("label").toLocalIterator(prefetchPartitions=True)):
            out.write((" " if i else "") + r[0])
        out.write("\n")
    write_blocks(migrate_sequences(data, keep_groups), path + ".part", prefix, "")
    _append(path, path + ".part")


def ped(data: Genotypes, keep_groups: Groups = None, allele_code: str = "nucleotide") -> DataFrame:
    letter = base_of if allele_code == "nucleotide" else lambda a: F.when(F.col(a) == 0, "2").otherwise("1")
    return layout(data, keep_groups).by_sample(F.concat(letter("a1"), F.lit(" "), letter("a2")), "0 0", " ")


def genlight(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """sample, pop, block, geno: alternate copies as an array per sample and block of variants; null where missing."""
    lay = layout(data, keep_groups)
    code = (F.col("a1") + F.col("a2")).cast("string")
    names = F.broadcast(data.spark.createDataFrame([(o, n, g) for o, (n, g) in enumerate(zip(lay.names, lay.groups, strict=True))], "o INT, sample STRING, pop STRING"))
    blocks = lay.by_sample(code, "", ",").join(names, "o")
    return blocks.select("sample", "pop", "block", F.transform(F.split("text", ",", -1), lambda x: F.nullif(x, F.lit("")).cast("tinyint")).alias("geno"))


def write_genlight(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    genlight(data, keep_groups).write.parquet(path)


# long


def gt_long(data: Genotypes, keep_groups: Groups = None, columns: list[str] | None = None) -> DataFrame:
    """Long genotypes of the exported variants and samples."""
    lay = layout(data, keep_groups)
    rows = data.gt.join(lay.order().select("sample_idx", "o"), "sample_idx").join(lay.variants.select("row_id"), "row_id", "left_semi")
    return rows.select("o", *(columns or ["row_id", "sample", "a1", "a2", "phased", "fmt", "dp", "gq", "adr"]))


def write_gt_long(data: Genotypes, path: str, keep_groups: Groups = None, format: str = "parquet", columns: list[str] | None = None) -> None:
    """A folder of files ordered by row_id and sample; format parquet, csv (header, quoted) or arrow (one stream)."""
    columns = columns or ["row_id", "sample", "a1", "a2", "phased", "fmt", "dp", "gq", "adr"]
    rows = gt_long(data, keep_groups, list(dict.fromkeys(["row_id", *columns]))).repartitionByRange("row_id").sortWithinPartitions("row_id", "o").select(*columns)
    if format == "parquet":
        rows.write.parquet(path)
    elif format == "csv":
        rows.write.csv(path, header=True, quoteAll=True)
    elif format == "arrow":
        writer = None
        with pa.OSFile(path, "wb") as sink:
            for row in rows.mapInArrow(_as_bytes, "b BINARY").toLocalIterator():
                for batch in pa.ipc.open_stream(bytes(row[0])):
                    writer = writer or pa.ipc.new_file(sink, batch.schema)
                    writer.write_batch(batch)
            if writer:
                writer.close()
    else:
        raise ValueError("format must be parquet, csv or arrow")


def _as_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])


def bayesass(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """row_id, o, line: sample, group, locus and both alleles (1 REF, 2 ALT), one line per sample and variant."""
    lay = layout(data, keep_groups)
    require_tokens([*lay.names, *lay.group_names], "names of samples and groups")
    names = F.broadcast(data.spark.createDataFrame([(o, f"{n} {g}") for o, (n, g) in enumerate(zip(lay.names, lay.groups, strict=True))], "o INT, who STRING"))
    one = lambda a: F.when(F.col(a) == 0, "1").otherwise("2")
    wide = lay.by_variant(F.concat(one("a1"), F.lit(" "), one("a2")), "0 0")
    return wide.select("row_id", "locus", F.posexplode("codes").alias("o", "c")).join(names, "o").select("row_id", "o", F.concat_ws(" ", "who", "locus", "c").alias("line"))


# What the program that reads the file takes at most
BAYESASS_LIMITS = {"loci": 100_000, "populations": 100, "individuals": 20_000}


def write_bayesass(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    """More loci, populations or individuals than the reading program takes are a warning."""
    lay = layout(data, keep_groups)
    sizes = {"loci": lay.variants.count(), "populations": len(lay.group_names), "individuals": len(lay.names)}
    if over := {k: n for k, n in sizes.items() if n > BAYESASS_LIMITS[k]}:
        warnings.warn(f"more than the program reads: {over}", stacklevel=2)
    write_lines(bayesass(data, keep_groups), path, ["o", "row_id"])


# by population


def population_counts(lay: Layout) -> DataFrame:
    """row_id, g, ref, alt: called alleles of every variant and group, zeros included."""
    ref = (F.col("a1") == 0).cast("int") + (F.col("a2") == 0).cast("int")
    names = F.broadcast(lay.data.spark.createDataFrame(list(enumerate(lay.group_names)), "o INT, grp STRING"))
    counted = lay.cells().drop("o").join(names, "grp").groupBy("row_id", "o").agg(F.sum(ref).alias("ref"), (2 * F.count(F.lit(1)) - F.sum(ref)).alias("alt"))
    held = counted.groupBy("row_id").agg(F.collect_list(F.struct("o", F.struct("ref", "alt").alias("n"))).alias("_p"))
    zero = F.struct(F.lit(0).cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("alt"))
    each = lay.variants.join(held, "row_id", "left").withColumn("_g", F.explode(dense(F.col("_p"), len(lay.group_names), "n", "struct<ref:bigint,alt:bigint>", zero)))
    return each.select("row_id", "pos", F.col("ref").alias("ref_base"), F.col("alt").alias("alt_base"), F.col("_g.o").alias("g"), F.col("_g.n.ref").alias("ref"), F.col("_g.n.alt").alias("alt"))


def treemix(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    counts = population_counts(layout(data, keep_groups))
    cell = F.concat_ws(",", F.col("ref").cast("string"), F.col("alt").cast("string"))
    return counts.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("g", cell.alias("c")))).alias("_c")).select("row_id", F.array_join(F.transform("_c", lambda x: x["c"]), " ").alias("line"))


def write_treemix(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    write_lines(treemix(data, keep_groups), path, ["row_id"], [" ".join(layout(data, keep_groups).group_names)])


def bayescan(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """g, n, line."""
    lay = layout(data, keep_groups)
    number = numbered(lay.variants.select("row_id"), "row_id")
    counts = population_counts(lay).join(number, "row_id")
    return counts.select("g", "n", F.concat_ws("\t", F.col("n").cast("string"), (F.col("ref") + F.col("alt")).cast("string"), F.lit("2"), F.col("ref").cast("string"), F.col("alt").cast("string")).alias("line"))


def write_bayescan(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    lay = layout(data, keep_groups)
    with open(path, "w") as out:
        out.write(f"[loci]={lay.variants.count()}\n\n[populations]={len(lay.group_names)}\n")
        at = -1
        for g, line in bayescan(data, keep_groups).orderBy("g", "n").select("g", "line").toLocalIterator():
            while at < g:
                at += 1
                out.write(f"\n[pop]={at + 1}\n")
            out.write(line + "\n")


def migrate_counts(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """row_id, g, line of variants with calls in every population."""
    counts = population_counts(layout(data, keep_groups))
    seen = F.min(F.col("ref") + F.col("alt")).over(Window.partitionBy("row_id"))
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", F.coalesce(text("pos"), F.lit("NA")), first_base("ref_base"), text("ref"), first_base("alt_base"), text("alt"), (F.col("ref") + F.col("alt")).cast("string"))
    return counts.withColumn("_s", seen).where("_s > 0").select("row_id", "g", line.alias("line"))


# variant-major


def _joined(data: Genotypes, keep_groups: Groups, code: Column, missing: str, sep: str) -> DataFrame:
    return layout(data, keep_groups).by_variant(code, missing).select("row_id", F.array_join("codes", sep).alias("line"))


def eigenstrat(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """row_id, line: copies of REF per sample, 9 missing."""
    return _joined(data, keep_groups, (2 - alt_copies().cast("int")).cast("string"), "9", "")


def smartsnp(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    return _joined(data, keep_groups, alt_copies(), "9", " ")


def snmf(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    return _joined(data, keep_groups, alt_copies(), "9", "")


def write_snmf(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    write_lines(snmf(data, keep_groups), path, ["row_id"])


def write_smartsnp(data: Genotypes, path: str, keep_groups: Groups = None) -> None:
    write_lines(smartsnp(data, keep_groups), path, ["row_id"])
    lay = layout(data, keep_groups)
    with open(path.rsplit(".", 1)[0] + "_samples.smartsnp", "w") as out:
        out.write("sample\tgroup\n" + "".join(f"{n}\t{g}\n" for n, g in zip(lay.names, lay.groups, strict=True)))


def chrom_codes(variants: DataFrame, mode: str = "auto", otherwise: str = "zero", most: int = MAX_PLINK_CHROM) -> DataFrame:
    """chrom, code, first. auto: the number after a `chr` prefix if every chrom has one up to most, else as otherwise says;
    index: order of first appearance; zero: 0; keep: as it is. One row per chrom."""
    chroms = variants.groupBy("chrom").agg(F.min("row_id").alias("first"))
    stripped = F.regexp_replace(F.coalesce("chrom", F.lit("0")), "^(?:chr|Chr|CHR)[_.-]?", "")
    if mode == "auto":
        bad = ~stripped.rlike(r"^[0-9]+\z") | (stripped.try_cast("decimal(38,0)") > most)
        mode = otherwise if not chroms.where(F.coalesce(bad, F.lit(True))).isEmpty() else "number"
    if mode == "index":
        return numbered(chroms, "first").select("chrom", F.col("n").cast("string").alias("code"), "first")
    code = {"number": stripped.try_cast("bigint").cast("string"), "zero": F.lit("0"), "keep": F.coalesce("chrom", F.lit("0"))}[mode]
    return chroms.select("chrom", code.alias("code"), "first")


def plink_variants(data: Genotypes, keep_groups: Groups = None, chrom_code: str = "auto") -> DataFrame:
    """row_id, code, id (unique), cm, pos, alt, ref."""
    v = layout(data, keep_groups).variants
    codes = chrom_codes(v, chrom_code).select(F.col("chrom").alias("_c"), "code")
    again = F.row_number().over(Window.partitionBy("locus").orderBy("row_id")) - 1
    unique = F.when(again == 0, F.col("locus")).otherwise(F.concat_ws("_", "locus", again.cast("string")))
    cm = F.format_string("%.8f", F.col("pos") / 1e6)
    return v.join(codes, F.col("chrom").eqNullSafe(F.col("_c"))).select("row_id", "code", unique.alias("id"), F.when(F.col("pos").isNull(), "NA").otherwise(cm).alias("cm"), F.coalesce(whole("pos"), F.lit("NA")).alias("pos"), "alt", "ref")


def plink_bim(data: Genotypes, keep_groups: Groups = None, chrom_code: str = "auto") -> DataFrame:
    return plink_variants(data, keep_groups, chrom_code).select("row_id", F.concat_ws("\t", "code", "id", "cm", "pos", "alt", "ref").alias("line"))


def _full_vector(values: str | list[str] | None, default: str, n: int, what: str) -> list[str]:
    out = [default] * n if values is None else [str(values)] * n if isinstance(values, (str, int)) else [str(x) for x in values]
    if len(out) != n:
        raise ValueError(f"{what} must be one value or {n}")
    return out


def plink_fam(lay: Layout, sex: str | list[str] | None = None, pheno: str | list[str] | None = None) -> list[list[str]]:
    """FID, IID, PAT, MAT, SEX, PHENO of each sample."""
    require_tokens([*lay.names, *lay.group_names], "names of samples and groups")
    n = len(lay.names)
    return [[g, s, "0", "0", x, p] for g, s, x, p in zip(lay.groups, lay.names, _full_vector(sex, "0", n, "sex"), _full_vector(pheno, "-9", n, "pheno"), strict=True)]


def fam_lines(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """o, line of the .fam file."""
    fam = plink_fam(layout(data, keep_groups))
    return data.spark.createDataFrame([(o, "\t".join(f)) for o, f in enumerate(fam)], "o INT, line STRING")


def map_lines(data: Genotypes, keep_groups: Groups = None, chrom_code: str = "auto") -> DataFrame:
    """row_id, line of the .map file."""
    return plink_variants(data, keep_groups, chrom_code).select("row_id", F.concat_ws("\t", "code", "id", "cm", "pos").alias("line"))


def chrom_map_lines(data: Genotypes, keep_groups: Groups = None, chrom_code: str = "auto", otherwise: str = "zero") -> DataFrame:
    """first, line: each chrom and its code, by first appearance, if any chrom is recoded; else no row."""
    codes = chrom_codes(layout(data, keep_groups).variants, chrom_code, otherwise)
    return codes.select("first", F.concat_ws("\t", "chrom", "code").alias("line"), (~F.col("chrom").eqNullSafe(F.col("code"))).alias("_new")).withColumn("_any", F.bool_or("_new").over(Window.partitionBy())).where("_any").select("first", "line")  # one row per chrom


def ind_lines(data: Genotypes, keep_groups: Groups = None, sex: str | list[str] | None = None) -> DataFrame:
    """o, line of the .ind file."""
    lay = layout(data, keep_groups)
    return data.spark.createDataFrame([(o, f"{n}\t{s}\t{g}") for o, (n, s, g) in enumerate(zip(lay.names, _full_vector(sex, "U", len(lay.names), "sex"), lay.groups, strict=True))], "o INT, line STRING")


def _write_map(data: Genotypes, keep_groups: Groups, path: str, chrom_code: str, otherwise: str = "zero") -> None:
    codes = chrom_codes(layout(data, keep_groups).variants, chrom_code, otherwise)
    if not codes.where(~F.col("chrom").eqNullSafe(F.col("code"))).isEmpty():
        write_lines(codes.select("first", F.concat_ws("\t", "chrom", "code").alias("line")), path + ".chrommap", ["first"])


def write_ped(data: Genotypes, path: str, keep_groups: Groups = None, sex: str | list[str] | None = None, pheno: str | list[str] | None = None, chrom_code: str = "auto", allele_code: str = "nucleotide") -> None:
    fam = plink_fam(layout(data, keep_groups), sex, pheno)
    write_blocks(ped(data, keep_groups, allele_code), path + ".ped", [" ".join(f) + " " for f in fam], " ")
    write_lines(plink_variants(data, keep_groups, chrom_code).select("row_id", F.concat_ws("\t", "code", "id", "cm", "pos").alias("line")), path + ".map", ["row_id"])
    _write_map(data, keep_groups, path, chrom_code)


def plink_bed(data: Genotypes, keep_groups: Groups = None) -> DataFrame:
    """row_id, packed: two bits per sample, four samples to a byte, lowest bits first; 00 ALT/ALT, 01 missing, 10 het, 11 REF/REF."""
    code = F.when((F.col("a1") == 0) & (F.col("a2") == 0), "3").when((F.col("a1") == 1) & (F.col("a2") == 1), "0").otherwise("2")
    texts = layout(data, keep_groups).by_variant(code, "1").select("row_id", F.array_join("codes", "").alias("t"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b[1].to_pylist():
                codes = np.frombuffer(t.encode(), np.uint8) - 48
                codes = np.pad(codes, (0, -len(codes) % 4)).reshape(-1, 4)
                out.append((codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b[0], pa.array(out, pa.binary())], names=["row_id", "packed"])

    return texts.mapInArrow(pack, "row_id BIGINT, packed BINARY")


def write_bed(data: Genotypes, path: str, keep_groups: Groups = None, sex: str | list[str] | None = None, pheno: str | list[str] | None = None, chrom_code: str = "auto") -> None:
    fam = plink_fam(layout(data, keep_groups), sex, pheno)
    with open(path + ".bed", "wb") as out:
        out.write(b"\x6c\x1b\x01")
        for r in plink_bed(data, keep_groups).orderBy("row_id").select("packed").toLocalIterator():
            out.write(bytes(r[0]))
    write_lines(plink_bim(data, keep_groups, chrom_code), path + ".bim", ["row_id"])
    with open(path + ".fam", "w") as out:
        out.writelines("\t".join(f) + "\n" for f in fam)
    _write_map(data, keep_groups, path, chrom_code)


def pop_lines(data: Genotypes, keep_groups: Groups = None, reference_groups: list[str] | None = None) -> DataFrame:
    """o, line of the .pop file: the group of a reference sample, `-` for the others; all are reference if none is named."""
    groups = layout(data, keep_groups).groups
    return data.spark.createDataFrame([(o, g if not reference_groups or g in reference_groups else "-") for o, g in enumerate(groups)], "o INT, line STRING")


def write_admixture(data: Genotypes, path: str, keep_groups: Groups = None, sex: str | list[str] | None = None, pheno: str | list[str] | None = None, chrom_code: str = "zero", supervised: bool = False, reference_groups: list[str] | None = None) -> None:
    """A bed set, and with supervised a .pop file: the group of reference samples, `-` for the others."""
    if reference_groups and not supervised:
        raise ValueError("reference_groups needs supervised")
    write_bed(data, path, keep_groups, sex, pheno, chrom_code)
    if supervised:
        write_lines(pop_lines(data, keep_groups, reference_groups), path + ".pop", ["o"])


def eigenstrat_snp(data: Genotypes, keep_groups: Groups = None, chrom_code: str = "auto") -> DataFrame:
    v = layout(data, keep_groups).variants
    codes = chrom_codes(v, chrom_code, "index", 2**62).select(F.col("chrom").alias("_c"), "code")
    cm = F.coalesce(F.when(F.col("pos").isNotNull(), F.format_string("%.8f", F.col("pos") / 1e6)), F.lit("NA"))
    return v.join(codes, F.col("chrom").eqNullSafe(F.col("_c"))).select("row_id", F.concat_ws("\t", "locus", "code", cm, F.coalesce(whole("pos"), F.lit("NA")), "ref", "alt").alias("line"))


def write_eigenstrat(data: Genotypes, path: str, keep_groups: Groups = None, sex: str | list[str] | None = None, chrom_code: str = "auto") -> None:
    lay = layout(data, keep_groups)
    write_lines(eigenstrat(data, keep_groups), path + ".geno", ["row_id"])
    write_lines(eigenstrat_snp(data, keep_groups, chrom_code), path + ".snp", ["row_id"])
    with open(path + ".ind", "w") as out:
        out.writelines(f"{n}\t{s}\t{g}\n" for n, s, g in zip(lay.names, _full_vector(sex, "U", len(lay.names), "sex"), lay.groups, strict=True))
    if chrom_code != "keep":
        _write_map(data, keep_groups, path, chrom_code, "index")


def fineradstructure(data: Genotypes, keep_groups: Groups = None, block_size: int = 10_000) -> DataFrame:
    """chrom, block, line: per sample both haplotypes of the block's SNVs, one if equal, empty if any is missing."""
    lay = layout(data, keep_groups)
    blocks = snv_blocks(lay.variants.select("row_id", "chrom", "pos"), block_size).select("row_id", "chrom", "block", "pos")
    wide = lay.by_variant(F.concat(base_of("a1"), base_of("a2")), "").select("row_id", F.posexplode("codes").alias("o", "c")).join(blocks, "row_id")
    held = wide.groupBy("chrom", "block", "o").agg(F.array_sort(F.collect_list(F.struct("pos", "row_id", "c"))).alias("_c"))
    hap = lambda i: F.array_join(F.transform("_c", lambda x: F.substring(x["c"], i, 1)), "")
    cell = F.when(F.exists("_c", lambda x: x["c"] == ""), "").when(hap(1) == hap(2), hap(1)).otherwise(F.concat_ws("/", hap(1), hap(2)))
    cells = held.select("chrom", "block", "o", cell.alias("cell"))
    return cells.groupBy("chrom", "block").agg(F.array_sort(F.collect_list(F.struct("o", "cell"))).alias("_l")).select("chrom", "block", F.array_join(F.transform("_l", lambda x: x["cell"]), "\t").alias("line"))


def write_fineradstructure(data: Genotypes, path: str, keep_groups: Groups = None, block_size: int = 10_000) -> None:
    write_lines(fineradstructure(data, keep_groups, block_size), path, ["chrom", "block"], ["\t".join(layout(data, keep_groups).names)])
