"""What all exports share: which variants and samples, in which order, and cells as arrays per variant.

Exports take biallelic SNVs in row_id order and the samples of the kept groups, group by group. Files with a line per
variant come from one aggregate per variant. Files with a line per sample are cut into blocks of variants: each row
holds one sample's text for one block, so no task holds a whole line, and the writer streams the blocks in order.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilake.model import Genotypes

BLOCK = 50_000
"""row_ids in a block of a sample-major file."""
PROGRAM = "varilake"
_BETWEEN = "\x02"


def dense(pairs: Column, n: int, name: str, kind: str, missing: Column) -> Column:
    """(o, name) pairs with one for every o from 0 to n - 1, in order: absent ones are added and all are sorted, so a row
    costs n log n whatever n is. Of an o that occurs twice, both stay. Null pairs are none."""
    pairs = F.coalesce(pairs, F.array().cast(f"array<struct<o:int,{name}:{kind}>>"))
    absent = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.transform(pairs, lambda x: x["o"])) if n else F.array().cast("array<int>")
    return F.array_sort(F.concat(pairs, F.transform(absent, lambda o: F.struct(o.alias("o"), missing.alias(name)))))


def places(data: Genotypes) -> tuple[DataFrame, int]:
    """(sample_idx, o): the place of each sample in order, from 0, as a broadcast of the bounded list of samples; how many."""
    order = [r[0] for r in data.samples.orderBy("sample_idx").select("sample_idx").collect()]
    return F.broadcast(data.spark.createDataFrame([(i, o) for o, i in enumerate(order)], "sample_idx INT, o INT")), len(order)


@dataclass(frozen=True)
class Layout:
    """variants: row_id, chrom, pos, ref, alt, id, locus. names, groups: of the samples, in output order."""

    data: Genotypes
    variants: DataFrame
    indices: list[int]
    names: list[str]
    groups: list[str]

    @property
    def group_names(self) -> list[str]:
        return list(dict.fromkeys(self.groups))

    def order(self) -> DataFrame:
        """sample_idx, o: place in the output from 0, as a broadcast of the bounded list of samples."""
        rows = [(i, o, g) for o, (i, g) in enumerate(zip(self.indices, self.groups, strict=True))]
        return F.broadcast(self.data.spark.createDataFrame(rows, "sample_idx INT, o INT, grp STRING"))

    def cells(self, *columns: str) -> DataFrame:
        """row_id, o, grp, a1, a2 of the exported variants' called genotypes, with these columns of the variant."""
        called = self.data.gt.where("a1 IS NOT NULL AND a2 IS NOT NULL").select("row_id", "sample_idx", "a1", "a2")
        return called.join(self.order(), "sample_idx").join(self.variants.select("row_id", *columns), "row_id").drop("sample_idx")

    def by_variant(self, code: Column, missing: str) -> DataFrame:
        """variants with codes: one per sample in order, missing where there is no call. code: of a1, a2, ref, alt."""
        held = self.cells("ref", "alt").groupBy("row_id").agg(F.collect_list(F.struct("o", code.alias("c"))).alias("_p"))
        joined = self.variants.join(held, "row_id", "left")
        every = dense(F.col("_p"), len(self.names), "c", "string", F.lit(missing))
        return joined.withColumn("codes", F.transform(every, lambda x: x["c"])).drop("_p")

    def by_sample(self, code: Column, missing: str, sep: str) -> DataFrame:
        """o, block, text: each sample's codes of one block of variants, in row_id order."""
        held = self._blocks(code, missing)
        return held.select("o", "block", F.array_join(F.transform("_c", lambda x: x["c"]), sep).alias("text"))

    def by_allele(self, code: Callable[[str], Column], missing: str, sep: str) -> DataFrame:
        """o, block, text: two lines per sample, o counting lines; the first of the codes of a1, the second of a2."""
        held = self._blocks(F.concat(code("a1"), F.lit(_BETWEEN), code("a2")), f"{missing}{_BETWEEN}{missing}")
        line = lambda i: F.struct((2 * F.col("o") + i).cast("int").alias("o"), F.array_join(F.transform("_c", lambda x: F.split_part(x["c"], F.lit(_BETWEEN), F.lit(i + 1))), sep).alias("text"))
        return held.select("block", F.explode(F.array(line(0), line(1))).alias("_l")).select("_l.o", "block", "_l.text")

    def _blocks(self, code: Column, missing: str) -> DataFrame:
        """o, block and the sorted cells of one sample's block of variants."""
        wide = self.by_variant(code, missing).select("row_id", F.posexplode("codes").alias("o", "c"))
        block = F.floor((F.col("row_id") - 1) / BLOCK).alias("block")
        return wide.groupBy("o", block).agg(F.array_sort(F.collect_list(F.struct("row_id", "c"))).alias("_c"))


def layout(data: Genotypes, keep_groups: list[str] | None = None) -> Layout:
    """Which variants and samples are exported. A sample without group, or an unknown group, is an error."""
    rows = data.samples.orderBy("sample_idx").collect()
    present = list(dict.fromkeys(r["grp"] for r in rows))
    if None in present:
        raise ValueError("every sample needs a group")
    keep = present if keep_groups is None else keep_groups
    if unknown := [g for g in keep if g not in present]:
        raise ValueError(f"unknown groups: {unknown}")
    chosen = [r for g in keep for r in rows if r["grp"] == g]
    place = F.concat_ws("_", "chrom", F.col("pos").cast("decimal(20,0)").cast("string"))
    nameless = F.col("id").isNull() | F.col("id").isin("", ".")
    v = data.variants.where("is_biallelic AND NOT is_indel").select("row_id", "chrom", F.col("pos").cast("bigint").alias("pos"), "ref", "alt", "id", F.when(nameless, place).otherwise(F.col("id")).alias("locus"))
    return Layout(data, v, [r["sample_idx"] for r in chosen], [r["sample"] for r in chosen], [r["grp"] for r in chosen])


def whole(c: str) -> Column:
    return F.col(c).cast("bigint").cast("string")


def first_base(c: str) -> Column:
    return F.substring(c, 1, 1)


def base_of(allele: str) -> Column:
    return F.when(F.col(allele) == 0, first_base("ref")).otherwise(first_base("alt"))


def alt_copies() -> Column:
    """0, 1 or 2; a code above 1 counts like a heterozygote."""
    return F.when((F.col("a1") == 0) & (F.col("a2") == 0), "0").when((F.col("a1") == 1) & (F.col("a2") == 1), "2").otherwise("1")


def require_tokens(values: list[str], what: str) -> None:
    if bad := [v for v in values if re.search(r"\s", v)]:
        raise ValueError(f"{what} must not hold white space: {bad[:5]}")


def write_lines(lines: DataFrame, path: str, order: list[str], head: list[str] | tuple = (), tail: list[str] | tuple = ()) -> None:
    """One ordered file: lines sorted across partitions, streamed by the driver one partition at a time."""
    with gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w") as out:
        out.writelines(x + "\n" for x in head)
        for row in lines.orderBy(*order).select("line").toLocalIterator(prefetchPartitions=True):
            out.write(row[0] + "\n")
        out.writelines(x + "\n" for x in tail)


def write_parts(lines: DataFrame, folder: str, order: list[str], head: list[str] | tuple = (), compress: bool = False) -> None:
    """A folder of text files written by the tasks, in the shared file system: in the order of their names they make up the
    file that write_lines writes. The header is a file of its own, the first. gzip files may be joined too."""
    spark = lines.sparkSession
    codec = "gzip" if compress else "none"
    top = spark.createDataFrame([(h,) for h in head], "line STRING").coalesce(1)
    top.write.text(f"{folder}/0-head", compression=codec)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(f"{folder}/1-lines", compression=codec)


def write_blocks(blocks: DataFrame, path: str, prefix: list[str], sep: str, head: list[str] | tuple = (), tail: list[str] | tuple = ()) -> None:
    """A sample-major file: every sample's prefix and blocks in order, streamed; an o without blocks gets its prefix."""
    with open(path, "w") as out:
        out.writelines(x + "\n" for x in head)
        at, fresh = 0, True
        if prefix:
            out.write(prefix[0])
        for row in blocks.orderBy("o", "block").select("o", "text").toLocalIterator(prefetchPartitions=True):
            while at < row[0]:
                at, fresh = at + 1, True
                out.write("\n" + prefix[at])
            out.write(("" if fresh else sep) + row[1])
            fresh = False
        for p in prefix[at + 1 :]:
            out.write("\n" + p)
        if prefix:
            out.write("\n")
        out.writelines(x + "\n" for x in tail)
