"""Groups, names and selections of samples, and random subsets of variants."""

from __future__ import annotations

import random
import re
import warnings
from collections.abc import Iterable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varilake.model import MAX_SAMPLES, Genotypes
from varilake.operators.filters import restrict_samples


def read_sample_table(path: str) -> list[dict[str, str | None]]:
    """A small text table with a header: tab-separated if the header has a tab, else by white space.

    Values are trimmed, enclosing double quotes removed; empty and NA are None. Files are read by the driver.
    """
    lines = [x for x in Path(path).read_text().splitlines() if x.strip()]
    if not lines:
        return []
    cut = lambda s: s.split("\t") if "\t" in lines[0] else s.split()
    clean = lambda v: None if (v := v.strip().strip('"').strip()) in ("", "NA") else v
    names = [clean(x) or f"V{i + 1}" for i, x in enumerate(cut(lines[0]))]
    return [dict(zip(names, [*map(clean, cut(line)), *[None] * len(names)], strict=False)) for line in lines[1:]]


def _clean(value: object) -> str | None:
    text = None if value is None else str(value).strip()
    return None if text in ("", "NA") else text


def sample_rows(table: list[dict[str, str | None]] | DataFrame, columns: list[str]) -> list[dict[str, str | None]]:
    """Columns of a small table as trimmed text, empty and NA being None; at most MAX_SAMPLES rows, else an error."""
    rows = [r.asDict() for r in table.select(*columns).limit(MAX_SAMPLES + 1).collect()] if isinstance(table, DataFrame) else table
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"a sample table of more than {MAX_SAMPLES} rows")
    return [{c: _clean(r.get(c)) for c in columns} for r in rows]


def _warn_unknown(names: Iterable[str], known: Iterable[str], what: str) -> None:
    if missing := sorted(set(names) - set(known)):
        warnings.warn(f"{len(missing)} {what}: {missing[:5]}", stacklevel=3)


def set_groups(data: Genotypes, strata: list[dict[str, str | None]] | DataFrame, sample: str = "id", group: str = "pop") -> Genotypes:
    """Gives each sample the group of its name; a name not listed has none, with a warning. A name with two groups is an error."""
    of: dict[str, str | None] = {}
    for r in sample_rows(strata, [sample, group]):
        if r[sample] in of and of[r[sample]] != r[group]:
            raise ValueError(f"sample {r[sample]!r} has more than one group")
        if r[sample] is not None:
            of[r[sample]] = r[group]
    _warn_unknown([r[0] for r in data.samples.select("sample").collect()], [k for k, v in of.items() if v is not None], "samples have no group")
    table = data.spark.createDataFrame([(k, v) for k, v in of.items()], "sample STRING, grp STRING")
    return replace(data, samples=data.samples.drop("grp").join(F.broadcast(table), "sample", "left").select("sample_idx", "sample", "grp"))


def rename_samples(data: Genotypes, names: dict[str, str] | list[dict[str, str | None]] | DataFrame, update_groups: bool = False) -> Genotypes:
    """New names for samples: a mapping, or a table with id, new_id and, for update_groups, pop; swaps are allowed.

    The result must be unique, and no name empty, or with a tab or line break. Names that are not samples are ignored
    with a warning; two new names for one sample are an error. With update_groups the samples listed get the group in
    pop, if it has one. Genotypes carry sample_idx, so only their name column is looked up again, by a broadcast.
    """
    if isinstance(names, dict):
        if update_groups:
            raise ValueError("update_groups needs a table with pop")
        names = [{"id": k, "new_id": v} for k, v in names.items()]
        rows = [{"id": r["id"], "new_id": r["new_id"], "pop": None} for r in names]
    else:
        rows = sample_rows(names, ["id", "new_id", *(["pop"] if update_groups else [])])
    of: dict[str, dict[str, str | None]] = {}
    for r in rows:
        if r["id"] in of and of[r["id"]]["new_id"] != r["new_id"]:
            raise ValueError(f"sample {r['id']!r} has more than one new name")
        of[r["id"]] = r
    now = [r[0] for r in data.samples.select("sample").collect()]
    _warn_unknown(of, now, "names are no samples")
    new = [of[x]["new_id"] if x in of else x for x in now]
    if len(set(new)) != len(new) or any(not x or re.search(r"[\t\r\n]", x) for x in new):
        raise ValueError("new sample names must be unique, not empty and without tabs and line breaks")
    table = data.spark.createDataFrame([(x, of[x]["new_id"], of[x].get("pop")) for x in now if x in of], "sample STRING, _new STRING, _pop STRING")
    group = F.coalesce("_pop", "grp") if update_groups else F.col("grp")
    samples = data.samples.join(F.broadcast(table), "sample", "left").select("sample_idx", F.coalesce("_new", "sample").alias("sample"), group.alias("grp"))
    gt = data.gt.drop("sample").join(F.broadcast(samples.select("sample_idx", "sample")), "sample_idx").select(*data.gt.columns)
    return replace(data, samples=samples, gt=gt)


def extract_samples(data: Genotypes, samples: list[str], keep: bool = True, f_invar: bool = True, strict_poly: bool = False) -> Genotypes:
    """Keeps, or leaves out, the named samples; names not in the data are ignored; an empty list keeps all."""
    names = [s for s in samples if s]
    if not names:
        return data
    chosen = F.col("sample").isin(names)
    return restrict_samples(data, data.samples.where(chosen if keep else ~chosen), f_invar, strict_poly)


def extract_groups(data: Genotypes, groups: list[str], keep: bool = True, f_invar: bool = True, strict_poly: bool = False) -> Genotypes:
    """Keeps, or leaves out, the samples of the named groups. A sample without group, or an unknown group, is an error."""
    known = {r[0] for r in data.samples.select("grp").distinct().collect()}
    if None in known or set(groups) - known:
        raise ValueError("every sample needs a group, and every group named must exist")
    chosen = F.col("grp").isin(list(groups))
    return restrict_samples(data, data.samples.where(chosen if keep else ~chosen), f_invar, strict_poly)


def draw_key(seed: int | None, *columns: str) -> Column:
    """32 hexadecimal digits that are as good as random: MD5 of the columns and the seed. No seed: a new one each time."""
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in columns), F.lit(str(random.getrandbits(62) if seed is None else seed))))


def sub_snvs(data: Genotypes, n_snvs: int = 10_000, seed: int | None = None) -> Genotypes:
    """Exactly n_snvs variants at random (all if there are no more); a seed makes the draw repeatable.

    The draw orders by a hash of the row_id and the seed, so it does not depend on partitions; Spark keeps the first
    n_snvs in every task and merges those.
    """
    chosen = data.variants.select("row_id").orderBy(draw_key(seed, "row_id"), "row_id").limit(n_snvs)
    return data.with_variants(data.variants.join(chosen, "row_id", "left_semi"))


def sub_snvs_stratified(data: Genotypes, n_snvs: int = 1000, seed: int | None = None) -> Genotypes:
    """Exactly n_snvs variants at random, spread over the chroms in proportion to their numbers of variants.

    The quotas are computed in Spark over one row per chrom. Within a chrom the rank comes from a hash; only the first
    quota rows of each chrom are needed, which Spark keeps per task before the shuffle.
    """
    sizes = data.variants.groupBy("chrom").agg(F.count(F.lit(1)).alias("m"))
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    if n_snvs >= total:
        return data
    base = sizes.select(F.col("chrom").alias("_c"), "m", F.floor(F.lit(n_snvs) * F.col("m") / total).cast("bigint").alias("q"), ((F.lit(n_snvs) * F.col("m")) % total).alias("r"))
    short = n_snvs - base.agg(F.sum("q")).first()[0]
    extra = base.orderBy(F.desc("r"), F.desc("m"), "_c").limit(short).select(F.col("_c").alias("_e"))
    quota = base.join(extra, F.col("_c").eqNullSafe(F.col("_e")), "left").select("_c", (F.col("q") + F.when(F.col("_e").isNotNull(), 1).otherwise(0)).alias("q"))
    key = draw_key(seed, "row_id")
    ranked = data.variants.select("row_id", "chrom").withColumn("_i", F.row_number().over(Window.partitionBy("chrom").orderBy(key, "row_id"))).where(F.col("_i") <= n_snvs)
    chosen = ranked.join(quota, F.col("chrom").eqNullSafe(F.col("_c"))).where("_i <= q").select("row_id")
    return data.with_variants(data.variants.join(chosen, "row_id", "left_semi"))
