"""Queries of the genotype operators over the tables variants, gt and samples, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilake.model import Genotypes, load
from varilake.operators import bind as b
from varilake.operators import filters as f
from varilake.operators import metrics, samples, stats
from varilake.plans import exports as x
from varilake.plans import sizing
from varilake.sources import vcf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_V = "row_id, chrom, pos, id, ref, alt, qual, filter, rk, rpt, n_alt, is_biallelic, is_indel, info, format"
_BASE = f"""WITH v AS (SELECT {_V}, CASE WHEN regexp_full_match(qual, '[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN TRY_CAST(qual AS DOUBLE) END AS qual_num
    FROM (SELECT DISTINCT {_V} FROM variants)),
  s AS (SELECT sample_idx, sample, grp FROM samples),
  g AS (SELECT DISTINCT row_id, sample, sample_idx, CASE WHEN a1 >= 0 AND a2 >= 0 THEN a1 END AS a1, CASE WHEN a1 >= 0 AND a2 >= 0 THEN a2 END AS a2, phased, fmt,
    CASE WHEN dp >= 0 AND NOT isnan(dp) THEN dp END AS dp, CASE WHEN gq >= 0 AND NOT isnan(gq) THEN gq END AS gq, CASE WHEN adr >= 0 AND NOT isnan(adr) THEN adr END AS adr FROM gt)"""


def _metrics(gt: str, by: str = "row_id") -> str:
    return f"""SELECT {by}, COUNT(*) AS n_rows, COUNT(a1) AS called, CAST(COALESCE(SUM(a1 + a2), 0) AS BIGINT) AS sum_g, CAST(COALESCE(SUM((a1 + a2) * (a1 + a2)), 0) AS BIGINT) AS sum_g2,
      CAST(COALESCE(SUM(a1 * a1 + a2 * a2), 0) AS BIGINT) AS sum_a2, COUNT(CASE WHEN a1 <> a2 THEN 1 END) AS het FROM {gt} GROUP BY {by}"""


_M = f"{_BASE}, m AS ({_metrics('g')})"
_POLY = "called > 0 AND 2 * called * sum_a2 <> sum_g * sum_g"
_POLY_STRICT = "called > 0 AND called * sum_g2 <> sum_g * sum_g"


def _query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _ids(name: str, op: Callable[[Genotypes], Genotypes], where: str, frm: str = "v", base: str = _BASE) -> None:
    """A filter: which variants it keeps."""
    QUERIES[name] = lambda spark, d: op(load(spark, d)).variants.select("row_id")
    SQL[name] = f"{base} SELECT v.row_id FROM {frm} WHERE {where}"


# scans and metrics

_query("scan_variants", f"{_BASE} SELECT {_V}, qual_num FROM v")(lambda spark, d: load(spark, d).variants)
_query("scan_genotypes", f"{_BASE} SELECT * FROM g")(lambda spark, d: load(spark, d).gt)
_query("variant_metrics", f"{_M} SELECT * FROM m")(lambda spark, d: metrics.per_variant(load(spark, d).gt))
_SAMPLE = f"""{_BASE}, c AS (SELECT sample_idx, COUNT(*) AS total_loci, COUNT(a1) AS non_missing, COUNT(CASE WHEN a1 <> a2 THEN 1 END) AS heterozygotes, COUNT(CASE WHEN a1 = 0 AND a2 = 0 THEN 1 END) AS homozygotes_ref,
    COUNT(CASE WHEN a1 = 1 AND a2 = 1 THEN 1 END) AS homozygotes_alt, COUNT(CASE WHEN a1 IS NOT NULL THEN dp END) AS dp_n, SUM(CASE WHEN a1 IS NOT NULL THEN dp END) AS dp_sum FROM g GROUP BY sample_idx),
  sm AS (SELECT s.sample_idx, s.sample, s.grp, COALESCE(total_loci, 0) AS total_loci, COALESCE(non_missing, 0) AS non_missing, COALESCE(heterozygotes, 0) AS heterozygotes, COALESCE(homozygotes_ref, 0) AS homozygotes_ref,
    COALESCE(homozygotes_alt, 0) AS homozygotes_alt, COALESCE(dp_n, 0) AS dp_n, dp_sum FROM s LEFT JOIN c ON s.sample_idx = c.sample_idx)"""
_query("sample_metrics", f"{_SAMPLE} SELECT * FROM sm")(lambda spark, d: metrics.per_sample(load(spark, d)))


@_query("summary", f"""{_BASE}, a AS (SELECT COUNT(*) AS variants, COUNT(CASE WHEN is_biallelic AND NOT is_indel THEN 1 END) AS biallelic_snvs, COUNT(CASE WHEN NOT is_biallelic AND NOT is_indel THEN 1 END) AS multiallelic_snvs,
      COUNT(CASE WHEN is_indel THEN 1 END) AS indels FROM v), p AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN a1 IS NULL THEN 1 END) AS miss, COUNT(CASE WHEN phased THEN 1 END) AS phased FROM g), k AS (SELECT COUNT(*) AS samples FROM s),
      z AS (SELECT string_agg(g || '=' || n, ';' ORDER BY g) AS groups FROM (SELECT COALESCE(grp, 'NA') AS g, COUNT(*) AS n FROM s GROUP BY 1))
    SELECT a.*, k.samples, z.groups, round(100.0 * p.miss / p.n, 6) AS missing_percent, p.phased FROM a JOIN p ON TRUE JOIN k ON TRUE JOIN z ON TRUE""")  # fmt: skip
def summary(spark: SparkSession, d: str) -> DataFrame:
    out = load(spark, d).summary()
    row = out | {"groups": ";".join(sorted(f"{'NA' if g is None else g}={n}" for g, n in out["groups"].items()))}
    return spark.createDataFrame([row]).withColumn("missing_percent", F.round("missing_percent", 6)).select("variants", "biallelic_snvs", "multiallelic_snvs", "indels", "samples", "groups", "missing_percent", "phased")


# filters

_SUB = "sub AS (SELECT * FROM g WHERE sample_idx IN (SELECT sample_idx FROM s WHERE {where}))"


def _few_plates(spark: SparkSession, d: str) -> Genotypes:
    data = f.filter_quality(load(spark, d))
    plates = spark.read.parquet(f"{d}/samples.parquet").where("plate < 5").select("sample_idx")
    return data.with_samples(data.samples.join(plates, "sample_idx", "left_semi"))


_ids("filter_quality", f.filter_quality, "COALESCE(qual_num, 30) >= 30")
_ids("filter_pass", f.filter_pass, "filter IN ('PASS', '.')")
_ids("filter_biallelic", f.filter_biallelic, "is_biallelic")
_ids("filter_indels", f.filter_indels, "NOT is_indel")
_ids("filter_rank", f.filter_rank, "rk >= 0.4")
_ids("filter_rpt", lambda g: f.filter_rpt(g, keep_na=True), "rpt <= 0.5 OR rpt IS NULL")
_ids("filter_rpt_default", f.filter_rpt, "rpt <= 0.5")
_ids("filter_paralogs", f.filter_paralogs, "rk >= 0.2 AND rpt <= 0.5")
_JOINED = "v JOIN m ON v.row_id = m.row_id"
_ids("filter_maf", f.filter_maf, "called > 0 AND least(sum_g / (2.0 * called), 1 - sum_g / (2.0 * called)) >= 0.05", _JOINED, _M)
_ids("filter_hets", f.filter_hets, "called > 0 AND het / CAST(called AS DOUBLE) < 0.5", _JOINED, _M)
_ids("filter_missingness", lambda g: f.filter_missingness(g, 0.2), "(n_rows - called) / CAST(n_rows AS DOUBLE) <= 0.2", _JOINED, _M)
_ids("filter_invariant", f.filter_invariant, _POLY, _JOINED, _M)
_ids("filter_invariant_strict", lambda g: f.filter_invariant(g, True), _POLY_STRICT, _JOINED, _M)
_query("removed_invariant", f"{_M} SELECT v.row_id FROM v WHERE v.row_id NOT IN (SELECT row_id FROM m WHERE {_POLY})")(lambda spark, d: f.filter_invariant(load(spark, d)).removed.select("row_id"))
_ids("filter_coverage_keep", lambda g: f.filter_coverage(g, 10, strict=False), f"called >= 2 AND {_POLY}", _JOINED, f"{_BASE}, m AS ({_metrics('(SELECT * FROM g WHERE a1 IS NOT NULL AND dp >= 10) AS deep')})")

_KEPT = "kept AS (SELECT sample_idx FROM g GROUP BY sample_idx HAVING COUNT(CASE WHEN a1 IS NULL THEN 1 END) / CAST(COUNT(*) AS DOUBLE) < 0.3)"
_query("filter_missing", f"{_BASE}, {_KEPT} SELECT sample_idx, sample, grp FROM s WHERE sample_idx IN (SELECT sample_idx FROM kept)")(lambda spark, d: f.filter_missing(load(spark, d), 0.3, f_invar=False).samples)
_query("filter_missing_invariant", f"{_BASE}, {_KEPT}, m AS ({_metrics('(SELECT * FROM g WHERE sample_idx IN (SELECT sample_idx FROM kept)) AS l')}) SELECT v.row_id FROM {_JOINED} WHERE {_POLY}")(
    lambda spark, d: f.filter_missing(load(spark, d), 0.3).variants.select("row_id")
)

_CELL = ("row_id", "sample_idx", "a1", "a2", "fmt")
# GT at its place: the text before it, the value, the text after it
_REGT = """CASE WHEN k = 1 THEN CAST({new} AS VARCHAR) || regexp_extract(fmt, '^[^:]*(.*)$', 1) ELSE regexp_extract(fmt, '^([^:]*:)', 1) || {new} || regexp_extract(fmt, '^[^:]*:[^:]*(.*)$', 1) END"""
_PLACED = "p AS (SELECT g.*, CASE WHEN v.format LIKE 'GT%' THEN 1 ELSE 2 END AS k FROM g JOIN v ON g.row_id = v.row_id)"
_LOW = "a1 IS NOT NULL AND COALESCE(dp, -1) < 10"
_query("filter_coverage_mask", f"""{_BASE}, {_PLACED} SELECT row_id, sample_idx, CASE WHEN {_LOW} THEN NULL ELSE a1 END AS a1, CASE WHEN {_LOW} THEN NULL ELSE a2 END AS a2,
    CASE WHEN {_LOW} THEN {_REGT.format(new="(CASE WHEN phased THEN '.|.' ELSE './.' END)")} ELSE fmt END AS fmt FROM p""")(  # fmt: skip
    lambda spark, d: f.filter_coverage(load(spark, d)).gt.select(*_CELL)
)
_HET = "a1 IS NOT NULL AND a1 <> a2 AND (adr < 0.1 OR adr > 0.9)"
_SEP = "(CASE WHEN phased THEN '|' ELSE '/' END)"
_NEW = "(CASE WHEN adr < 0.1 THEN '0' ELSE '1' END)"
_query("filter_adr_correct", f"""{_BASE}, {_PLACED} SELECT row_id, sample_idx, CASE WHEN {_HET} THEN CAST({_NEW} AS INT) ELSE a1 END AS a1, CASE WHEN {_HET} THEN CAST({_NEW} AS INT) ELSE a2 END AS a2,
    CASE WHEN {_HET} THEN {_REGT.format(new=f"({_NEW} || {_SEP} || {_NEW})")} ELSE fmt END AS fmt FROM p""")(  # fmt: skip
    lambda spark, d: f.filter_adr(load(spark, d), f_invar=False).gt.select(*_CELL)
)
_query("filter_adr_remove", f"""{_BASE}, {_PLACED} SELECT row_id, sample_idx, CASE WHEN {_HET} THEN NULL ELSE a1 END AS a1, CASE WHEN {_HET} THEN NULL ELSE a2 END AS a2,
    CASE WHEN {_HET} THEN {_REGT.format(new=f"('.' || {_SEP} || '.')")} ELSE fmt END AS fmt FROM p""")(  # fmt: skip
    lambda spark, d: f.filter_adr(load(spark, d), mode="remove", f_invar=False).gt.select(*_CELL)
)

_ADR = f"""ad AS (SELECT row_id, CASE WHEN {_HET} THEN {{new}} ELSE a1 END AS a1, CASE WHEN {_HET} THEN {{new}} ELSE a2 END AS a2 FROM g)"""
for _mode, _value in (("correct", f"CAST({_NEW} AS INT)"), ("remove", "NULL")):
    _query(f"filter_adr_{_mode}_invariant", f"{_BASE}, {_ADR.format(new=_value)}, m AS ({_metrics('ad')}) SELECT v.row_id FROM {_JOINED} WHERE {_POLY}")(lambda spark, d, mode=_mode: f.filter_adr(load(spark, d), mode=mode).variants.select("row_id"))
_query("copy_filtered", f"{_BASE}, {_SUB.format(where='plate < 5')} SELECT sub.row_id, sub.sample_idx, sub.fmt FROM sub JOIN v ON sub.row_id = v.row_id WHERE COALESCE(qual_num, 30) >= 30".replace("FROM s WHERE plate", "FROM samples WHERE plate"))(
    lambda spark, d: _few_plates(spark, d).copy().live("row_id", "sample_idx", "fmt")
)
_query("coverage_report", f"{_BASE} SELECT COUNT(CASE WHEN {_LOW} THEN 1 END) AS masked, COUNT(a1) AS called FROM g")(lambda spark, d: spark.createDataFrame([f.coverage_report(load(spark, d))]))
_query("adr_report", f"{_BASE} SELECT COUNT(CASE WHEN a1 <> a2 AND adr < 0.1 THEN 1 END) AS low, COUNT(CASE WHEN a1 <> a2 AND adr > 0.9 THEN 1 END) AS high, COUNT(CASE WHEN a1 <> a2 THEN 1 END) AS heterozygotes FROM g")(
    lambda spark, d: spark.createDataFrame([f.adr_report(load(spark, d))])
)
_query("select_positions", f"{_BASE}, r AS (SELECT row_id, ROW_NUMBER() OVER (ORDER BY row_id) - 1 AS i FROM v), k AS (SELECT sample_idx, ROW_NUMBER() OVER (ORDER BY sample_idx) - 1 AS j FROM s) SELECT g.row_id, g.sample_idx, g.fmt FROM g JOIN r ON g.row_id = r.row_id JOIN k ON g.sample_idx = k.sample_idx WHERE i BETWEEN 100 AND 299 AND j % 2 = 0")(
    lambda spark, d: (data := load(spark, d))[slice(100, 300), [i % 2 == 0 for i in range(data.samples.count())]].live("row_id", "sample_idx", "fmt")
)
_query("preview", f"{_BASE} SELECT row_id, chrom, pos FROM v ORDER BY row_id LIMIT 5")(lambda spark, d: load(spark, d).preview().select("row_id", "chrom", "pos"))

_BLOCKS = f"{_BASE}, bl AS (SELECT v.*, floor((pos - MIN(pos) OVER (PARTITION BY chrom)) / 10000) AS block FROM v WHERE pos IS NOT NULL)"
_query("filter_one_snv", f"{_BLOCKS} SELECT row_id FROM (SELECT row_id, ROW_NUMBER() OVER (PARTITION BY chrom, block ORDER BY pos, row_id) AS i FROM bl) WHERE i = 1")(lambda spark, d: f.filter_one_snv(load(spark, d)).variants.select("row_id"))
_query("filter_one_snv_quality", f"{_BLOCKS} SELECT row_id FROM (SELECT row_id, ROW_NUMBER() OVER (PARTITION BY chrom, block ORDER BY qual_num DESC NULLS LAST, pos, row_id) AS i FROM bl) WHERE i = 1")(
    lambda spark, d: f.filter_one_snv(load(spark, d), by_quality=True).variants.select("row_id")
)
_query("filter_multi_snv", f"""{_BLOCKS} SELECT row_id FROM (SELECT row_id, ROW_NUMBER() OVER (PARTITION BY chrom, block ORDER BY pos, row_id) AS i, COUNT(*) OVER (PARTITION BY chrom, block) AS n FROM bl)
    WHERE n >= 2 AND i <= 5""")(lambda spark, d: f.filter_multi_snv(load(spark, d)).variants.select("row_id"))  # fmt: skip

# samples


def _grouped(spark: SparkSession, d: str) -> Genotypes:
    """Without the samples that have no group."""
    data = load(spark, d)
    return data.with_samples(data.samples.where(F.col("grp").isNotNull()))


_query("extract_samples", f"{_BASE}, {_SUB.format(where=chr(34) + 'sample' + chr(34) + chr(32) + 'LIKE ' + chr(39) + 'Kx%' + chr(39))}, m AS ({_metrics('sub')}) SELECT v.row_id FROM {_JOINED} WHERE {_POLY}")(
    lambda spark, d: samples.extract_samples(data := load(spark, d), [r[0] for r in data.samples.where("sample LIKE 'Kx%'").select("sample").collect()]).variants.select("row_id")
)
_query("extract_groups", f"{_BASE}, {_SUB.format(where='grp IN (' + chr(39) + 'NORTH' + chr(39) + ', ' + chr(39) + 'ISLE' + chr(39) + ')')}, m AS ({_metrics('sub')}) SELECT v.row_id FROM {_JOINED} WHERE {_POLY}")(
    lambda spark, d: samples.extract_groups(_grouped(spark, d), ["NORTH", "ISLE"]).variants.select("row_id")
)
_query("set_groups", f"{_BASE} SELECT sample_idx, sample, CASE WHEN plate > 0 THEN 'plate' || CAST(plate AS VARCHAR) END AS grp FROM samples")(
    lambda spark, d: samples.set_groups(load(spark, d), spark.read.parquet(f"{d}/samples.parquet").where("plate > 0").select(F.col("sample").alias("id"), F.concat(F.lit("plate"), "plate").alias("pop"))).samples
)
_query("rename_samples", f"{_BASE} SELECT row_id, sample_idx, 'ind_' || sample AS sample, fmt FROM g")(
    lambda spark, d: samples.rename_samples(data := load(spark, d), {r[0]: f"ind_{r[0]}" for r in data.samples.select("sample").collect()}).gt.select("row_id", "sample_idx", "sample", "fmt")
)
_query("rename_with_groups", "SELECT sample_idx, CASE WHEN plate = 1 THEN 'new_' || sample ELSE sample END AS sample, CASE WHEN plate = 1 THEN 'moved' ELSE grp END AS grp FROM samples")(
    lambda spark, d: samples.rename_samples(load(spark, d), spark.read.parquet(f"{d}/samples.parquet").where("plate = 1").select(F.col("sample").alias("id"), F.concat(F.lit("new_"), "sample").alias("new_id"), F.lit("moved").alias("pop")), update_groups=True).samples
)
_DRAW = "md5(CAST(row_id AS VARCHAR) || ':1')"
_query("sub_snvs", f"{_BASE} SELECT row_id FROM v ORDER BY {_DRAW}, row_id LIMIT 500")(lambda spark, d: samples.sub_snvs(load(spark, d), 500, seed=1).variants.select("row_id"))
_query("sub_snvs_stratified", f"""{_BASE}, z AS (SELECT chrom, COUNT(*) AS m FROM v GROUP BY chrom), t AS (SELECT CAST(SUM(m) AS BIGINT) AS n FROM z), q AS (SELECT chrom, m, (1000 * m) // n AS q, (1000 * m) % n AS r FROM z JOIN t ON TRUE),
    e AS (SELECT *, ROW_NUMBER() OVER (ORDER BY r DESC, m DESC, chrom) AS i, 1000 - CAST(SUM(q) OVER () AS BIGINT) AS short FROM q), k AS (SELECT chrom, q + CASE WHEN i <= short THEN 1 ELSE 0 END AS q FROM e),
    o AS (SELECT row_id, chrom, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY {_DRAW}, row_id) AS i FROM v) SELECT o.row_id FROM o JOIN k ON o.chrom = k.chrom WHERE i <= q""")(  # fmt: skip
    lambda spark, d: samples.sub_snvs_stratified(load(spark, d), 1000, seed=1).variants.select("row_id")
)
_query("group_sizes", f"{_BASE} SELECT grp, COUNT(*) AS n FROM s GROUP BY grp")(lambda spark, d: load(spark, d).samples.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))

# merging: plates 0 to 4 with good quality, and the others without indels, numbered anew

_LOC = "chrom, pos, ref, alt"
_HALVES = f"""{_BASE}, u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_LOC} ORDER BY row_id) AS i FROM v), l AS (SELECT * FROM u WHERE i = 1),
  va AS (SELECT * FROM l WHERE COALESCE(qual_num, 30) >= 30), vb AS (SELECT * FROM l WHERE NOT is_indel),
  ga AS (SELECT * FROM g WHERE sample_idx IN (SELECT sample_idx FROM samples WHERE plate < 5)), gb AS (SELECT * FROM g WHERE sample_idx IN (SELECT sample_idx FROM samples WHERE plate >= 5))"""
_OFFSET = 10**9


def _halves(spark: SparkSession, d: str) -> tuple[Genotypes, Genotypes]:
    data = b.first_of_locus(load(spark, d))
    plates = spark.read.parquet(f"{d}/samples.parquet").select("sample_idx", "plate")
    listed = data.samples.join(plates, "sample_idx")
    first = f.filter_quality(data.with_samples(listed.where("plate < 5").drop("plate")))
    again = lambda df: df.withColumn("row_id", F.col("row_id") + _OFFSET)
    other = Genotypes(again(data.variants), again(data.gt), listed.where("plate >= 5").drop("plate"), again(data.loci), again(data.removed), (), frozenset({"samples", "variants"}))
    return first, f.filter_indels(other)


def _bound(name: str, target: str, ga: str, gb: str, fill: str | None, **options: object) -> None:
    """Per variant the genotype rows, calls and alternate alleles, by its place in the first data set or its locus."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = b.bind(*_halves(spark, d), **options)
        m = metrics.per_variant(out.gt).select("row_id", "n_rows", "called", "sum_g")
        return out.variants.select("row_id", "chrom", "pos", "ref", "alt").join(m, "row_id", "left").select("chrom", "pos", "ref", "alt", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "called", "sum_g")))

    QUERIES[name] = run
    n, called = ("91", f"COUNT(a1) + (91 - COUNT(c.i)) * {fill}") if fill is not None else ("COUNT(c.i)", "COUNT(a1)")
    SQL[name] = f"""{_HALVES}, t AS ({target}), c AS (SELECT row_id, a1, a2, 1 AS i FROM ga WHERE row_id IN (SELECT row_id FROM {ga}) UNION ALL SELECT row_id, a1, a2, 1 FROM gb WHERE row_id IN (SELECT row_id FROM {gb}))
      SELECT {", ".join("MIN(t." + c + ") AS " + c for c in ("chrom", "pos", "ref", "alt"))}, CAST({n} AS BIGINT) AS n_rows, CAST({called} AS BIGINT) AS called, CAST(COALESCE(SUM(a1 + a2), 0) AS BIGINT) AS sum_g
      FROM t LEFT JOIN c ON t.row_id = c.row_id GROUP BY t.row_id"""


_UNION = "SELECT * FROM va UNION SELECT * FROM vb"
_bound("bind_intersect", "SELECT * FROM va WHERE row_id IN (SELECT row_id FROM vb)", "va", "vb", None)
_bound("bind_union", _UNION, "va", "vb", "0", mode="union")
_bound("bind_union_homref", _UNION, "va", "vb", "1", mode="union", absent_as="hom_ref")
_bound("bind_union_recover", _UNION, "l", "l", "0", mode="union", recover_loci=True)
_bound("bind_outgroup", "SELECT * FROM va", "l", "l", "0", outgroup=True)

_bound("bind_sparse", _UNION, "l", "l", "0", mode="union", recover_loci=True)


def _bound_rows(name: str, target: str, allele: str, text: str, **options: object) -> None:
    """Every genotype of the merged data set by locus and sample, with its text."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = b.bind(*_halves(spark, d), **options)
        return out.gt.join(out.variants.select("row_id", "chrom", "pos", "ref", "alt"), "row_id").select("chrom", "pos", "ref", "alt", "sample", "a1", "a2", "phased", "fmt", "dp")

    QUERIES[name] = run
    SQL[name] = f"""{_HALVES}, t AS ({target}), c AS (SELECT * FROM ga WHERE row_id IN (SELECT row_id FROM va) UNION ALL SELECT * FROM gb WHERE row_id IN (SELECT row_id FROM vb))
      SELECT t.chrom, t.pos, t.ref, t.alt, s.sample, CASE WHEN c.row_id IS NULL THEN {allele} ELSE c.a1 END AS a1, CASE WHEN c.row_id IS NULL THEN {allele} ELSE c.a2 END AS a2, c.phased, CASE WHEN c.row_id IS NULL THEN '{text}' ELSE c.fmt END AS fmt, c.dp
      FROM t JOIN s ON TRUE LEFT JOIN c ON c.row_id = t.row_id AND c.sample_idx = s.sample_idx"""


_bound_rows("bind_union_rows", _UNION, "NULL", "./.", mode="union")
_bound_rows("bind_homref_rows", _UNION, "0", "0/0", mode="union", absent_as="hom_ref")

# statistics

_COUNTS = "SELECT g.row_id{grp}, CAST(SUM(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS alt, 2 * COUNT(*) AS nobs FROM g JOIN s ON g.sample_idx = s.sample_idx JOIN v ON g.row_id = v.row_id WHERE a1 IS NOT NULL AND is_biallelic AND NOT is_indel{where} GROUP BY g.row_id{grp}"
_PQ = "2.0 * (alt / CAST(nobs AS DOUBLE)) * (1 - alt / CAST(nobs AS DOUBLE)) * nobs / (nobs - 1)"


def _f_sql(group: bool) -> str:
    grp, on = (", s.grp", "e.row_id = g.row_id AND e.grp = s.grp") if group else ("", "e.row_id = g.row_id")
    return f"""fc AS ({_COUNTS.format(grp=grp, where="")}), e AS (SELECT *, 1 - {_PQ} AS e FROM fc WHERE nobs >= 4 AND alt > 0 AND alt < nobs),
      fs AS (SELECT g.sample_idx, COUNT(*) AS n, COUNT(CASE WHEN a1 = a2 THEN 1 END) AS o, SUM(e.e) AS x FROM g JOIN s ON g.sample_idx = s.sample_idx JOIN e ON {on} WHERE a1 IS NOT NULL GROUP BY g.sample_idx),
      ff AS (SELECT s.sample_idx, s.sample, s.grp, COALESCE(n, 0) AS F_sites, COALESCE(o, 0) AS F_hom_obs, COALESCE(x, 0) AS F_hom_exp, CASE WHEN n - x <> 0 THEN (o - x) / (n - x) END AS F FROM s LEFT JOIN fs ON s.sample_idx = fs.sample_idx)"""


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


for _name, _ref in (("f_all", "all"), ("f_group", "group")):
    _query(_name, f"{_BASE}, {_f_sql(_ref == 'group')} SELECT sample_idx, F_sites, F_hom_obs, round(F_hom_exp, 6) AS F_hom_exp, round(F, 6) + 0.0 AS F FROM ff")(lambda spark, d, ref=_ref: _rounded(stats.inbreeding(load(spark, d), ref), 6))
_query("stats_sample", f"""{_SAMPLE}, {_f_sql(False)}, fm AS (SELECT grp, AVG(F) AS mean_f FROM ff WHERE grp IS NOT NULL GROUP BY grp) SELECT sm.sample, round(CASE WHEN dp_n > 0 THEN dp_sum / dp_n END, 6) AS read_depth,
    round(CASE WHEN homozygotes_ref + homozygotes_alt + heterozygotes > 0 THEN heterozygotes / CAST(homozygotes_ref + homozygotes_alt + heterozygotes AS DOUBLE) END, 6) AS heterozygosity, heterozygotes, homozygotes_ref + homozygotes_alt AS homozygotes,
    homozygotes_ref, homozygotes_alt, round(CASE WHEN total_loci > 0 THEN (total_loci - non_missing) / CAST(total_loci AS DOUBLE) END, 6) AS missing_p, total_loci - non_missing AS missing_n, non_missing, total_loci, sm.grp AS "group", F_sites, F_hom_obs,
    round(F_hom_exp, 6) AS F_hom_exp, round(F, 6) + 0.0 AS F, round(mean_f, 6) + 0.0 AS F_group_mean FROM sm JOIN ff ON sm.sample_idx = ff.sample_idx LEFT JOIN fm ON sm.grp = fm.grp""")(  # fmt: skip
    lambda spark, d: _rounded(stats.sample_statistics(load(spark, d)), 6)
)
_H = "CASE WHEN alt > 0 AND alt < nobs THEN 1 / h.h ELSE 0 END"
_HARM = "h AS (SELECT n, SUM(1.0 / k) OVER (ORDER BY k) AS h FROM (SELECT k + 1 AS n, CAST(k AS DOUBLE) AS k FROM (SELECT unnest(range(1, 20000)) AS k)))"
_query("theta", f"""{_BASE}, {_HARM}, pc AS ({_COUNTS.format(grp=", s.grp", where=" AND s.grp IS NOT NULL")}), tc AS (SELECT row_id, CAST(SUM(alt) AS BIGINT) AS alt, CAST(SUM(nobs) AS BIGINT) AS nobs FROM pc GROUP BY row_id),
    a AS (SELECT grp, alt, nobs FROM pc UNION ALL SELECT NULL, alt, nobs FROM tc), r AS (SELECT grp, AVG({_H}) AS theta_w, AVG({_PQ}) AS pi, COUNT(*) AS n_sites FROM a JOIN h ON a.nobs = h.n WHERE nobs >= 4 GROUP BY grp),
    z AS (SELECT grp, COUNT(*) AS n_ind FROM s WHERE grp IS NOT NULL GROUP BY grp UNION ALL SELECT NULL, COUNT(*) FROM s WHERE grp IS NOT NULL)
    SELECT z.grp, round(theta_w, 9) AS theta_w, round(pi, 9) AS pi, COALESCE(n_sites, 0) AS n_sites, n_ind FROM z LEFT JOIN r ON z.grp IS NOT DISTINCT FROM r.grp""")(lambda spark, d: _rounded(stats.theta(load(spark, d))))  # fmt: skip
_query("stats_theta", SQL["theta"].replace("SELECT z.grp, round(theta_w, 9)", f", tt AS (SELECT z.grp, round(theta_w, 9)") + f"), {_f_sql(True)} SELECT ff.sample, ff.grp AS \"group\", ff.F_sites, round(F, 6) + 0.0 AS F, tt.theta_w, tt.pi, tt.n_ind, w.theta_w AS theta_total, w.pi AS pi_total FROM ff LEFT JOIN tt ON ff.grp = tt.grp LEFT JOIN tt w ON w.grp IS NULL")(
    lambda spark, d: _rounded(stats.sample_statistics(load(spark, d), with_theta=True, f_ref="group").select("sample", "group", "F_sites", F.round("F", 6).alias("F"), "theta_w", "pi", "n_ind", "theta_total", "pi_total"))
)
_query("coverage_points_drawn", f"""{_BASE}, n AS (SELECT COUNT(*) AS n FROM v) SELECT g.row_id, g.sample_idx FROM g JOIN s ON g.sample_idx = s.sample_idx JOIN n ON TRUE
    WHERE a1 IS NOT NULL AND dp IS NOT NULL AND CAST('0x' || substr(md5(g.row_id || ':' || g.sample_idx || ':7'), 1, 8) AS BIGINT) / 4294967296.0 < 500.0 / n""")(
    lambda spark, d: stats.drawn_points(load(spark, d), 500, 7).select("row_id", "sample_idx")
)
_query("memory_estimate", f"""{_BASE}, n AS (SELECT COUNT(CASE WHEN is_biallelic AND NOT is_indel THEN 1 END) AS v FROM v), k AS (SELECT COUNT(*) AS s, COUNT(DISTINCT grp) + MAX(CASE WHEN grp IS NULL THEN 1 ELSE 0 END) AS p FROM s)
    SELECT v AS n_var, s AS n_samples, CAST(p AS BIGINT) AS n_pops, 1000000 * s AS chunk_bytes, 8 * s * v AS matrix_bytes, 8 * s * v + 1000000 * s AS peak_bytes FROM n JOIN k ON TRUE""")(lambda spark, d: spark.createDataFrame([sizing.memory_estimate(load(spark, d))]))
_query("missing_table", f"""{_SAMPLE} SELECT sample, grp AS "group", total_loci - non_missing AS missing_n, round(CASE WHEN total_loci > 0 THEN (total_loci - non_missing) / CAST(total_loci AS DOUBLE) END, 9) AS missing_p, total_loci FROM sm""")(
    lambda spark, d: _rounded(stats.missing_table(load(spark, d)))
)
_query("coverage_points", f"""{_BASE} SELECT s.sample, s.grp AS "group", dp, round(CASE WHEN dp > 0 THEN log10(dp) END, 9) AS log10_dp FROM g JOIN s ON g.sample_idx = s.sample_idx WHERE a1 IS NOT NULL AND dp IS NOT NULL""")(
    lambda spark, d: _rounded(stats.coverage_points(load(spark, d), max_points_per_sample=10**9))
)

# exports: every sample that has a group; the text of each line, or of each block of a line

_ORDER = f"""{_BASE}, first AS (SELECT grp, MIN(sample_idx) AS f FROM s WHERE grp IS NOT NULL GROUP BY grp),
  so AS (SELECT s.sample_idx, s.sample, s.grp, ROW_NUMBER() OVER (ORDER BY f, sample_idx) - 1 AS o FROM s JOIN first ON s.grp = first.grp),
  bv AS (SELECT row_id, chrom, CAST(pos AS BIGINT) AS pos, ref, alt, CASE WHEN id IS NULL OR id IN ('', '.') THEN concat_ws('_', chrom, CAST(CAST(pos AS BIGINT) AS VARCHAR)) ELSE id END AS locus FROM v WHERE is_biallelic AND NOT is_indel)"""
_GRID = f"{_ORDER}, c AS (SELECT bv.row_id, bv.chrom, bv.pos, bv.ref, bv.alt, bv.locus, so.o, so.sample, so.grp, g.a1, g.a2 FROM bv JOIN so ON TRUE LEFT JOIN g ON g.row_id = bv.row_id AND g.sample_idx = so.sample_idx)"
_B1, _B2 = (f"substr(CASE WHEN a{i} = 0 THEN ref ELSE alt END, 1, 1)" for i in (1, 2))
_D1, _D2 = (f"(CASE {t} WHEN 'A' THEN '01' WHEN 'C' THEN '02' WHEN 'G' THEN '03' WHEN 'T' THEN '04' ELSE '00' END)" for t in (_B1, _B2))
_T1, _T2 = ("(CASE WHEN a1 = 0 THEN ref ELSE alt END)", "(CASE WHEN a2 = 0 THEN ref ELSE alt END)")
_COPIES = "CASE WHEN a1 = 0 AND a2 = 0 THEN '0' WHEN a1 = 1 AND a2 = 1 THEN '2' ELSE '1' END"
_R, _A = "substr(ref, 1, 1)", "substr(alt, 1, 1)"
_LETTER = f"CASE WHEN a1 = 0 AND a2 = 0 THEN {_R} WHEN a1 = 1 AND a2 = 1 THEN {_A} ELSE CASE least({_R}, {_A}) || greatest({_R}, {_A}) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K' ELSE 'N' END END"


def _by_sample(name: str, op: Callable, codes: list[str], missing: str, sep: str) -> None:
    QUERIES[name] = lambda spark, d: op(_grouped(spark, d))
    lines = " UNION ALL ".join(f"SELECT {len(codes)} * o + {i} AS o, row_id, CASE WHEN a1 IS NULL THEN '{missing}' ELSE {code} END AS t FROM c" for i, code in enumerate(codes))
    tab = f"chr(9)" if sep == "\t" else f"'{sep}'"
    text = lines.replace("\t", "' || chr(9) || '")
    SQL[name] = f"{_GRID} SELECT CAST(o AS INT) AS o, CAST((row_id - 1) // 50000 AS BIGINT) AS block, string_agg(t, {tab} ORDER BY row_id) AS text FROM ({text}) AS w GROUP BY o, (row_id - 1) // 50000"


def _by_variant(name: str, op: Callable, code: str, missing: str, sep: str) -> None:
    QUERIES[name] = lambda spark, d: op(_grouped(spark, d))
    SQL[name] = f"{_GRID} SELECT row_id, string_agg(CASE WHEN a1 IS NULL THEN '{missing}' ELSE {code} END, '{sep}' ORDER BY o) AS line FROM c GROUP BY row_id"


_by_sample("export_structure", x.structure, ["CASE WHEN a1 = 0 THEN '0' ELSE '1' END", "CASE WHEN a2 = 0 THEN '0' ELSE '1' END"], "-9", "\t")
_by_sample("export_arlequin", x.arlequin, [_T1, _T2], "?", " ")
_by_sample("export_genepop", x.genepop, [f"least({_D1}, {_D2}) || greatest({_D1}, {_D2})"], "0000", " ")
_by_sample("export_fasta", x.fasta, [_LETTER], "?", "")
_by_sample("export_snapp", x.snapp, [_COPIES], "?", "")
_by_sample("export_related", x.related, [f"CASE WHEN {_D1} = '00' OR {_D2} = '00' THEN '0\t0' ELSE least({_D1}, {_D2}) || '\t' || greatest({_D1}, {_D2}) END"], "0\t0", "\t")
_by_sample("export_apparent", x.apparent, [f"least({_T1}, {_T2}) || '/' || greatest({_T1}, {_T2})"], "-/-", "\t")
_by_sample("export_migrate_s", x.migrate_sequences, [_B1, _B2], "?", "")
_by_sample("export_ped", x.ped, [f"{_B1} || ' ' || {_B2}"], "0 0", " ")
_by_variant("export_eigenstrat", x.eigenstrat, "CASE WHEN a1 = 0 AND a2 = 0 THEN '2' WHEN a1 = 1 AND a2 = 1 THEN '0' ELSE '1' END", "9", "")
_by_variant("export_smartsnp", x.smartsnp, _COPIES, "9", " ")
_by_variant("export_snmf", x.snmf, _COPIES, "9", "")
_query("export_bed", f"{_GRID} SELECT row_id, string_agg(CASE WHEN a1 IS NULL THEN '1' WHEN a1 = 0 AND a2 = 0 THEN '3' WHEN a1 = 1 AND a2 = 1 THEN '0' ELSE '2' END, '' ORDER BY o) AS codes FROM c GROUP BY row_id")(
    lambda spark, d: x.plink_bed(_grouped(spark, d)).select("row_id", _unpacked(len(_grouped(spark, d).samples.collect())).alias("codes"))
)


def _unpacked(n: int):  # noqa: ANN202
    """The codes of the packed bytes, to be compared with SQL."""
    value = lambda i: F.conv(F.hex(F.substring("packed", i / 4 + 1, F.lit(1))), 16, 10).cast("int")
    code = lambda i: F.get(F.array(*(F.shiftright(value(i), 2 * k).bitwiseAND(F.lit(3)) for k in range(4))), (i % 4).cast("int")).cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: code(i)), "")


_query("export_gt_long", f"{_ORDER} SELECT CAST(so.o AS INT) AS o, g.row_id, g.sample, a1, a2, phased, fmt, dp, gq, adr FROM g JOIN so ON g.sample_idx = so.sample_idx JOIN bv ON g.row_id = bv.row_id")(lambda spark, d: x.gt_long(_grouped(spark, d)))
_query("export_bayesass", f"{_GRID} SELECT row_id, CAST(o AS INT) AS o, concat_ws(' ', sample, grp, locus, CASE WHEN a1 IS NULL THEN '0 0' ELSE CASE WHEN a1 = 0 THEN '1' ELSE '2' END || ' ' || CASE WHEN a2 = 0 THEN '1' ELSE '2' END END) AS line FROM c")(
    lambda spark, d: x.bayesass(_grouped(spark, d))
)
_POPS = f"""{_GRID}, go AS (SELECT grp, MIN(o) AS go FROM so GROUP BY grp), gn AS (SELECT grp, ROW_NUMBER() OVER (ORDER BY go) - 1 AS g FROM go), bn AS (SELECT row_id, ROW_NUMBER() OVER (ORDER BY row_id) AS n FROM bv),
  pc AS (SELECT c.row_id, gn.g, MIN(bn.n) AS n, MIN(pos) AS pos, MIN(c.ref) AS r, MIN(c.alt) AS a, MIN(c.grp) AS grp, CAST(SUM(CASE WHEN a1 = 0 THEN 1 ELSE 0 END + CASE WHEN a2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ref,
    CAST(SUM(CASE WHEN a1 > 0 THEN 1 ELSE 0 END + CASE WHEN a2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS alt FROM c JOIN gn ON c.grp = gn.grp JOIN bn ON c.row_id = bn.row_id GROUP BY c.row_id, gn.g)"""
_query("export_treemix", f"{_POPS} SELECT row_id, string_agg(ref || ',' || alt, ' ' ORDER BY g) AS line FROM pc GROUP BY row_id")(lambda spark, d: x.treemix(_grouped(spark, d)))
_query("export_bayescan", f"{_POPS} SELECT CAST(g AS INT) AS g, n, n || chr(9) || (ref + alt) || chr(9) || 2 || chr(9) || ref || chr(9) || alt AS line FROM pc")(lambda spark, d: x.bayescan(_grouped(spark, d)))
_query("export_migrate_c", f"""{_POPS} SELECT row_id, CASE WHEN grp = 'REF' THEN 0 ELSE 1 END AS g, COALESCE(CAST(pos AS VARCHAR), 'NA') || chr(9) || substr(r, 1, 1) || chr(9) || ref || chr(9) || substr(a, 1, 1) || chr(9) || alt || chr(9) || (ref + alt) AS line
    FROM (SELECT *, MIN(ref + alt) OVER (PARTITION BY row_id) AS low FROM pc WHERE grp IN ('REF', 'NORTH')) WHERE low > 0""")(lambda spark, d: x.migrate_counts(_grouped(spark, d), ["REF", "NORTH"]))  # fmt: skip
_query("export_migrate_loci", f"""{_ORDER}, n AS (SELECT row_id, ROW_NUMBER() OVER (ORDER BY row_id) AS n FROM bv) SELECT (n - 1) // 100 + 1 AS n, '(s' || COUNT(*) || ')' AS label FROM n GROUP BY (n - 1) // 100""")(
    lambda spark, d: x.migrate_blocks(_grouped(spark, d))
)
_query("export_migrate_n_loci", f"""{_ORDER}, k AS (SELECT row_id, chrom, floor((pos - MIN(pos) OVER (PARTITION BY chrom)) / 100) AS i, ROW_NUMBER() OVER (ORDER BY row_id) AS n FROM bv),
    l AS (SELECT *, CASE WHEN LAG(chrom) OVER (ORDER BY n) IS NOT DISTINCT FROM chrom AND LAG(i) OVER (ORDER BY n) IS NOT DISTINCT FROM i AND n > 1 THEN 0 ELSE 1 END AS s FROM k), r AS (SELECT SUM(s) OVER (ORDER BY n) AS run FROM l)
    SELECT CAST(run AS BIGINT) AS n, '(n' || COUNT(*) || ')' AS label FROM r GROUP BY run""")(lambda spark, d: x.migrate_blocks(_grouped(spark, d), method="N"))  # fmt: skip
_query("export_fineradstructure", f"""{_GRID}, bl AS (SELECT row_id, floor((pos - MIN(pos) OVER (PARTITION BY chrom)) / 10000) AS block FROM bv WHERE pos IS NOT NULL),
    h AS (SELECT chrom, block, o, COUNT(*) - COUNT(a1) AS miss, string_agg({_B1}, '' ORDER BY pos, c.row_id) AS h1, string_agg({_B2}, '' ORDER BY pos, c.row_id) AS h2 FROM c JOIN bl ON c.row_id = bl.row_id GROUP BY chrom, block, o)
    SELECT chrom, CAST(block AS BIGINT) AS block, string_agg(CASE WHEN miss > 0 THEN '' WHEN h1 = h2 THEN h1 ELSE h1 || '/' || h2 END, chr(9) ORDER BY o) AS line FROM h GROUP BY chrom, block""")(  # fmt: skip
    lambda spark, d: x.fineradstructure(_grouped(spark, d))
)
_query("export_bim", f"""{_ORDER}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY locus ORDER BY row_id) - 1 AS again FROM bv)
    SELECT row_id, '0' || chr(9) || locus || CASE WHEN again > 0 THEN '_' || again ELSE '' END || chr(9) || CASE WHEN pos IS NULL THEN 'NA' ELSE printf('%.8f', pos / 1e6) END || chr(9) || COALESCE(CAST(pos AS VARCHAR), 'NA') || chr(9) || alt || chr(9) || ref AS line FROM k""")(  # fmt: skip
    lambda spark, d: x.plink_bim(_grouped(spark, d))
)
_query("export_eigenstrat_snp", f"""{_ORDER}, q AS (SELECT chrom, ROW_NUMBER() OVER (ORDER BY MIN(row_id)) AS code FROM bv GROUP BY chrom)
    SELECT row_id, locus || chr(9) || code || chr(9) || CASE WHEN pos IS NULL THEN 'NA' ELSE printf('%.8f', pos / 1e6) END || chr(9) || COALESCE(CAST(pos AS VARCHAR), 'NA') || chr(9) || ref || chr(9) || alt AS line FROM bv JOIN q ON bv.chrom = q.chrom""")(  # fmt: skip
    lambda spark, d: x.eigenstrat_snp(_grouped(spark, d))
)
_query("export_genlight", f"""{_GRID} SELECT sample, grp AS pop, CAST((row_id - 1) // 50000 AS BIGINT) AS block, string_agg(COALESCE(CAST(a1 + a2 AS VARCHAR), 'NA'), ',' ORDER BY row_id) AS geno FROM c GROUP BY sample, grp, (row_id - 1) // 50000""")(
    lambda spark, d: x.genlight(_grouped(spark, d)).withColumn("geno", F.array_join(F.transform("geno", lambda v: F.coalesce(v.cast("string"), F.lit("NA"))), ","))
)
_query("export_fam", f"{_ORDER} SELECT CAST(o AS INT) AS o, grp || chr(9) || sample || chr(9) || 0 || chr(9) || 0 || chr(9) || 0 || chr(9) || -9 AS line FROM so")(lambda spark, d: x.fam_lines(_grouped(spark, d)))
_query("export_ind", f"{_ORDER} SELECT CAST(o AS INT) AS o, sample || chr(9) || 'U' || chr(9) || grp AS line FROM so")(lambda spark, d: x.ind_lines(_grouped(spark, d)))
_query("export_map", SQL["export_bim"].replace(" || chr(9) || alt || chr(9) || ref AS line", " AS line"))(lambda spark, d: x.map_lines(_grouped(spark, d)))
_query("export_chrommap", f"{_ORDER} SELECT MIN(row_id) AS first, chrom || chr(9) || '0' AS line FROM bv GROUP BY chrom")(lambda spark, d: x.chrom_map_lines(_grouped(spark, d)))
_query("export_bim_keep", SQL["export_bim"].replace("'0' || chr(9) || locus", "chrom || chr(9) || locus"))(lambda spark, d: x.plink_bim(_grouped(spark, d), chrom_code="keep"))
_query("export_admixture_pop", f"{_ORDER} SELECT CAST(o AS INT) AS o, CASE WHEN grp IN ('NORTH', 'ISLE') THEN grp ELSE '-' END AS line FROM so")(lambda spark, d: x.pop_lines(_grouped(spark, d), reference_groups=["NORTH", "ISLE"]))
_query("export_nexus", f"{_GRID}, w AS (SELECT MAX(strlen(sample)) + 3 AS w FROM so) SELECT CAST(o AS INT) AS o, CAST((row_id - 1) // 50000 AS BIGINT) AS block, '    ' || rpad(MIN(sample), MIN(w)::INT, ' ') AS label, string_agg(CASE WHEN a1 IS NULL THEN '?' ELSE {_LETTER} END, '' ORDER BY row_id) AS text FROM c JOIN w ON TRUE GROUP BY o, (row_id - 1) // 50000")(
    lambda spark, d: x.fasta(data := _grouped(spark, d)).join(F.broadcast(x.nexus_labels(data)), "o").select("o", "block", "label", "text")
)
_query("export_fstructure", f"{_ORDER}, gn AS (SELECT grp, ROW_NUMBER() OVER (ORDER BY MIN(o)) AS g FROM so GROUP BY grp) SELECT CAST(2 * o + h AS INT) AS o, sample || chr(9) || g || repeat(chr(9) || '0', 4) || chr(9) AS prefix FROM so JOIN gn ON so.grp = gn.grp JOIN (SELECT unnest([0, 1]) AS h) ON TRUE")(
    lambda spark, d: x.structure_prefixes(_grouped(spark, d), method="F")
)
_query("export_migrate_c_all", SQL["export_migrate_c"].replace("CASE WHEN grp = 'REF' THEN 0 ELSE 1 END AS g", "CAST(g AS INT) AS g").replace(" WHERE grp IN ('REF', 'NORTH')", ""))(lambda spark, d: x.migrate_counts(_grouped(spark, d)))


def _with_counts(spark: SparkSession, d: str) -> Genotypes:
    data = load(spark, d)
    return data.with_variants(data.variants.withColumn("info", F.concat(F.lit("AC=9;AN=9;MAC=9;AF=9;NS=9;"), "info")))


_query("update_info", f"""{_BASE}, m AS (SELECT row_id, COUNT(a1) AS ns FROM g GROUP BY row_id), k AS (SELECT v.row_id, v.info, COALESCE(ns, 0) AS ns, unnest(range(1, regexp_extract_all(COALESCE(alt, ''), ',').len() + 2)) AS k FROM v LEFT JOIN m ON v.row_id = m.row_id),
    a AS (SELECT row_id, a, COUNT(*) AS n FROM (SELECT row_id, a1 AS a FROM g UNION ALL SELECT row_id, a2 FROM g) GROUP BY row_id, a),
    t AS (SELECT k.row_id, MIN(info) AS info, MIN(ns) AS ns, string_agg(CAST(COALESCE(n, 0) AS VARCHAR), ',' ORDER BY k) AS ac, string_agg(CASE WHEN ns > 0 THEN printf('%g', COALESCE(n, 0) / (2.0 * ns)) ELSE '.' END, ',' ORDER BY k) AS af
      FROM k LEFT JOIN a ON k.row_id = a.row_id AND k.k = a.a GROUP BY k.row_id)
    SELECT row_id, 'AC=' || ac || ';AN=' || 2 * ns || ';MAC=9;AF=' || af || ';NS=' || ns || ';' || info AS info FROM t""")(lambda spark, d: vcf.update_info(_with_counts(spark, d)))  # fmt: skip
_query("write_vcf_lines", f"""{_BASE}, c AS (SELECT v.row_id, s.sample_idx, COALESCE(NULLIF(g.fmt, ''), '.') AS t FROM v JOIN s ON TRUE LEFT JOIN g ON g.row_id = v.row_id AND g.sample_idx = s.sample_idx), w AS (SELECT row_id, string_agg(t, chr(9) ORDER BY sample_idx) AS cells FROM c GROUP BY row_id)
    SELECT v.row_id, {" || chr(9) || ".join("COALESCE(NULLIF(" + ("CAST(CAST(pos AS BIGINT) AS VARCHAR)" if c == "pos" else c) + ", ''), '.')" for c in vcf.FIXED)} || chr(9) || cells AS line FROM v JOIN w ON v.row_id = w.row_id WHERE pos IS NOT NULL""")(  # fmt: skip
    lambda spark, d: vcf.vcf_lines(load(spark, d), updated=False)
)
# the same with the INFO of update_info
_query("write_vcf_lines_updated", SQL["update_info"].replace("SELECT row_id, 'AC='", ", u AS (SELECT row_id, 'AC='") + f"""), c AS (SELECT v.row_id, s.sample_idx, COALESCE(NULLIF(g.fmt, ''), '.') AS t FROM v JOIN s ON TRUE LEFT JOIN g ON g.row_id = v.row_id AND g.sample_idx = s.sample_idx), w AS (SELECT row_id, string_agg(t, chr(9) ORDER BY sample_idx) AS cells FROM c GROUP BY row_id)
    SELECT v.row_id, {" || chr(9) || ".join("COALESCE(NULLIF(" + ("CAST(CAST(pos AS BIGINT) AS VARCHAR)" if c == "pos" else "u.info" if c == "info" else "v." + c) + ", ''), '.')" for c in vcf.FIXED)} || chr(9) || cells AS line FROM v JOIN w ON v.row_id = w.row_id JOIN u ON u.row_id = v.row_id WHERE pos IS NOT NULL""")(  # fmt: skip
    lambda spark, d: vcf.vcf_lines(_with_counts(spark, d))
)


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A chain of filters as users write it, ending in one SNV per block."""
    data = f.filter_indels(load(spark, d))
    data = f.filter_coverage(f.filter_maf(f.filter_biallelic(data), 0.03), 10)
    data = f.filter_invariant(f.filter_missing(f.filter_missingness(data, 0.6), 0.9))
    return f.filter_one_snv(data).variants.select("row_id")


QUERIES["pipeline_one_snv"] = pipeline
SQL["pipeline_one_snv"] = f"""{_BASE}, v1 AS (SELECT * FROM v WHERE NOT is_indel AND is_biallelic), m1 AS ({_metrics("g")}), v2 AS (SELECT v1.* FROM v1 JOIN m1 ON v1.row_id = m1.row_id WHERE called > 0 AND least(sum_g / (2.0 * called), 1 - sum_g / (2.0 * called)) >= 0.03),
  g2 AS (SELECT g.row_id, sample_idx, CASE WHEN COALESCE(dp, -1) >= 10 THEN a1 END AS a1, CASE WHEN COALESCE(dp, -1) >= 10 THEN a2 END AS a2 FROM g JOIN v2 ON g.row_id = v2.row_id), m2 AS ({_metrics("g2")}),
  v3 AS (SELECT v2.* FROM v2 JOIN m2 ON v2.row_id = m2.row_id WHERE (n_rows - called) / CAST(n_rows AS DOUBLE) <= 0.6), g3 AS (SELECT g2.* FROM g2 JOIN v3 ON g2.row_id = v3.row_id),
  k AS (SELECT sample_idx FROM g3 GROUP BY sample_idx HAVING COUNT(CASE WHEN a1 IS NULL THEN 1 END) / CAST(COUNT(*) AS DOUBLE) < 0.9), m4 AS ({_metrics("(SELECT * FROM g3 WHERE sample_idx IN (SELECT sample_idx FROM k)) AS l")}),
  v4 AS (SELECT v3.* FROM v3 JOIN m4 ON v3.row_id = m4.row_id WHERE {_POLY}), bl AS (SELECT *, floor((pos - MIN(pos) OVER (PARTITION BY chrom)) / 10000) AS block FROM v4 WHERE pos IS NOT NULL)
  SELECT row_id FROM (SELECT row_id, ROW_NUMBER() OVER (PARTITION BY chrom, block ORDER BY pos, row_id) AS i FROM bl) WHERE i = 1"""
