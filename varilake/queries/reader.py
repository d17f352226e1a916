"""Queries of the VCF reader over raw lines, as they are in vcf_lines: damaged ones too, in files with different samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilake.operators import reject
from varilake.session import read_table
from varilake.sources import vcf


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, line, n): the data lines of files with a header, and the number of samples their file has."""
    lines = read_table(spark, d, "vcf_lines")
    data, _ = reject.with_widths(lines.select("line_id", "src_file", "line_no", "line"))
    body = F.regexp_replace("line", r"\r\z", "")
    return data.where("width IS NOT NULL AND NOT startswith(line, '#')").select(F.col("line_id").alias("row_id"), body.alias("line"), (F.col("width") - 9).alias("n")).where("line <> ''")


def reader_variants(spark: SparkSession, d: str) -> DataFrame:
    return vcf.parse_variants(_lines(spark, d))


def reader_genotypes(spark: SparkSession, d: str) -> DataFrame:
    return vcf.parse_genotypes(_lines(spark, d), F.col("n")).drop("n_samples")


def reader_report(spark: SparkSession, d: str) -> DataFrame:
    return vcf.parse_report(_lines(spark, d), F.col("n"))


def reader_info(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of INFO: the first value of a key at the beginning of an entry, null if it is none."""
    sites = read_table(spark, d, "vcf_sites")
    return sites.select("site_id", *(vcf.info_number(sites["info"], k).alias(k.lower()) for k in ("DP", "AF", "Rk", "RPT", "MQ")))


QUERIES = {f.__name__: f for f in (reader_variants, reader_genotypes, reader_report, reader_info)}

_BASE = """WITH b AS (SELECT line_id, src_file, line_no, regexp_replace(line, '\\r$', '') AS line FROM vcf_lines),
  w AS (SELECT src_file, arg_min(len(string_split(line, chr(9))), line_no) AS width FROM b WHERE regexp_matches(line, '^#CHROM(\\t|$)') GROUP BY src_file),
  l AS (SELECT line_id AS row_id, string_split(line, chr(9)) AS f, width - 9 AS n FROM b JOIN w ON b.src_file = w.src_file WHERE NOT starts_with(line, '#') AND line <> '')"""
_NUMBER = "(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"


def _number(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '{_NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END"


def _info(key: str, info: str = "info") -> str:
    value = f"NULLIF(regexp_extract({info}, '(?:^|;){key}=([^;]*)', 1), '')"
    return f"{_number(value)} AS {key.lower()}"


_TEXTS = ", ".join(f"COALESCE(f[{i}], '') AS {c}" for i, c in enumerate(vcf.FIXED, 1))
_GENOTYPES = f"""{_BASE}, c AS (SELECT row_id, f, n, COALESCE(f[5], '') AS alt, string_split(COALESCE(f[9], ''), ':') AS keys, unnest(range(0, n)) AS i FROM l),
  r AS (SELECT *, f[i + 10] AS raw, string_split(COALESCE(f[i + 10], ''), ':') AS vals FROM c),
  v AS (SELECT *, list_position(keys, 'GT') AS gt_at, COALESCE(vals[NULLIF(list_position(keys, 'GT'), 0)], '') AS gt, vals[NULLIF(list_position(keys, 'DP'), 0)] AS dp_t, vals[NULLIF(list_position(keys, 'GQ'), 0)] AS gq_t,
    string_split(vals[NULLIF(list_position(keys, 'AD'), 0)], ',') AS ad FROM r),
  p AS (SELECT *, list_transform(regexp_split_to_array(gt, '[/|]'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')) AS a, {_number("ad[1]")} AS ad1, {_number("ad[2]")} AS ad2 FROM v),
  q AS (SELECT *, len(a) AS k, regexp_full_match(gt, '(?:[.]|[0-9]+)(?:[/|](?:[.]|[0-9]+))*') AND len(list_filter(a, lambda x: x <> '.' AND len(x) > 6 AND x <> '1000000')) = 0 AS shaped,
    regexp_extract(gt, '^(?:[.]|[0-9]+)([/|])', 1) AS sep, COALESCE(a[1] = '.' OR len(a[1]) < 7 OR a[1] = '1000000', FALSE) AS small FROM p),
  g AS (SELECT *, k = 2 AND (a[1] = '.') <> (a[2] = '.') AS half FROM q),
  o AS (SELECT row_id, CAST(i AS INT) AS sample_idx, CASE WHEN shaped AND k <= 2 AND NOT half AND a[1] <> '.' THEN TRY_CAST(a[1] AS INT) END AS a1,
      CASE WHEN shaped AND k <= 2 AND NOT half AND a[CASE WHEN k = 1 THEN 1 ELSE 2 END] <> '.' THEN TRY_CAST(a[CASE WHEN k = 1 THEN 1 ELSE 2 END] AS INT) END AS a2,
      COALESCE(sep = '|' AND small AND NOT (shaped AND k > 2), FALSE) AS phased, COALESCE(raw, '') AS fmt, {_number("dp_t")} AS dp, {_number("gq_t")} AS gq,
      CASE WHEN alt NOT LIKE '%,%' AND ad1 + ad2 > 0 THEN ad2 / (ad1 + ad2) END AS adr,
      CASE WHEN raw IS NULL THEN 'absent' WHEN COALESCE(gt_at, 0) = 0 THEN 'no_gt' WHEN NOT shaped THEN 'malformed' WHEN k > 2 THEN 'polyploid' WHEN half THEN 'half_missing' WHEN k = 1 THEN 'haploid' ELSE 'diploid' END AS kind, n FROM g)"""
SQL = {
    "reader_variants": f"""{_BASE}, v AS (SELECT row_id, {_TEXTS} FROM l) SELECT row_id, chrom, CASE WHEN regexp_full_match(pos, '[0-9]{{1,17}}') AND TRY_CAST(pos AS BIGINT) <= 9007199254740992 THEN CAST(TRY_CAST(pos AS BIGINT) AS DOUBLE) END AS pos,
      id, ref, alt, qual, filter, info, format, {_info("Rk")}, {_info("RPT")}, CAST(len(alt) - len(replace(alt, ',', '')) + 1 AS INT) AS n_alt, alt NOT LIKE '%,%' AS is_biallelic,
      len(ref) <> 1 OR regexp_matches(alt, '[^,]{{2,}}') OR regexp_matches(alt, '(^|,),') AS is_indel FROM v""",
    "reader_genotypes": f"{_GENOTYPES} SELECT * EXCLUDE (n) FROM o",
    "reader_report": f"""{_GENOTYPES} SELECT {", ".join(f"COUNT(CASE WHEN kind = '{k}' THEN 1 END) AS {k}" for k in vcf.REPORT[:4])},
      COUNT(DISTINCT CASE WHEN kind = 'absent' THEN row_id END) AS short_lines, COUNT(DISTINCT CASE WHEN kind = 'no_gt' THEN row_id END) AS no_gt_lines FROM o""",
    "reader_info": f"SELECT site_id, {', '.join(_info(k) for k in ('DP', 'AF', 'Rk', 'RPT', 'MQ'))} FROM vcf_sites",
}
