"""Queries of the table-quality operators: profiles, packed fields, copies of a table, unreadable records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilake.operators import copydiff, profile, reject, unpack
from varilake.session import read_table


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile({t: read_table(spark, d, t) for t in ("gt", "variants")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.changed_measures(_profile(spark, d))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).select(
        "tab", "col", "load_id", "n_rows", "n_null", "n_bad", "distinct_count", "n_top", "n_numbers", "min_value", "max_value", "min_text", "max_text",
        F.round("mean_value", 6).alias("mean_value"), F.round("sd_value", 4).alias("sd_value"),
    )


def p1_shift(spark: SparkSession, d: str) -> DataFrame:
    return profile.shifts(_profile(spark, d)).select("tab", "col", "load_id", F.round("std_diff", 6).alias("std_diff"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack.unpack(read_table(spark, d, "vcf_sites"), "site_id", {"info": unpack.INFO, "alt": unpack.ALT, "fmt": unpack.FMT})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {"chrom": False, "pos": True, "ref": False, "alt": False}
    return copydiff.differences(read_table(spark, d, "variants"), read_table(spark, d, "loci"), "row_id", fields, ("variants", "loci"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return reject.rejected(read_table(spark, d, "vcf_lines")).select("line_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return reject.loaded(read_table(spark, d, "vcf_lines")).withColumn("samples", F.array_join("samples", "\t"))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_shift, p2_found, p3_found, p4_found, p4_loaded)}

_NUMBER = "^[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"
_CELLS = f"""
cells AS (
  SELECT 'gt' AS tab, 'a1' AS col, load_id, CAST(a1 AS VARCHAR) AS v, a1 >= 0 AS ok, CAST(a1 AS DOUBLE) AS x FROM gt
  UNION ALL SELECT 'gt', 'dp', load_id, CAST(dp AS VARCHAR), NOT isnan(dp) AND dp >= 0 AND NOT isinf(dp) AND dp = floor(dp), dp FROM gt
  UNION ALL SELECT 'variants', 'qual', load_id, qual, qual = '.' OR regexp_full_match(qual, '{_NUMBER}'),
    CASE WHEN regexp_full_match(qual, '{_NUMBER}') THEN TRY_CAST(qual AS DOUBLE) END FROM variants
  UNION ALL SELECT 'variants', 'filter', load_id, filter, regexp_full_match(filter, '[.]|[A-Za-z0-9_]+(;[A-Za-z0-9_]+)*'), NULL FROM variants),
tops AS (SELECT tab, col, load_id, MAX(n) AS n_top FROM (SELECT tab, col, load_id, v, COUNT(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY tab, col, load_id, v) GROUP BY tab, col, load_id),
figures AS (
  SELECT tab, col, load_id, COUNT(*) AS n_rows, COUNT(*) - COUNT(v) AS n_null, COUNT(CASE WHEN v IS NOT NULL AND NOT COALESCE(ok, FALSE) THEN 1 END) AS n_bad,
    COUNT(DISTINCT v) AS distinct_count, COUNT(CASE WHEN ok THEN x END) AS n_numbers, MIN(CASE WHEN ok THEN x END) AS min_value, MAX(CASE WHEN ok THEN x END) AS max_value,
    MIN(CASE WHEN col = 'filter' THEN v END) AS min_text, MAX(CASE WHEN col = 'filter' THEN v END) AS max_text,
    AVG(CASE WHEN ok THEN x END) AS mean_value, STDDEV_POP(CASE WHEN ok THEN x END) AS sd_value
  FROM cells GROUP BY tab, col, load_id),
prof AS (SELECT f.*, COALESCE(t.n_top, 0) AS n_top FROM figures f LEFT JOIN tops t ON f.tab = t.tab AND f.col = t.col AND f.load_id = t.load_id),
shares AS (
  SELECT *, n_null / CAST(n_rows AS DOUBLE) AS null_share,
    CASE WHEN n_rows > n_null THEN n_bad / CAST(n_rows - n_null AS DOUBLE) ELSE 0 END AS bad_share,
    CASE WHEN n_rows > n_null THEN n_top / CAST(n_rows - n_null AS DOUBLE) ELSE 0 END AS top_share FROM prof)
"""


def _test(measure: str, condition: str) -> str:
    return f"SELECT b.tab, b.col, b.load_id, '{measure}' AS measure FROM shares b JOIN shares a ON a.tab = b.tab AND a.col = b.col AND a.load_id = b.load_id - 1 WHERE {condition}"


def _by(name: str, where: str = "TRUE") -> str:
    return _test(name, f"{where} AND abs(b.{name} - a.{name}) >= 0.12")


def _factor(name: str, limit: float, where: str = "TRUE") -> str:
    a, b = f"COALESCE(CAST(a.{name} AS DOUBLE), 0)", f"COALESCE(CAST(b.{name} AS DOUBLE), 0)"
    return _test(name, f"{where} AND {a} <> {b} AND greatest({a}, {b}) >= {limit} * least({a}, {b})")


_TEXT, _NUM = "b.col = 'filter'", "b.col <> 'filter'"
_CHANGES = " UNION ALL ".join(
    [_by("null_share"), _by("bad_share"), _factor("distinct_count", 2), _factor("max_value", 3, _NUM), _factor("mean_value", 1.25, _NUM), _by("top_share", _TEXT)]
)

# Separators within quotes become private characters, so that splitting leaves them alone; the last steps turn them back.
_SPAN = '"[^"]*(?:""[^"]*)*"'
_PLAIN, _PRIVATE = "';|,/:' || chr(9)", "chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349) || chr(57350)"
_P2_KEY = "[A-Za-z][A-Za-z0-9_]*"
_P2_SPLIT = {"info": "[;|\t]", "alt": "[,/;|]", "fmt": "[:;\t]"}


def _p2_field(name: str) -> str:
    hidden = f"""array_to_string(list_transform(range(1, len(regexp_split_to_array({name}, '{_SPAN}')) + 1), lambda i: regexp_split_to_array({name}, '{_SPAN}')[i] || COALESCE(translate(regexp_extract_all({name}, '{_SPAN}')[i], {_PLAIN}, {_PRIVATE}), '')), '')"""
    if name == "info":
        hidden = f"""regexp_replace({hidden}, ',([ \t]*(?:"?{_P2_KEY}=|"{_P2_KEY}"=))', ';\\1', 'g')"""
    keep = ", lambda t: t <> ''" if name == "info" else ", lambda t: TRUE"
    return f"""SELECT site_id, '{name}' AS field, list_filter(list_transform(regexp_split_to_array({hidden}, '{_P2_SPLIT[name]}'), lambda t: trim(t, ' ' || chr(9))){keep}) AS t FROM vcf_sites WHERE {name} IS NOT NULL"""


_P2 = f"""WITH f AS ({" UNION ALL ".join(map(_p2_field, _P2_SPLIT))}), e AS (SELECT site_id, field, unnest(range(1, len(t) + 1)) AS idx, t FROM f), v AS (SELECT site_id, field, idx, t[idx] AS v FROM e)
  SELECT site_id, field, CAST(idx AS INT) AS idx, translate(CASE WHEN regexp_full_match(v, '(?:[^"=]*=)?{_SPAN}') THEN regexp_extract(v, '^([^"=]*=?)"', 1) || replace(regexp_extract(v, '^[^"=]*=?"((?s:.*))"$', 1), '""', '"') ELSE v END, {_PRIVATE}, {_PLAIN}) AS val FROM v"""

_P4_FIELD = '(^|\t)"[^"]*(?:""[^"]*)*"'
_P4_ALLELE = "(?:[.]|0*(?:[0-9]{1,6}|1000000))"
_P4 = f"""WITH l AS (SELECT line_id, src_file, line_no, regexp_replace(COALESCE(line, ''), '\\r$', '') AS b FROM vcf_lines),
  w AS (SELECT src_file, arg_min(len(string_split(b, chr(9))), line_no) AS width FROM l WHERE regexp_matches(b, '^#CHROM(\\t|$)') GROUP BY src_file),
  m AS (SELECT l.*, w.width, regexp_replace(b, '{_P4_FIELD}', '\\1' || chr(1), 'g') AS k, list_transform(regexp_extract_all(chr(9) || b, '\\t("(?:[^"]|"")*"|[^\\t]*)', 1), lambda x: CASE WHEN x LIKE '"%"' AND len(x) > 1 THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END) AS t
    FROM l LEFT JOIN w ON l.src_file = w.src_file WHERE NOT starts_with(b, '#')),
  n AS (SELECT *, string_split(t[9], ':') AS keys, regexp_replace(t[2], '^0+', '') AS p FROM m),
  c AS (SELECT *, CASE WHEN regexp_matches(k, '(^|\\t)"') OR regexp_matches(k, '\\x01[^\\t]') THEN 'quoting' WHEN len(string_split(k, chr(9))) IS DISTINCT FROM width THEN 'column_count'
    WHEN NOT regexp_full_match(t[2], '[0-9]+') OR len(p) > 16 OR COALESCE(TRY_CAST(p AS BIGINT), 0) > 9007199254740992 THEN 'pos'
    WHEN list_contains(keys, '') OR len(list_distinct(keys)) < len(keys) OR NOT list_contains(keys, 'GT') THEN 'format'
    WHEN len(list_filter(t[10:], lambda x: len(string_split(x, ':')) > len(keys) OR NOT COALESCE(regexp_full_match(string_split(x, ':')[list_position(keys, 'GT')], '{_P4_ALLELE}(?:[/|]{_P4_ALLELE})?'), FALSE))) > 0 THEN 'fmt' END AS reason FROM n)"""

SQL = {
    "p1_found": f"WITH {_CELLS} {_CHANGES}",
    "p1_profile": f"""WITH {_CELLS} SELECT tab, col, load_id, n_rows, n_null, n_bad, distinct_count, n_top, n_numbers, min_value, max_value, min_text, max_text,
        round(mean_value, 6) AS mean_value, round(sd_value, 4) AS sd_value FROM prof""",
    "p1_shift": f"""WITH {_CELLS} SELECT b.tab, b.col, b.load_id,
        round(CASE WHEN a.sd_value + b.sd_value > 0 THEN (b.mean_value - a.mean_value) / sqrt((a.sd_value * a.sd_value + b.sd_value * b.sd_value) / 2) END, 6) AS std_diff
      FROM prof b JOIN prof a ON a.tab = b.tab AND a.col = b.col AND a.load_id = b.load_id - 1 WHERE a.n_numbers > 0 AND b.n_numbers > 0""",
    "p3_found": """WITH
      v AS (SELECT DISTINCT row_id, chrom, pos, ref, alt FROM variants), l AS (SELECT DISTINCT row_id, chrom, pos, ref, alt FROM loci),
      j AS (SELECT v.chrom AS c1, l.chrom AS c2, v.pos AS p1, CAST(l.pos AS DOUBLE) AS p2, v.ref AS r1, l.ref AS r2, v.alt AS a1, l.alt AS a2, v.row_id FROM v JOIN l ON v.row_id = l.row_id)
      SELECT row_id, 'only_in_variants' AS diff FROM v WHERE row_id NOT IN (SELECT row_id FROM l)
      UNION ALL SELECT row_id, 'only_in_loci' FROM l WHERE row_id NOT IN (SELECT row_id FROM v)
      UNION ALL SELECT row_id, 'chrom' FROM j WHERE c1 IS DISTINCT FROM c2
      UNION ALL SELECT row_id, 'pos' FROM j WHERE p1 IS DISTINCT FROM p2
      UNION ALL SELECT row_id, 'ref' FROM j WHERE r1 IS DISTINCT FROM r2
      UNION ALL SELECT row_id, 'alt' FROM j WHERE a1 IS DISTINCT FROM a2""",
    "p2_found": _P2,
    "p4_found": f"{_P4} SELECT line_id, reason FROM c WHERE reason IS NOT NULL",
    "p4_loaded": f"""{_P4} SELECT line_id, src_file, line_no, t[1] AS chrom, CAST(t[2] AS BIGINT) AS pos, t[3] AS id, t[4] AS ref, t[5] AS alt, t[6] AS qual, t[7] AS filter, t[8] AS info, t[9] AS format, array_to_string(t[10:], chr(9)) AS samples
      FROM c WHERE reason IS NULL""",
}
