"""Queries of the training-data operators, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilake.llm import leaks, packing, pii, quantiles, topn
from varilake.operators.profile import numeric_text, whole_and_positive
from varilake.session import read_table

PERCENTS = (50, 90, 99)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    variants = read_table(spark, d, "variants")
    scored = variants.withColumn("score", numeric_text(variants["qual"]))
    return topn.top_n(scored, "chrom", "score", "row_id", 3, (scored["pos"],)).select("chrom", "rnk", "row_id")


def _depths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gt = read_table(spark, d, "gt")
    value = F.when(whole_and_positive(gt["dp"]), gt["dp"])
    return gt, quantiles.percentiles(gt, "sample", value, PERCENTS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    gt, answers = _depths(spark, d)
    values = quantiles.exact(gt, "sample", F.when(whole_and_positive(gt["dp"]), gt["dp"]), answers)
    usual = values.groupBy("pct").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY val)").alias("usual"))
    apart = (F.col("val") >= 1.5 * F.col("usual")) | (F.col("val") * 1.5 <= F.col("usual"))
    return values.join(F.broadcast(usual), "pct").where(apart).select("sample", "pct")


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _depths(spark, d)[1]


def p6_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether the percentile counted value by value lies between the sketch's bounds, and its share of error is as stated."""
    gt, answers = _depths(spark, d)
    true = gt.groupBy("sample").agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY CASE WHEN dp >= 0 AND NOT isnan(dp) AND dp = rint(dp) AND dp < double('inf') THEN dp END)").alias(f"_{p}") for p in PERCENTS))
    exact = true.select(F.col("sample").alias("_s"), F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"_{p}").alias("x")) for p in PERCENTS))).alias("_t"))
    both = answers.join(exact, F.col("sample").eqNullSafe(F.col("_s")) & (F.col("pct") == F.col("_t.p")))
    return both.select("sample", "pct", "n", F.col("_t.x").between(F.col("low"), F.col("high")).alias("inside"), (F.col("error") <= 0.0035 * F.col("n")).alias("close"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(read_table(spark, d, "documents"), read_table(spark, d, "pack_targets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, beside a bound that no packing can be below."""
    return packing.fill_report(read_table(spark, d, "documents"), read_table(spark, d, "pack_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_edits(spark: SparkSession, d: str) -> DataFrame:
    """The same with a budget of one word edit: passages that were slightly changed count too."""
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), edits=1)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(read_table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(read_table(spark, d, "documents")).select("doc_id", "redacted")


QUERIES = {f.__name__: f for f in (p5_found, p6_found, p6_percentiles, p6_within, p7_pack, p7_fill, p8_found, p8_edits, p9_found, p9_redacted)}

_QUAL = "^[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"
SQL = {
    "p5_found": f"""WITH q AS (SELECT DISTINCT chrom, pos, row_id, TRY_CAST(qual AS DOUBLE) AS score FROM variants WHERE regexp_full_match(qual, '{_QUAL}')),
      r AS (SELECT chrom, row_id, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY score DESC, pos ASC NULLS LAST, row_id) AS rnk FROM q)
      SELECT chrom, CAST(rnk AS INT) AS rnk, row_id FROM r WHERE rnk <= 3""",
    "p6_found": """WITH d AS (SELECT sample, dp, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY dp) AS i, COUNT(*) OVER (PARTITION BY sample) AS n
        FROM gt WHERE dp >= 0 AND NOT isnan(dp) AND NOT isinf(dp) AND dp = floor(dp)),
      p AS (SELECT d.sample, c.pct, MIN(d.dp) AS val FROM d JOIN (SELECT 50 AS pct UNION ALL SELECT 90 UNION ALL SELECT 99) c ON d.i * 100 >= c.pct * d.n GROUP BY d.sample, c.pct),
      o AS (SELECT pct, val, ROW_NUMBER() OVER (PARTITION BY pct ORDER BY val) AS i, COUNT(*) OVER (PARTITION BY pct) AS n FROM p),
      u AS (SELECT pct, val AS usual FROM o WHERE i = (n + 1) // 2)
      SELECT p.sample, CAST(p.pct AS INT) AS pct FROM p JOIN u ON p.pct = u.pct WHERE p.val >= 1.5 * u.usual OR p.val * 1.5 <= u.usual""",
    "p6_within": """SELECT sample, CAST(c.pct AS INT) AS pct, COUNT(*) AS n, TRUE AS inside, TRUE AS close FROM gt JOIN (SELECT 50 AS pct UNION ALL SELECT 90 UNION ALL SELECT 99) c ON TRUE
      WHERE dp >= 0 AND NOT isnan(dp) AND NOT isinf(dp) AND dp = floor(dp) GROUP BY sample, c.pct""",
    "p8_found": r"""WITH
      dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents),
      iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM eval_items),
      dg AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
      ig AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw))
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.g = ig.g""",
}
