"""Raw VCF lines: readable records as typed rows, the others apart with the reason.

Every line is read permissively under an explicit schema, with the columns that the #CHROM line of its file names; the
raw text of a line that does not fit is kept in a column of its own. What the reader lets pass but VCF does not (its
casts are laxer, and FORMAT and the sample fields are packed) makes a line corrupt too. Only corrupt lines are then
taken apart and classified by quoting, column count and casts; a line that the reader could not follow but that breaks
no rule is readable after all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilake.functions import quoting

FIXED = 9
MAX_POS = 2**53
MAX_ALLELE = 1_000_000
NAMES = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
SPARE_COLUMNS = 10_000
"""Tabs beyond the widest file's that the reader may meet; a line with more is corrupt without being read."""
BROADCAST_FILES = 100_000
"""Most files whose header widths are broadcast, at some 50 bytes each; more are joined by a salted shuffle."""
SALTS = 32
REASONS = ("quoting", "column_count", "pos", "format", "fmt")

_FIELD = r'(?:^|\t)"[^"]*+(?:""[^"]*+)*+"'
_HELD = r"\x01q\d+\x02"
_POS = r"^[^\t\"]*\t0*[0-9]{1,16}\t"
_ALLELE = r"(?:\.|0*(?:[0-9]{1,6}|1000000))"
_GT = rf"^{_ALLELE}(?:[/|]{_ALLELE})?\z"


def _lead(span: Column) -> Column:
    return F.when(span.startswith("\t"), F.lit("\t")).otherwise(F.lit(""))


def fields_of(body: Column) -> tuple[Column, Column]:
    """The text with its quoted fields behind placeholders, and its fields, unquoted."""
    escaped = quoting.escape(body)
    spans = quoting.spans_of(escaped, _FIELD)
    bare = F.transform(spans, lambda s: F.regexp_replace(s, r"^\t", ""))
    masked = F.when(body.contains('"'), quoting.mask(escaped, spans, lambda _: F.lit("q"), _FIELD, _lead)).otherwise(escaped)
    return masked, F.transform(F.split(masked, "\t", -1), lambda t: quoting.restore(t, bare, F.lit(True)))


def schema_of(width: int) -> str:
    """The explicit schema of a file with so many columns: the fixed ones, one per sample, and the raw text of what does not fit."""
    fixed = [f"{c} {'DECIMAL(20,0)' if c == 'pos' else 'STRING'}" for c in NAMES]
    return ", ".join([*fixed, *(f"s{i} STRING" for i in range(max(width, FIXED) - FIXED)), "corrupt STRING"])


def header_widths(lines: DataFrame) -> DataFrame:
    """(src_file, width): columns that the first #CHROM line of each file names. One small row per file."""
    heads = lines.where(F.col("line").rlike(r"^#CHROM(?:\t|\r?\z)")).select("src_file", "line_no", F.size(F.split(F.regexp_replace("line", r"\r\z", ""), "\t", -1)).alias("width"))
    return heads.groupBy("src_file").agg(F.min_by("width", "line_no").alias("width"))


def with_widths(lines: DataFrame) -> tuple[DataFrame, int]:
    """lines with width, and the largest width. Files are as many as are listed here, else a salted join."""
    widths = header_widths(lines)
    listed = widths.limit(BROADCAST_FILES + 1).collect()
    if len(listed) <= BROADCAST_FILES:
        table = lines.sparkSession.createDataFrame(listed, widths.schema)
        return lines.join(F.broadcast(table), "src_file", "left"), max((r["width"] for r in listed), default=FIXED)
    copies = widths.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("line_no"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["src_file", "_salt"], "left").drop("_salt"), widths.agg(F.max("width")).first()[0]


def _faults(keys: Column, samples: Column) -> dict[str, Column]:
    """Whether FORMAT, or a sample field under it, can't be read."""
    at = F.array_position(keys, "GT")

    def unreadable(sample: Column) -> Column:
        values = F.split(sample, ":", -1)
        return (F.size(values) > F.size(keys)) | ~F.coalesce(F.get(values, (at - 1).cast("int")).rlike(_GT), F.lit(False))

    return {
        "format": ~F.coalesce((at > 0) & ~F.array_contains(keys, "") & (F.size(F.array_distinct(keys)) == F.size(keys)), F.lit(False)),
        "fmt": F.coalesce(F.exists(samples, unreadable), F.lit(True)),
    }


def read_permissive(lines: DataFrame) -> DataFrame:
    """All data lines: src_file, line_id, line_no, line, width, fields, pos, corrupt (by the reader) and reason.

    One pass without a shuffle. corrupt is the raw line if it does not fit its file's columns or their types, else
    null. reason is null for readable lines, and is only worked out where corrupt is not null. Header lines (#) are no
    data; blank lines are. A trailing carriage return belongs to the line end. A null line is read as an empty one; a
    line of a file without a #CHROM line has the wrong number of columns. Repeated lines are each read; other columns
    are ignored; an empty table gives no row.
    """
    lines = lines.select("line_id", "src_file", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    data, widest = with_widths(lines)
    data = data.where(~F.col("line").startswith("#")).withColumn("_body", F.regexp_replace("line", r"\r\z", ""))
    tabs = F.length("_body") - F.length(F.replace("_body", F.lit("\t"), F.lit("")))
    # a narrower file's lines are filled up with empty columns, so that one schema has the right width for each of them
    filled = F.when(tabs <= widest + SPARE_COLUMNS, F.concat("_body", F.repeat(F.lit("\t"), F.lit(widest) - F.col("width"))))
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "maxColumns": str(2 * widest + SPARE_COLUMNS + 1)}
    record = F.from_csv(filled, schema_of(widest), options)
    # as a generator, so that the reader runs once a line whatever is asked of its result
    data = data.select("*", F.explode(F.array(record)).alias("_r"))
    text = [F.coalesce(F.col(f"_r.{c}").cast("string"), F.lit("")) for c in [*NAMES, *(f"s{i}" for i in range(widest - FIXED))]]
    read = F.slice(F.array(*text), F.lit(1), F.coalesce("width", F.lit(0)))
    lax = ~F.col("_body").rlike(_POS) | (F.col("_r.pos") > MAX_POS) | F.col("_body").rlike("[\r\n]") | (F.col("_body").contains('"') & F.exists(read, lambda f: f.startswith('"')))
    packed = _faults(F.split(text[FIXED - 1], ":", -1), F.slice(read, F.lit(FIXED + 1), F.greatest(F.col("width") - FIXED, F.lit(0))))
    ok = F.col("_r.corrupt").isNull() & F.col("width").isNotNull() & ~lax & ~packed["format"] & ~packed["fmt"]
    corrupt = F.when(~F.coalesce(ok, F.lit(False)), F.col("line"))
    data = data.select("line_id", "src_file", "line_no", "line", "width", F.explode(F.array(F.struct(corrupt.alias("corrupt"), read.alias("read")))).alias("_x")).select("*", "_x.*").drop("_x")
    masked, fields = fields_of(F.regexp_replace("corrupt", r"\r\z", ""))
    apart = F.explode(F.array(F.when(F.col("corrupt").isNotNull(), F.struct(masked.alias("masked"), fields.alias("fields"))))).alias("_a")
    return data.select("*", apart).select("line_id", "src_file", "line_no", "line", "width", "corrupt", F.coalesce("_a.fields", "read").alias("fields"), _reason().alias("reason"))


def _reason() -> Column:
    """The first of REASONS that applies to a corrupt line taken apart, or null."""
    fields = F.col("_a.fields")
    pos = F.get(fields, F.lit(1))
    keys = F.split(F.get(fields, F.lit(FIXED - 1)), ":", -1)
    tests = {
        "quoting": F.col("_a.masked").rlike(rf'(?:^|\t)"|{_HELD}[^\t]'),
        "column_count": ~F.coalesce(F.size(fields) == F.col("width"), F.lit(False)),
        "pos": ~F.coalesce(pos.rlike(r"^[0-9]+\z") & (F.regexp_replace(pos, "^0+(?=[0-9])", "").try_cast("decimal(38,0)") <= MAX_POS), F.lit(False)),
    } | _faults(keys, F.slice(fields, FIXED + 1, F.greatest(F.size(fields) - FIXED, F.lit(0))))
    return F.when(F.col("corrupt").isNotNull(), F.coalesce(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reason, line): every data line that can't be read, with the first of REASONS that applies."""
    return read_permissive(lines).where("reason IS NOT NULL").select("line_id", "reason", "line")


def loaded(lines: DataFrame) -> DataFrame:
    """The readable records: fixed columns typed, the sample fields as an array in column order."""
    ok = read_permissive(lines).where("reason IS NULL")
    cols = [F.get("fields", F.lit(i)).alias(c) if c != "pos" else F.get("fields", F.lit(1)).cast("bigint").alias("pos") for i, c in enumerate(NAMES)]
    return ok.select("line_id", "src_file", "line_no", *cols, F.slice("fields", FIXED + 1, F.size("fields") - FIXED).alias("samples"))
