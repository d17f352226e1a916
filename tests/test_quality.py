"""Profiles, packed fields, copies of a table and unreadable records against plain Python."""

import math
import random
import re
from collections import defaultdict
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varilake.operators import copydiff, profile, reject, unpack

# ---- profiles


def test_profile_small(spark):
    rows = [(1, 5.0), (1, 5.0), (1, None), (1, float("nan")), (1, -1.0), (1, 2.5), (2, 7.0), (2, 1e300), (None, 3.0), (3, None)]
    df = spark.createDataFrame(rows, "load_id INT, dp DOUBLE").withColumn("tab", F.lit("x"))
    spec = profile.ColumnSpec("gt", "dp", profile.whole_and_positive, lambda v: v.cast("double"))
    out = {r["load_id"]: r for r in profile.profile({"gt": df}, (spec,)).collect()}
    one = out[1]
    assert (one["n_rows"], one["n_null"], one["n_bad"], one["distinct_count"], one["n_top"], one["n_numbers"]) == (6, 1, 3, 4, 2, 2)
    assert one["mean_value"] == 5 and one["sd_value"] == 0 and one["max_value"] == 5
    assert out[2]["max_value"] == 1e300 and math.isclose(out[2]["mean_value"], 5e299)
    assert out[None]["n_numbers"] == 1
    assert out[3]["mean_value"] is None and out[3]["null_share"] == 1 and out[3]["bad_share"] == 0


def moments(values):
    exact = [Fraction(v) for v in values]
    mean = sum(exact) / len(exact)
    variance = sum(v * v for v in exact) / len(exact) - mean * mean
    with localcontext(prec=60, Emax=10**6, Emin=-(10**6)):
        return float(mean), float((Decimal(variance.numerator) / Decimal(variance.denominator)).sqrt())


def profiled(spark, values):
    spec = profile.ColumnSpec("v", "x", lambda v: ~F.isnan(v), lambda v: v)
    return spark.createDataFrame([(1, float(v)) for v in values], "load_id INT, x DOUBLE"), spec


@pytest.mark.parametrize(
    "values",
    [
        [900_000_000.0] * 500 + [900_000_000.001] * 500,  # a small spread of large values
        [1e-300, 3e-300], [1e200, -1e200, 5e199], [0.1, 0.2, 0.3, -7.0], [0.0, 5e-324], [2.0**53 - 1, -(2.0**53), 1.0], [1e300, 1.0, 1e-300],
    ],
)
def test_moments_are_exact(spark, values):
    df, spec = profiled(spark, values)
    r = profile.combine(profile.power_sums(df, spec)).first()
    mean, sd = moments(values)
    assert r["mean_value"] == mean and math.isclose(r["sd_value"], sd, rel_tol=1e-14)


def test_power_sums_merge_in_any_order(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.random(), rng.randint(0, 10**6) + 0.25, -rng.random() * 1e12, 10.0 ** rng.randint(-20, 20)]) for _ in range(2000)]
    df, spec = profiled(spark, values)
    parts = [profile.power_sums(df.where(f"pmod(hash(x), 3) = {i}"), spec) for i in range(3)]
    whole = profile.combine(profile.power_sums(df, spec)).first()
    assert profile.combine(parts[2].unionByName(parts[0]).unionByName(parts[1])).first() == whole
    assert (whole["mean_value"], whole["distinct_count"]) == (moments(values)[0], len(set(values)))


def test_many_copies_of_a_large_value(spark):
    df = spark.range(1).select(F.lit(1).alias("load_id"), F.lit(999_999_999.0).alias("x"))
    spec = profile.ColumnSpec("v", "x", lambda v: ~F.isnan(v), lambda v: v)
    one = profile.power_sums(df, spec)
    many = one.withColumns({c: (F.col(c) * 10**9).cast("decimal(38,0)") for c in ("s1", "hh", "hl", "ll")}).withColumns({c: F.col(c) * 10**9 for c in ("n_rows", "n_numbers")})
    r = profile.combine(many).first()
    assert r["mean_value"] == 999_999_999.0 and r["sd_value"] == 0 and r["n_rows"] == 10**9
    both = spark.createDataFrame([(1, float("inf")), (1, 1.0), (2, None)], "load_id INT, x DOUBLE")
    assert {r["load_id"]: (r["mean_value"], r["n_numbers"]) for r in profile.combine(profile.power_sums(both, spec)).collect()} == {1: (None, 2), 2: (None, 0)}


def test_number_and_name_texts(spark):
    texts = ["1", "1.5", "1e5", "1E-3", "1.2e+10", "", " 1", "1 ", "1.", ".5", "-1", "1\n", "nan", "1d", ".", "PASS", "q10;s50", "q10;", ";a", "a b", "a\n"]
    out = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", F.col("t").rlike(profile.NUMBER_TEXT), F.col("t").rlike(profile.NAMES_TEXT)).collect()}
    assert {t for t, r in out.items() if r[0]} == {"1", "1.5", "1e5", "1E-3", "1.2e+10"}
    assert {t for t, r in out.items() if r[1]} >= {".", "PASS", "q10;s50", "1"} and not any(out[t][1] for t in ("", "q10;", ";a", "a b", "a\n", "1."))


def test_changes_need_a_predecessor(spark):
    df = spark.createDataFrame([(1, 0), (3, 5), (4, None), (4, None), (5, 1)], "load_id INT, a1 INT")
    spec = profile.ColumnSpec("gt", "a1", lambda v: v >= 0, lambda v: v.cast("double"))
    out = {(r["load_id"], r["measure"]) for r in profile.changed_measures(profile.profile({"gt": df}, (spec,))).collect()}
    assert out == {(4, "null_share"), (4, "distinct_count"), (4, "max_value"), (4, "mean_value"), (5, "null_share"), (5, "distinct_count"), (5, "max_value"), (5, "mean_value")}
    assert profile.changed_measures(profile.profile({"gt": df.where("false")}, (spec,))).count() == 0


# ---- packed fields


def key_follows(rest):
    key = "[A-Za-z][A-Za-z0-9_]*"
    span = re.match(r'"(?:[^"]|"")*+"', rest)
    return bool(re.match(f"{key}=", rest) or span and (re.match(f'"{key}=', span[0]) or re.fullmatch(f'"{key}"', span[0]) and rest[span.end() :][:1] == "="))


def split_by_hand(text, field):
    """Values of a field by reading it letter by letter."""
    if text is None:
        return []
    seps = {"info": ";|\t", "alt": ",/;|", "fmt": ":;\t"}[field]
    out, now, i, spans = [], [], 0, {}
    while i < len(text):
        c = text[i]
        if c == '"':
            m = re.compile(r'"(?:[^"]|"")*+"').match(text, i)
            if m:
                now.append(("q", m[0]))
                i = m.end()
                continue
        cut = c in seps
        if c == "," and field == "info":
            cut = key_follows(text[i + 1 :].lstrip(" \t"))
        if cut:
            out.append(now)
            now = []
        else:
            now.append(("c", c))
        i += 1
    out.append(now)
    vals = []
    for parts in out:
        while parts and parts[0][0] == "c" and parts[0][1] in " \t":
            parts.pop(0)
        while parts and parts[-1][0] == "c" and parts[-1][1] in " \t":
            parts.pop()
        if not parts and field == "info":
            continue
        plain = "".join(p[1] for p in parts if p[0] == "c")
        quoted = [p for p in parts if p[0] == "q"]
        bare = len(quoted) == 1 and parts[-1][0] == "q" and (plain == "" or plain.endswith("=") and plain.count("=") == 1)
        vals.append("".join(p[1] if p[0] == "c" or not bare else p[1][1:-1].replace('""', '"') for p in parts))
    return vals


def unpacked(spark, rows):
    df = spark.createDataFrame(rows, "site_id BIGINT, info STRING, alt STRING, fmt STRING").withColumn("idx", F.lit(9)).withColumn("val", F.lit("z"))
    out = defaultdict(list)
    for r in unpack.unpack(df, "site_id", {"info": unpack.INFO, "alt": unpack.ALT, "fmt": unpack.FMT}).collect():
        out[(r[0], r[1])].append((r[2], r[3]))
    for v in out.values():
        v.sort()
        assert [i for i, _ in v] == list(range(1, len(v) + 1))
    return {k: [x for _, x in v] for k, v in out.items()}


def test_unpack_cases(spark):
    rows = [
        (1, 'A=1;"B=x;y"|C="p,Q=1";;D=""";"""\tE', "T,<DEL>/\"<INS:ME,2>\"", '0/1:"see ""A""":3,4:'),
        (2, None, None, None), (3, "", "", ""), (4, " \t", " ", " "),
        (5, "A=1,2,B=3, C=4,\"D=5\",6", ",", "::"), (6, 'A="x', 'x"y', '"a"b:c'),
        (7, "A=\x01q0\x02;\x01e;B=\"\x01q0\x02\"", "\x01", "\x01k0\x02:\"\x01e\""), (8, "A=$1\\;B=\\\"", "a$b", "\\:$0"),
    ]
    got = unpacked(spark, rows)
    assert got[(1, "info")] == ["A=1", "B=x;y", "C=p,Q=1", 'D=";"', "E"]
    assert got[(1, "alt")] == ["T", "<DEL>", "<INS:ME,2>"] and got[(1, "fmt")] == ["0/1", 'see "A"', "3,4", ""]
    assert not any(k[0] == 2 for k in got) and (3, "info") not in got and got[(3, "alt")] == [""] == got[(3, "fmt")]
    assert got[(5, "info")] == ["A=1,2", "B=3", "C=4", "D=5,6"] or got[(5, "info")] == ["A=1,2", "B=3", "C=4", '"D=5",6']
    assert got[(5, "alt")] == ["", ""] and got[(5, "fmt")] == ["", "", ""]
    assert got[(7, "info")] == ["A=\x01q0\x02", "\x01e", "B=\x01q0\x02"] and got[(7, "fmt")] == ["\x01k0\x02", "\x01e"]
    for i, info, alt, fmt in rows:
        for field, text in (("info", info), ("alt", alt), ("fmt", fmt)):
            if (i, field) != (5, "info"):
                assert got.get((i, field), []) == split_by_hand(text, field), (i, field)


def test_unpack_random_and_long(spark):
    rng = random.Random(1)
    pick = lambda: "".join(rng.choice(['"', '""', ";", ",", "|", ":", "/", "\t", " ", "A=", "b", "Cd=", "7"]) for _ in range(rng.randint(0, 14)))
    rows = [(i, pick(), pick(), pick()) for i in range(400)] + [(999, 'A="' + "x;" * 200_000 + '";' + "B=1;" * 50_000, "T," * 100_000, '"' + '""' * 100_000 + '":1')]
    got = unpacked(spark, rows)
    for i, *texts in rows[:-1]:
        for field, text in zip(("info", "alt", "fmt"), texts, strict=True):
            assert got.get((i, field), []) == split_by_hand(text, field), (field, text)
    assert len(got[(999, "info")]) == 50_001 and len(got[(999, "alt")]) == 100_001 and got[(999, "fmt")][0] == '"' * 100_000


def test_unpack_tables(spark, data):
    table = pd.read_parquet(f"{data}/vcf_sites.parquet")
    clean = lambda x: x if isinstance(x, str) else None
    rows = [(int(r.site_id), clean(r.info), clean(r.alt), clean(r.fmt)) for r in table.itertuples()]
    got = unpacked(spark, rows)
    assert got == {(i, f): v for i, *t in rows for f, x in zip(("info", "alt", "fmt"), t, strict=True) if (v := split_by_hand(x, f))}


# ---- two copies

FIELDS = {"chrom": False, "pos": True, "ref": False}


def compared(a, b):
    def held(rows):
        out = defaultdict(set)
        for k, *v in rows:
            if k is not None:
                out[k].add(tuple(float(x) if isinstance(x, (int, float)) else x for x in v))
        return out

    a, b, out = held(a), held(b), set()
    for k in a.keys() | b.keys():
        if k not in b or k not in a:
            out.add((k, "only_in_a" if k in a else "only_in_b"))
            continue
        out |= {(k, f) for i, f in enumerate(FIELDS) if {r[i] for r in a[k]} != {r[i] for r in b[k]}}
    return out


def differences(spark, a, b):
    left = spark.createDataFrame(a, "row_id BIGINT, chrom STRING, pos DOUBLE, ref STRING").withColumn("diff", F.lit("x")).withColumn("k", F.lit(1))
    right = spark.createDataFrame(b, "row_id BIGINT, chrom STRING, pos BIGINT, ref STRING")
    rows = copydiff.differences(left, right, "row_id", FIELDS, ("a", "b")).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_hash_is_sparks(spark):
    rows = spark.range(-50, 50).select("id", (F.col("id") * 7919 - 3).alias("h")).select("*", F.xxhash64("id", "h").alias("x")).toPandas()
    u = lambda c: rows[c].to_numpy(np.int64).view(np.uint64)
    assert (copydiff._xx(u("id"), u("h")).view(np.int64) == rows["x"].to_numpy()).all()


def test_differences_cases(spark):
    a = [(1, "c", 5.0, "A"), (2, "c", 5.0, "A"), (3, None, None, None), (4, "c", None, "A"), (5, "c", 3e9, "A"), (6, "x", 1.0, "A"), (6, "x", 1.0, "A"), (7, "", 0.0, "A"), (8, "A", 1.0, None), (None, "c", 1.0, "A"), (-9, "c", 1.0, "A")]
    b = [(1, "c", 5, "A"), (1, "c", 5, "A"), (2, "d", 6, "T"), (3, None, None, None), (4, "c", 0, "A"), (5, "c", 3_000_000_000, "A"), (6, "x", 1, "A"), (6, "y", 1, "A"), (7, None, 0, "A"), (8, None, 1, "A"), (10, "c", 1, "A")]
    got = differences(spark, a, b)
    assert got == compared(a, b)
    assert (6, "chrom") in got and (7, "chrom") in got and (5, "pos") not in got and (-9, "only_in_a") in got
    assert differences(spark, a, a[:0]) == {(k, "only_in_a") for k in {r[0] for r in a} - {None}} and differences(spark, [], []) == set()


def test_equal_numbers_differ_beyond_doubles(spark):
    assert differences(spark, [(1, "c", float(2**53), "A")], [(1, "c", 2**53 + 1, "A")]) == {(1, "pos")}


def test_differences_random_hot_and_many(spark):
    rng = random.Random(5)
    a = [(i, f"c{i % 7}", float(i * 3), "A") for i in range(6000)]
    b = [(k, c if rng.random() > 0.01 else "z", int(p), r) for k, c, p, r in a if rng.random() > 0.01] + [(7000 + i, "c", 1, "A") for i in range(30)]
    a += [(1, "c1", 3.0, "A")] * 4000  # a key with a third of the rows
    assert differences(spark, a, b) == compared(a, b)


def test_buckets_that_cannot_be_peeled(spark, monkeypatch):
    # an estimate far too low: every bucket is overfull, and all keys are compared
    monkeypatch.setattr(copydiff, "ESTIMATE_BITS", 1)
    monkeypatch.setattr(copydiff, "LOAD", 1000.0)
    a = [(i, "c", 1.0, "A") for i in range(9000)]
    b = [(i, "c", 2 if i % 2 else 1, "A") for i in range(9000)]
    assert differences(spark, a, b) == {(i, "pos") for i in range(1, 9000, 2)}


# ---- unreadable records


def reason_by_hand(line, width):
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?!")').match(line, i)
            if not m or line[m.end() : m.end() + 1] not in ("", "\t"):
                return "quoting"
            fields.append(m[1].replace('""', '"'))
            i = m.end()
        else:
            end = line.find("\t", i)
            end = len(line) if end < 0 else end
            fields.append(line[i:end])
            i = end
        if i >= len(line):
            break
        i += 1
    if len(fields) != width:
        return "column_count"
    if not re.fullmatch("[0-9]+", fields[1]) or int(fields[1]) > 2**53:
        return "pos"
    keys = fields[8].split(":")
    if "" in keys or len(set(keys)) < len(keys) or "GT" not in keys:
        return "format"
    for s in fields[9:]:
        v = s.split(":")
        if len(v) > len(keys) or len(v) <= keys.index("GT"):
            return "fmt"
        alleles = re.split("[/|]", v[keys.index("GT")])
        if len(alleles) > 2 or any(x != "." and not (re.fullmatch("[0-9]+", x) and int(x) <= 10**6) for x in alleles):
            return "fmt"
    return None


def check_lines(spark, lines):
    df = spark.createDataFrame(lines, "line_id BIGINT, src_file STRING, line_no INT, line STRING").withColumn("reason", F.lit("x"))
    width = {}
    for _, f, _, line in sorted(lines, key=lambda x: x[2]):
        if line and re.match("#CHROM(\t|\r?$)", line):
            width.setdefault(f, len(line.rstrip("\r").split("\t")))
    want = {i: reason_by_hand(line or "", width.get(f)) for i, f, _, line in lines if not (line or "").startswith("#")}
    got = {r["line_id"]: r["reason"] for r in reject.rejected(df).collect()}
    assert got == {i: r for i, r in want.items() if r}
    ok = {r["line_id"]: r for r in reject.loaded(df).collect()}
    assert set(ok) == {i for i, r in want.items() if r is None}
    return got, ok


HEAD = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"
GOOD = ["1", "5", ".", "A", "T", ".", ".", "x=1", "GT:DP", "0/1:3", "1|1"]


def test_reject_cases(spark):
    def rec(**kw):
        f = list(GOOD)
        for k, v in kw.items():
            f[int(k[1:])] = v
        return "\t".join(f)

    texts = [
        rec(), rec() + "\r", "", "\r", None, rec(_7='"a\tb"'), rec(_7='"a""b"'), rec(_7='"a'), rec(_7='"a" b'), rec(_7='a"b"'), rec(_7='""'), rec(_7='"a""'), rec() + "\tx", rec(_1="x"), rec(_1="-1"), rec(_1="1e3"), rec(_1="5.0"),
        rec(_1=str(2**53)), rec(_1=str(2**53 + 1)), rec(_1="000005"), rec(_1="12,345"), rec(_1=" 5"), rec(_1=""), rec(_1="9" * 60), rec(_8="DP"), rec(_8="GT:GT"), rec(_8="GT:"), rec(_8=""), rec(_8='"GT:DP"'), rec(_8="DP:GT"), rec(_9="1:0/1", _10="2:1", _8="DP:GT"),
        rec(_9="0/1:3:4"), rec(_9=""), rec(_9="0/1/1"), rec(_9="./."), rec(_9="."), rec(_9="1000000/0"), rec(_9="1000001"), rec(_9="0001"), rec(_9="0000001000000"), rec(_9="-1"), rec(_9="0\\1"), rec(_9='"0/1:3"'), "#c", HEAD, rec(_0="\x01q0\x02"), rec(_7='"\x01q0\x02"'), '"' + rec() + '"',
    ]
    lines = [(1, "f", 1, HEAD)] + [(i + 2, "f", i + 2, t) for i, t in enumerate(texts)] + [(900, "nohead", 1, rec()), (901, None, 1, rec())]
    got, ok = check_lines(spark, lines)
    assert got[900] == got[901] == "column_count"
    assert ok[7]["info"] == "a\tb" and ok[2]["samples"] == ["0/1:3", "1|1"] and ok[19]["pos"] == 2**53


def test_reject_random(spark):
    rng = random.Random(2)
    bits = ['"', '""', "\t", "a", ":", "/", "GT", "1", ".", "\r", " "]
    lines = [(0, "f", 0, "#CHROM\tb\tc")]
    for i in range(1, 500):
        lines.append((i, "f", i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))))
    for i in range(500, 800):
        f = list(GOOD)
        for _ in range(2):
            j = rng.randrange(len(f))
            f[j] = "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
        lines.append((i, "g", i, "\t".join(f)))
    lines.append((900, "g", 0, HEAD))
    check_lines(spark, lines)


def test_reject_tables(spark, data):
    t = pd.read_parquet(f"{data}/vcf_lines.parquet")
    got, _ = check_lines(spark, [tuple(x) for x in t[["line_id", "src_file", "line_no", "line"]].astype(object).itertuples(index=False)])
    assert got and set(got.values()) <= set(reject.REASONS)


@pytest.mark.parametrize("n", [0])
def test_reject_empty(spark, n):
    df = spark.createDataFrame([], "line_id BIGINT, src_file STRING, line_no INT, line STRING")
    assert reject.rejected(df).count() == n == reject.loaded(df).count()


def test_reject_many_tabs_and_files(spark, monkeypatch):
    lines = [(0, "f", 1, HEAD), (1, "f", 2, "\t".join(GOOD)), (2, "f", 3, "\t" * 50_000), (3, "f", 4, "\n".join(["\t".join(GOOD)] * 2)), (4, "f", 5, '"' * 70_001)]
    check_lines(spark, lines)
    monkeypatch.setattr(reject, "BROADCAST_FILES", 0)
    check_lines(spark, lines)


def test_only_corrupt_lines_are_classified(spark, data):
    """What the reader lets through has no reason, and most of what it holds back has one."""
    r = reject.read_permissive(spark.read.parquet(f"{data}/vcf_lines.parquet")).agg(F.count("reason"), F.count("corrupt"), F.count_if(F.col("corrupt").isNull() & F.col("reason").isNotNull()), F.count(F.lit(1))).first()
    assert r[2] == 0 < r[0] <= r[1] < 0.2 * r[3]


def test_differences_of_many_keys_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(copydiff, "BROADCAST_KEYS", 10)
    a = [(i, "c", 1.0, "A") for i in range(500)]
    b = [(i, "c", 1, "A" if i % 3 else "G") for i in range(450)]
    assert differences(spark, a, b) == {(i, "ref") for i in range(0, 450, 3)} | {(i, "only_in_a") for i in range(450, 500)}
