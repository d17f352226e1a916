"""Top N and percentiles against plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varilake.llm import quantiles, topn


def best(rows, n):
    groups = defaultdict(set)
    for g, s, i, t in rows:
        if s is not None and s == s and i is not None:
            groups[g].add((-s, t is None, t or 0, i))
    return {(g, k + 1, r[3]) for g, rs in groups.items() for k, r in enumerate(sorted(rs)[:n])}


def topped(spark, rows, n=3, **kw):
    df = spark.createDataFrame(rows, "chrom STRING, score DOUBLE, row_id BIGINT, pos DOUBLE").withColumn("g", F.lit(1)).withColumn("rnk", F.lit(2))
    out = topn.top_n(df, "chrom", "score", "row_id", n, (F.col("pos"),), **kw).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


def test_top_n_cases(spark):
    rows = [("a", 5.0, 1, 2.0), ("a", 5.0, 2, 1.0), ("a", 5.0, 3, None), ("a", 5.0, 3, None), ("a", 5.0, 4, 1.0), ("b", None, 5, 1.0), ("b", float("nan"), 6, 1.0), ("c", -1.0, 7, 1.0), (None, 2.0, 8, 1.0), (None, 3.0, 9, None), ("d", 1.0, None, 1.0), ("", 0.0, 10, 0.0), ("e", float("inf"), 11, 1.0)]
    assert topped(spark, rows) == best(rows, 3)
    assert ("a", 1, 2) in topped(spark, rows) and ("a", 3, 1) in topped(spark, rows)
    assert topped(spark, []) == set()
    with pytest.raises(ValueError):
        topped(spark, rows, 0)


@pytest.mark.parametrize("shares", [(1 / 64, 1 / 8), (0.3, 0.6, 0.9), ()])
def test_top_n_random_with_a_hot_group(spark, shares):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 300)}", float(rng.randint(0, 40)), rng.randint(0, 3000), float(rng.randint(0, 3))) for _ in range(5000)]
    rows += rng.sample(rows, 500)
    assert topped(spark, rows, 5, shares=shares) == best(rows, 5)


def test_sketch_error_stays_within_its_bound():
    rng = np.random.default_rng(1)
    for k in (8, 64):
        values = rng.permutation(np.concatenate([rng.normal(size=30_000), np.full(9_000, 0.5)]))
        parts = []
        for chunk in np.array_split(values, 7):
            s = quantiles.Sketch(k)
            for piece in np.array_split(chunk, 5):
                s.add(piece)
            parts.append(s)
        whole = quantiles.Sketch(k)
        for s in parts:
            for w, e, b in s.buffers():
                whole.add(b, w, e)
        got = list(whole.buffers())
        v, w = np.concatenate([b for _, _, b in got]), np.concatenate([np.full(len(b), w) for w, _, b in got])
        assert w.sum() == len(values)
        order = np.argsort(v, kind="stable")
        v, upto = v[order], np.cumsum(w[order])
        exact, error = np.sort(values), whole.error
        assert error <= len(values) * (math.log2(len(values) / k) + 1) / (2 * k)
        for x in exact[::997]:
            true, told = np.searchsorted(exact, x, "right"), (upto[np.searchsorted(v, x, "right") - 1] if x >= v[0] else 0)
            assert abs(true - told) <= error


def exact_percentiles(rows, percents):
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None and v == v:
            groups[g].append(v)
    return {(g, p): sorted(vs)[-(-p * len(vs) // 100) - 1] for g, vs in groups.items() for p in percents}


@pytest.mark.parametrize("k", [16, 4096])
def test_percentiles(spark, k):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot"]), float(rng.randint(0, 500))) for _ in range(8000)] + [("one", 3.0), ("none", None), ("none", float("nan")), (None, 4.0), (None, 1.0), ("same", 2.0), ("same", 2.0), ("neg", -1.0), ("neg", 0.0)]
    df = spark.createDataFrame(rows, "sample STRING, dp DOUBLE").repartition(5).withColumn("g", F.lit(1)).withColumn("v", F.lit(1))
    answers = quantiles.percentiles(df, "sample", F.col("dp"), (1, 50, 90, 99, 100), k)
    want = exact_percentiles(rows, (1, 50, 90, 99, 100))
    got = {(r["sample"], r["pct"]): r for r in answers.collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        assert r["low"] <= want[key] <= r["high"] and r["low"] <= r["val"] <= r["high"]
    assert {(r["sample"], r["pct"]): r["val"] for r in quantiles.exact(df, "sample", F.col("dp"), answers).collect()} == want


def test_percentiles_of_days_combine(spark):
    rows = [("s", float(i % 97)) for i in range(6000)]
    df = spark.createDataFrame(rows, "sample STRING, dp DOUBLE")
    days = [quantiles.merge(quantiles.build(df.where(f"dp % 3 = {i}"), "sample", F.col("dp"), 32), "sample", 4, 32).withColumn("part", F.lit(i)) for i in range(3)]
    both = quantiles.merge(days[0].unionByName(days[1]).unionByName(days[2]), "sample", 3, 32)
    r = quantiles.query(both, "sample", (50,)).first()
    assert r["n"] == 6000 and r["low"] <= 48 <= r["high"] and r["error"] < 6000 * 0.2


def test_percentiles_empty(spark):
    df = spark.createDataFrame([], "sample STRING, dp DOUBLE")
    assert quantiles.percentiles(df, "sample", F.col("dp"), (50,)).count() == 0
    assert quantiles.exact(df, "sample", F.col("dp"), quantiles.percentiles(df, "sample", F.col("dp"), (50,))).count() == 0


def test_merging_tree_has_bounded_fan_in(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(3000)], "sample STRING, dp DOUBLE").repartition(9)
    r = quantiles.query(quantiles.merge(quantiles.build(df, "sample", F.col("dp"), 16), "sample", 9, 16, fan_in=2), "sample", (50,)).first()
    assert r["n"] == 3000 and abs(r["val"] - 1499) <= r["error"]


def test_many_groups_and_spilled_sketches(spark, monkeypatch):
    """10^5 groups beside one with a third of all rows, with sketches given out early and a salted exact pass."""
    for name, value in (("HELD", 5000), ("CHUNK", 20_000), ("BROADCAST_GROUPS", 10)):
        monkeypatch.setattr(quantiles, name, value)
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 100_000)).alias("sample"), (F.xxhash64("id") % 1000).cast("double").alias("dp"))
    answers = quantiles.percentiles(df, "sample", F.col("dp"), (50,), 64)
    got = quantiles.exact(df, "sample", F.col("dp"), answers)
    want = df.groupBy("sample").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dp)").alias("val"))
    assert got.select("sample", "val").exceptAll(want).isEmpty() and want.count() == got.count() > 66_000


@pytest.mark.parametrize("limit", [0, 10**6])
def test_top_n_in_bands_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", limit)
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.05 else f"g{int(200 * rng.random() ** 3)}", float(rng.randint(0, 60)), rng.randint(0, 2000), None) for _ in range(4000)]
    assert topped(spark, rows, 4) == best(rows, 4) == topped(spark, rows, 4, shares=(0.1, 0.3, 0.5))


def test_band_shares():
    assert topn.band_shares(0, 0, 3) == () and topn.band_shares(100, 100, 3) == (0.5,)
    assert topn.band_shares(10**9, 1000, 3) == (6e-6, 4.8e-5) and all(0 < x <= 0.5 for x in topn.band_shares(10**6, 10**5, 3))
