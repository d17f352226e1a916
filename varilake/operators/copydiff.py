"""Differences between two copies of a table, by invertible Bloom lookup tables.

Every row becomes (key, hash of the compared fields) and is added to three cells of a small table of sums; the tables
of the two copies are subtracted by adding one side with a minus sign. Rows that both hold cancel out, so what is
shuffled are sums, combined on the map side, and peeling a table gives just the keys that differ. Only those keys' rows
are fetched and compared field by field. Cells hold plain sums of 32-bit halves, not XORs, so a row delivered m times on
one side and n times on the other leaves m - n copies of itself, which peel like any other; such keys are then found
equal by the comparison.

The rows are spread over buckets, each with a table of its own. A bucket that holds more differences than its table can
tell apart is not peeled: all of its keys are compared.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_BITS = 10
"""Each of a table's three parts has 2 ** CELL_BITS cells."""
LOAD = 0.6
"""Differences aimed at per cell; peeling three parts works up to 0.81."""
ESTIMATE_BITS = 6
"""The number of differences is estimated from the rows whose hash ends in so many zero bits."""

BROADCAST_KEYS = 2_000_000
"""Most differing keys, of eight bytes each, that are broadcast to fetch their rows; with more, the rows are shuffled."""

_SUMS = ("cnt", "key_hi", "key_lo", "hash_hi", "hash_lo", "chk")


def canonical_number(c: Column) -> Column:
    """Text that is equal for equal numbers whatever their type: whole DOUBLEs are written as BIGINT."""
    d = c.cast("double")
    whole = (d == F.rint(d)) & (F.abs(d) < 9.2e18)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(d.cast("string"))


def _side(df: DataFrame, key: str, fields: dict[str, bool], sign: int) -> DataFrame:
    texts = [(canonical_number(df[f]) if number else df[f].cast("string")).alias(f"f{i}") for i, (f, number) in enumerate(fields.items())]
    return df.select(df[key].cast("bigint").alias("k"), *texts, F.lit(sign).alias("sign"))


def _hashed(side: DataFrame, n: int) -> DataFrame:
    """k, h, place. A field's null is told from any text by hashing its null flag as well."""
    parts = [x for i in range(n) for x in (F.col(f"f{i}"), F.col(f"f{i}").isNull())]
    return side.where("k IS NOT NULL").select("k", F.xxhash64(*parts).alias("h"), "sign").withColumn("place", F.xxhash64("k", "h"))


def _xx8(value: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of eight bytes, as Spark's xxhash64 of a BIGINT."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = seed + p5 + np.uint64(8)
        h = rot(h ^ (rot(value * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _xx(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _xx8(second, _xx8(first, np.uint64(42)))


def peel(cells: pd.DataFrame, bits: int) -> tuple[np.ndarray, bool]:
    """Keys of one bucket's subtracted table, and whether it came out empty. cells: cell and the sums of each."""
    table = np.zeros((3 << bits, len(_SUMS)), dtype=np.int64)
    table[cells["cell"].to_numpy()] = cells[list(_SUMS)].to_numpy()
    low, mask = np.int64(0xFFFFFFFF), np.uint64((1 << bits) - 1)
    found: list[np.ndarray] = []
    while True:
        rows = np.flatnonzero(table[:, 0])
        t = table[rows]
        n = t[:, :1]
        exact = (t[:, 1:] % n == 0).all(axis=1)
        rows, t, n = rows[exact], t[exact], n[exact]
        q = t[:, 1:] // n
        inside = ((q[:, [1, 3, 4]] >= 0) & (q[:, [1, 3, 4]] <= low)).all(axis=1)
        rows, n, q = rows[inside], n[inside, 0], q[inside]
        join = lambda i: ((q[:, i] << 32) | q[:, i + 1]).view(np.uint64) if len(q) else np.zeros(0, np.uint64)
        key, h, chk = join(0).copy(), join(2).copy(), q[:, 4].copy().view(np.uint64)
        place = _xx(key, h)
        cell = np.stack([((place >> np.uint64(bits * i)) & mask).astype(np.int64) + (i << bits) for i in range(3)], axis=1)
        pure = (_xx(h, key) & np.uint64(low) == chk) & (cell == rows[:, None]).any(axis=1)
        if not pure.any():
            return np.concatenate(found) if found else np.zeros(0, np.int64), not table.any()
        _, once = np.unique(np.stack([key[pure], h[pure]], axis=1), axis=0, return_index=True)
        key, n, q, cell = key[pure][once], n[pure][once], q[pure][once], cell[pure][once]
        gone = np.concatenate([n[:, None], q * n[:, None]], axis=1)
        for i in range(3):
            np.subtract.at(table, cell[:, i], gone)
        found.append(key.view(np.int64))


def _cells(rows: DataFrame, buckets: int, bits: int) -> DataFrame:
    bucket = F.pmod(F.shiftrightunsigned("place", 3 * bits), F.lit(buckets))
    cell = F.array(*(F.shiftrightunsigned("place", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) + (i << bits) for i in range(3)))
    half = lambda name, c: (F.shiftright(c, 32).alias(f"{name}_hi"), c.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"{name}_lo"))
    flat = rows.select(
        bucket.alias("bucket"), F.explode(cell).alias("cell"), F.col("sign").cast("bigint").alias("cnt"),
        *(p for name, c in (("key", F.col("k")), ("hash", F.col("h"))) for p in half(name, c)), F.xxhash64("h", "k").bitwiseAND(F.lit(0xFFFFFFFF)).alias("chk"),
    )
    sums = [F.sum(F.col(c) * (F.col("cnt") if c != "cnt" else F.lit(1))).alias(c) for c in _SUMS]
    return flat.groupBy("bucket", "cell").agg(*sums).where(" OR ".join(f"{c} <> 0" for c in _SUMS))


def differing_keys(rows: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """(k): every key whose rows differ between the two sides, and few others. rows: k, h, sign, place of both sides."""
    strata = rows.where(F.col("place").bitwiseAND(F.lit((1 << ESTIMATE_BITS) - 1)) == 0)
    left = strata.groupBy("k", "h").agg(F.sum("sign").alias("net")).where("net <> 0").count()
    # four standard deviations of the estimate on top: an unlucky estimate costs time, never a difference
    expected = (left + 4 * math.sqrt(left) + 4) * (1 << ESTIMATE_BITS)
    buckets = max(1, math.ceil(expected / (LOAD * (3 << bits))))

    def peeled(bucket: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        keys, clean = peel(cells, bits)
        return pd.DataFrame({"bucket": bucket[0], "k": pd.array(keys if clean else [None], dtype="Int64"), "clean": clean})

    out = materialize(_cells(rows, buckets, bits).groupBy("bucket").applyInPandas(peeled, "bucket bigint, k bigint, clean boolean"))
    keys = out.where("clean").select("k")
    stuck = out.where("NOT clean").select("bucket")
    if stuck.isEmpty():
        return materialize(keys.distinct())
    bucket = F.pmod(F.shiftrightunsigned("place", 3 * bits), F.lit(buckets))
    rest = rows.withColumn("bucket", bucket).join(stuck, "bucket", "left_semi").select("k")
    return materialize(keys.unionByName(rest).distinct())


def differences(left: DataFrame, right: DataFrame, key: str, fields: dict[str, bool], names: tuple[str, str]) -> DataFrame:
    """(key, diff): only_in_<name> for a key missing on the other side, else one row per field that differs.

    fields: name -> whether it is compared as a number (its type may differ between the sides). The distinct rows of
    each side are compared: repeated rows count once; of a key with several rows, a field differs if the sets of its
    values do. Two nulls are equal, null and a value differ. Rows with a null key can't be paired and are left out.
    Other columns are ignored; empty tables give what the other side holds.
    """
    n = len(fields)
    sides = _side(left, key, fields, 1).unionByName(_side(right, key, fields, -1))
    keys = differing_keys(_hashed(sides, n))
    few = keys.count() <= BROADCAST_KEYS
    rows = sides.join(F.broadcast(keys) if few else keys, "k", "left_semi")
    long = rows.select("k", F.when(F.col("sign") > 0, 1).otherwise(2).alias("on"), F.posexplode(F.array(*(f"f{i}" for i in range(n)))).alias("f", "v"))
    held = long.groupBy("k", "f", "v").agg(F.bit_or("on").alias("on"))
    per_key = held.groupBy("k").agg(F.bit_or("on").alias("on"), *(F.max((F.col("f") == i) & (F.col("on") != 3)).alias(f"d{i}") for i in range(n)))
    one = F.when(F.col("on") == 1, F.array(F.lit(f"only_in_{names[0]}"))).when(F.col("on") == 2, F.array(F.lit(f"only_in_{names[1]}")))
    differ = F.array_compact(F.array(*(F.when(F.col(f"d{i}"), F.lit(f)) for i, f in enumerate(fields))))
    return per_key.select(F.col("k").alias(key), F.explode(one.otherwise(differ)).alias("diff"))
